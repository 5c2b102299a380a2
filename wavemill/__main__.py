"""Command line: ``detect FILE`` lists the splices of a WAV file, ``evaluate --data-dir DIR`` scores labelled files."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .operators import detect, evaluate, report
from .sources import ground_truth, wav


def evaluation(spark: SparkSession, data_dir: str) -> list[str]:
    """The report of an evaluation: a line a file, the metrics, and the time it took."""
    began = time.time()
    cases = ground_truth.load_ground_truth(spark, data_dir)
    per_file, metrics = evaluate.evaluate(cases, wav.read_wav(spark, data_dir, names=cases))
    per_file = per_file.persist()
    try:
        lines = [r.line for r in report.file_lines(per_file).orderBy("name").collect()]  # a row a labelled file
        lines += ["-" * 60, *[r.line for r in report.metric_lines(evaluate.totals(per_file)).orderBy("no").collect()]]
    finally:
        per_file.unpersist()
    return [*lines, f"elapsed: {time.time() - began:.1f}s"]


def splices(spark: SparkSession, path: str) -> list[str]:
    """A line for each splice of the WAV files at ``path``."""
    found = detect.detect(wav.read_wav(spark, path)).orderBy("file_id", "t")
    return [f"{r.file_id}: {r.t:.3f} s ({r['mode']})" for r in found.collect()] or ["no splices"]


def main(args: Sequence[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="wavemill", description="Find and score abrupt changes in audio.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("detect").add_argument("input_wav")
    commands.add_parser("evaluate").add_argument("--data-dir", default="data/spliced")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("wavemill").getOrCreate()
    lines = splices(spark, given.input_wav) if given.command == "detect" else evaluation(spark, given.data_dir)
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
