"""Evaluation of a detector on labelled files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import detect as detection
from . import matching


def evaluate(cases: DataFrame, signals: DataFrame, detector: Callable[[DataFrame], DataFrame] = detection.raw_hits, tolerance: float = matching.TOLERANCE_S) -> tuple[DataFrame, DataFrame]:
    """Per file: name, tier, status, tp, fp, fn; and the one row of metrics over all cases.

    ``cases`` has the columns of a ground truth, ``signals`` of decoded files, whose file_id is the
    case's path. A case without a file is a SKIP: no counts, but it stays among the files. A file
    whose detection failed is an ERROR: all its truths are missed. The hits of the detector are read
    twice; pass signals whose hits are saved if detecting twice is dear.
    """
    if cases.isEmpty():
        raise ValueError("no test cases found")
    hits = detector(signals)
    failed = hits.where("error is not null").select("file_id").distinct().withColumn("failed", F.lit(True))
    found = detection.merged(hits.join(failed, "file_id", "left_anti"))
    there = signals.select("file_id").distinct().withColumn("there", F.lit(True))
    c = cases.join(there, cases["path"] == there["file_id"], "left").drop("file_id").join(failed, cases["path"] == failed["file_id"], "left").drop("file_id")
    truth = c.where("there").select("name", F.posexplode("gt_times").alias("gi", "gt"))
    det = matching.ranked(c.where("there").select("name", "path").join(found.select(F.col("file_id").alias("path"), F.col("t").alias("det")), "path").select("name", "det"), "name", "det", "di")
    scores = c.join(matching.match(truth, det, tolerance, "name"), "name", "left").fillna(0, ["tp", "fp", "fn"])
    status = F.when(F.col("there").isNull(), "SKIP").when(F.col("failed"), "ERROR").when((F.col("fn") == 0) & (F.col("fp") == 0), "OK").otherwise("MISS")
    per_file = scores.select("name", "tier", status.alias("status"), "tp", "fp", "fn")
    return per_file, totals(per_file)


def totals(per_file: DataFrame) -> DataFrame:
    """The one row of metrics, and the number of files with an error."""
    errors = per_file.agg(F.count_if(F.col("status") == "ERROR").alias("errors"))
    return matching.metrics(per_file).join(F.broadcast(errors))  # one row each
