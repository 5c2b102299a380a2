"""Detection from end to end, over signals whose pitch and cuts come from ``nation``: one file a nation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, evaluate, report
from ..operators.telemetry import parameters
from .catalog import query, table

RATE, SECONDS = 8000, 14


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case a nation: the cut stands at a time that its key gives; every fifth has none."""
    k = F.col("n_nationkey")
    cut = F.round(4.0 + (k * 7 % 23) * 0.25, 3)
    spliced = k % 5 != 0
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("nation/"), "n_name").alias("path"), spliced.alias("spliced"), F.when(spliced, F.array(cut)).otherwise(F.array().cast("array<double>")).alias("gt_times"), (k % 3 + 1).cast("int").alias("tier"), k.cast("long").alias("k"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, sr, n_samples, samples: two tones of a pitch of the nation's own; at the cut their phases jump."""
    c = cases(spark, sf_dir).select("path", "k", F.get("gt_times", 0).alias("cut"))
    turn = F.lit(2 * math.pi / RATE)

    def sample(i):
        jump = F.when((i >= F.col("cut") * RATE), F.lit(2.2)).otherwise(F.lit(0.0))
        low, high = (220 + 11 * F.col("k")) * turn, (1130 + 17 * F.col("k")) * turn
        return (0.3 * F.sin(low * i + jump) + 0.2 * F.sin(high * i - jump)).cast("float")

    n = RATE * SECONDS
    return c.select(F.col("path").alias("file_id"), F.lit(RATE).alias("sr"), F.lit(n).alias("n_samples"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), sample).alias("samples"))


def _spread(df: DataFrame) -> DataFrame:
    return df.repartition("file_id")


@query(None)
def detect_hits(spark, sf_dir):
    """Every hit of both tests, with its score and threshold."""
    h = detect.raw_hits(_spread(signals(spark, sf_dir)))
    return h.select("file_id", "mode", "seg_no", F.round("coarse_t", 6).alias("coarse_t"), F.round("score", 4).alias("score"), F.round("threshold", 4).alias("threshold"), F.round("t", 6).alias("t"), "error")


@query(None)
def detect_splices(spark, sf_dir):
    return detect.detect(_spread(signals(spark, sf_dir))).select("file_id", "mode", F.round("t", 6).alias("t"))


@query(None)
def evaluate_files(spark, sf_dir):
    """Each case's status and counts, as lines of the report."""
    per_file, _ = evaluate.evaluate(cases(spark, sf_dir), _spread(signals(spark, sf_dir)))
    return per_file.join(report.file_lines(per_file), "name")


@query(None)
def evaluate_metrics(spark, sf_dir):
    return report.metric_lines(evaluate.evaluate(cases(spark, sf_dir), _spread(signals(spark, sf_dir)))[1])


@query(
    f"""WITH c AS (SELECT n_name AS name, n_nationkey % 5 <> 0 AS spliced, round(4.0 + (n_nationkey * 7 % 23) * 0.25, 3) AS cut FROM nation)
    SELECT name, 'nation/' || name AS file_id, CAST({SECONDS} AS DOUBLE) AS seconds, CASE WHEN spliced THEN 1 ELSE 0 END AS n_cuts, CAST(CASE WHEN spliced THEN cut END AS DOUBLE) AS cut FROM c"""
)
def labelled_signals(spark, sf_dir):
    """Cases joined to their signals by path, with the signal's length."""
    c, s = cases(spark, sf_dir), signals(spark, sf_dir)
    x = c.join(s, c["path"] == s["file_id"])
    return x.select("name", "file_id", (F.size("samples") / F.col("sr")).alias("seconds"), F.size("gt_times").alias("n_cuts"), F.get("gt_times", 0).alias("cut"))


@query("SELECT 'depth' AS name, CAST(8 AS DOUBLE) AS value UNION ALL SELECT 'total_batch_size', 524288 UNION ALL SELECT 'final_lr_frac', 0 UNION ALL SELECT 'warmdown_ratio', 0.5 UNION ALL SELECT 'warmup_ratio', 0")
def schedule_parameters(spark, sf_dir):
    return parameters(spark).where(F.col("name").isin("depth", "total_batch_size", "final_lr_frac", "warmdown_ratio", "warmup_ratio"))
