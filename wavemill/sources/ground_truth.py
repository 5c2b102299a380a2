"""Labelled cases from a JSON document keyed by case name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CASE_JSON


def parse_cases(texts: DataFrame, data_dir: str, value: str = "value") -> DataFrame:
    """name, path, spliced, gt_times (ascending), tier of every case in the JSON texts.

    A time is a number or a list of numbers, and counts only where spliced is true; tier is 0 if missing.
    """
    c = texts.select(F.explode(F.from_json(value, CASE_JSON)).alias("name", "c"))
    t = F.col("c.splice_time_sec")
    times = F.coalesce(F.try_variant_get(t, "$", "array<double>"), F.array(F.try_variant_get(t, "$", "double")))
    times = F.array_sort(F.filter(F.coalesce(times, F.array().cast("array<double>")), lambda x: x.isNotNull()))
    spliced = F.coalesce("c.spliced", F.lit(False))
    return c.select("name", F.concat_ws("/", F.lit(data_dir.rstrip("/")), F.col("c.path")).alias("path"), spliced.alias("spliced"), F.when(spliced, times).otherwise(F.array().cast("array<double>")).alias("gt_times"), F.coalesce("c.tier", F.lit(0)).alias("tier"))


def load_ground_truth(spark: SparkSession, data_dir: str) -> DataFrame:
    where = f"{data_dir.rstrip('/')}/ground_truth.json"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"no ground truth at {where}")
    return parse_cases(spark.read.text(where, wholetext=True), data_dir)
