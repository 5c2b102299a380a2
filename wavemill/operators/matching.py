"""Matching detections to ground truth within a tolerance, and scoring the matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio

TOLERANCE_S = 0.200


def range_pairs(truth: DataFrame, found: DataFrame, tolerance: float = TOLERANCE_S, key: str = "file_id") -> DataFrame:
    """key, gi, di, dist of all pairs with |gt - det| <= tolerance.

    ``truth`` has key, gi, gt and ``found`` key, di, det. Times fall into buckets a quarter wider than
    the tolerance; the truth is put into its own and both neighbours, so the join is an equi-join of
    key and bucket, and the exact predicate is applied to what meets. No bucket holds more than its
    time span, however long the file.
    """
    width = tolerance * 1.25
    bucket = lambda c: F.floor(F.col(c) / width)
    t = truth.withColumn("_b", F.explode(F.sequence(bucket("gt") - 1, bucket("gt") + 1)))
    d = found.withColumn("_b", bucket("det"))
    dist = F.abs(F.col("gt") - F.col("det"))
    return t.join(d, [key, "_b"]).where(dist <= tolerance).select(key, "gi", "di", dist.alias("dist"))


def assign(pairs: DataFrame, key: str = "file_id") -> DataFrame:
    """key, tp: pairs taken closest first (ties by gi, then di) while both sides are free."""
    none = F.array().cast("array<int>")
    item = F.struct("dist", F.col("gi").cast("int").alias("gi"), F.col("di").cast("int").alias("di"))

    def take(acc, z):
        free = ~F.array_contains(acc["g"], z["gi"]) & ~F.array_contains(acc["d"], z["di"])
        more = F.struct(F.concat(acc["g"], F.array(z["gi"])).alias("g"), F.concat(acc["d"], F.array(z["di"])).alias("d"))
        return F.when(free, more).otherwise(acc)

    start = F.struct(none.alias("g"), none.alias("d"))
    return pairs.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(item)), start, take, lambda a: F.size(a["g"]).cast("long")).alias("tp"))


def match(truth: DataFrame, found: DataFrame, tolerance: float = TOLERANCE_S, key: str = "file_id") -> DataFrame:
    """key, tp, fp, fn of every key that either side has."""
    n_gt = truth.groupBy(key).agg(F.count("*").alias("n_gt"))
    n_det = found.groupBy(key).agg(F.count("*").alias("n_det"))
    x = n_gt.join(n_det, key, "full").join(assign(range_pairs(truth, found, tolerance, key), key), key, "left").fillna(0, ["n_gt", "n_det", "tp"])
    return x.select(key, "tp", (F.col("n_det") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))


def ranked(times: DataFrame, key: str, t: str, index: str) -> DataFrame:
    """Number the times of each key from 0, ascending."""
    from pyspark.sql import Window

    return times.withColumn(index, F.row_number().over(Window.partitionBy(key).orderBy(t)) - 1)


def status(scores: DataFrame) -> DataFrame:
    """OK where every truth was found and nothing else, else MISS."""
    return scores.withColumn("status", F.when((F.col("fn") == 0) & (F.col("fp") == 0), "OK").otherwise("MISS"))


def metrics(scores: DataFrame, files: int | None = None) -> DataFrame:
    """One row: tp, fp, fn, files, precision, recall, f1, fp_rate, micro-averaged over the files."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    n = F.count("*") if files is None else F.lit(files)
    x = scores.agg(total("tp"), total("fp"), total("fn"), n.cast("long").alias("files"))
    x = x.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0)
    return x.withColumn("f1", f1).withColumn("fp_rate", ratio(F.col("fp"), F.col("files"), 0.0))
