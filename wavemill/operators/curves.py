"""Operators on score curves and sampled signals in rows: series keys, an index n, a value x.

Windows are partitioned by the series (file and segment), so work is spread over segments.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import decibel

STRETCHES = 1 << 18


def over(keys: list[str], n: str = "n"):
    return Window.partitionBy(*keys).orderBy(n)


def zscore(df: DataFrame, keys: list[str], x: str = "x", out: str = "z") -> DataFrame:
    """(x - mean) / population deviation of the series; 0 if that is under 1e-8."""
    stats = df.groupBy(*keys).agg(F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd"))
    z = F.when(F.col("_sd") < 1e-8, 0.0).otherwise((F.col(x) - F.col("_mean")) / F.col("_sd"))
    return df.join(stats, keys).withColumn(out, z).drop("_mean", "_sd")


def difference(df: DataFrame, keys: list[str], x: str = "x", out: str = "d") -> DataFrame:
    return df.withColumn(out, F.col(x) - F.lag(x).over(over(keys)))


def moving_rms(df: DataFrame, keys: list[str], width: int, x: str = "x", out: str = "rms") -> DataFrame:
    """RMS of ``width`` samples around each, zeros outside: the sum is divided by the width."""
    w = over(keys).rowsBetween(-(width // 2), width - 1 - width // 2)
    return df.withColumn(out, F.sqrt(F.sum(F.col(x) * F.col(x)).over(w) / width))


def loud(rms: Column, threshold_db: float) -> Column:
    return decibel(rms) > threshold_db


def interpolated(df: DataFrame, keys: list[str], every: int, at: int, x: str = "x") -> DataFrame:
    """keys, p, v: the curve through every ``every``-th sample, read at every ``at``-th, held at its end."""
    knots = df.where(F.col("n") % every == 0).select(*keys, (F.col("n") / every).cast("long").alias("k"), x)
    knots = knots.withColumn("next", F.lead(x, 1).over(over(keys, "k")))
    points = df.where(F.col("n") % at == 0).select(*keys, F.col("n").alias("p"), F.floor(F.col("n") / every).alias("k"))
    part = (F.col("p") - F.col("k") * every) / every
    return points.join(knots, [*keys, "k"]).select(*keys, "p", (F.col(x) + part * (F.coalesce("next", x) - F.col(x))).alias("v"))


def frames(df: DataFrame, keys: list[str], size: int, hop: int, x: str = "x") -> DataFrame:
    """keys, frame, v: arrays of ``size`` samples that start every ``hop``; whole frames only.

    A sample is sent to the frames that hold it, so a long series needs no array of all its samples.
    """
    last = F.floor(F.col("n") / hop)
    first = F.greatest(F.ceil((F.col("n") - size + 1) / hop), F.lit(0))
    x_ = df.where(first <= last).select(*keys, "n", x, F.explode(F.sequence(first, last)).alias("frame"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("n", x))), lambda s: s[x])
    return x_.groupBy(*keys, "frame").agg(v.alias("v")).where(F.size("v") == size)


def segments(lengths: DataFrame, keys: list[str], window: int, step: int, shortest: int, n: str = "len") -> DataFrame:
    """keys, seg_no, start, size: overlapping tiles; one shorter than ``shortest`` ends the tiling."""
    starts = F.filter(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(step).cast("long")), lambda p: F.col(n) - p >= shortest)
    x = lengths.select(*keys, n, F.posexplode(starts).alias("seg_no", "start"))
    return x.select(*keys, F.col("seg_no").cast("long").alias("seg_no"), "start", F.least(F.lit(window), F.col(n) - F.col("start")).alias("size"))


def local_maxima(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """keys, n, x of peaks: runs of equal values higher than both neighbours, at their middle, rounded down."""
    w = over(keys)
    new = F.when(F.lag(x).over(w).isNull() | (F.lag(x).over(w) != F.col(x)), 1).otherwise(0)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*keys, "_run").agg(F.min(x).alias(x), F.min("n").alias("l"), F.max("n").alias("r"))
    by = over(keys, "_run")
    runs = runs.withColumn("_b", F.lag(x).over(by)).withColumn("_a", F.lead(x).over(by))
    return runs.where((F.col("_b") < F.col(x)) & (F.col("_a") < F.col(x))).select(*keys, F.floor((F.col("l") + F.col("r")) / 2).cast("int").alias("n"), x)


def suppressed(peaks: DataFrame, keys: list[str], distance: int, x: str = "x") -> DataFrame:
    """keys, n of peaks with no higher kept peak nearer than ``distance``; equal heights go by index.

    A gap of ``distance`` or more cuts a series into stretches that do not touch one another. Those that
    start in the same ``STRETCHES`` samples are one group; only a stretch without a gap is a group of any size.
    """
    from ..functions.kernels import apart

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("n")
        return p.loc[apart(p["n"].to_numpy(), p["x"].to_numpy(np.float64), distance), [*keys, "n"]]

    w = over(keys)
    back = F.col("n") - F.lag("n").over(w)
    cut = peaks.select(*keys, "n", F.col(x).alias("x")).withColumn("_start", F.when(back.isNull() | (back >= distance), F.col("n")))
    start = F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("_group", F.floor(start / STRETCHES)).drop("_start")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields if f.name in (*keys, "n"))
    return cut.groupBy(*keys, "_group").applyInPandas(run, kinds)


def prominences(df: DataFrame, peaks: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """keys, n, prominence: a peak's height over the higher of its two bases.

    A base is the lowest value on the way to the next higher one, or to the end of the series, however
    far that is; so a series is one task's work, in one pass each way.
    """
    from ..functions.kernels import lowest_before_higher

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("n")
        v, top = p["x"].to_numpy(np.float64), p["top"].to_numpy(bool)
        base = np.maximum(lowest_before_higher(v), lowest_before_higher(v[::-1])[::-1])
        return p.loc[top, [*keys, "n"]].assign(prominence=(v - base)[top])

    marked = df.select(*keys, "n", F.col(x).alias("x")).join(peaks.select(*keys, F.col("n").cast("long").alias("n"), F.lit(True).alias("top")), [*keys, "n"], "left").fillna(False, ["top"])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema.fields if f.name in (*keys, "n"))
    return marked.groupBy(*keys).applyInPandas(run, f"{kinds}, prominence double")


def strongest(df: DataFrame, keys: list[str], k: int, x: str = "x") -> DataFrame:
    """The k highest rows of each series, ties to the lower index."""
    w = Window.partitionBy(*keys).orderBy(F.desc(x), "n")
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
