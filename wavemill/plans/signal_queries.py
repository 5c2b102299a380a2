"""Signal operators over a signal view of ``events``: one channel a type, samples in time order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import curves as C
from .catalog import query, table

KEYS = ["ch"]
SIGNAL = "signal AS (SELECT event_type AS ch, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n, value AS x FROM events)"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    return e.select(F.col("event_type").alias("ch"), n.cast("long").alias("n"), F.col("value").alias("x"))


def r6(c, places: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, places)


@query("SELECT vec_id, CAST(len(embedding) / 2 AS BIGINT) AS n_samples, round(list_sum(list_transform(range(1, len(embedding), 2), lambda i: (CAST(embedding[i] AS DOUBLE) + CAST(embedding[i + 1] AS DOUBLE)) / 2)), 6) AS total FROM embeddings")
def downmix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    channel = lambda k: F.filter("v", lambda _, i: i % 2 == k)
    mono = S.mean_channels(F.array(channel(0), channel(1)))
    return e.select("vec_id", F.size(mono).cast("long").alias("n_samples"), r6(F.aggregate(mono, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"WITH {SIGNAL} SELECT ch, n, round((x - avg(x) OVER (PARTITION BY ch)) / stddev_pop(x) OVER (PARTITION BY ch), 6) AS z FROM signal")
def zscore(spark, sf_dir):
    return C.zscore(signal(spark, sf_dir), KEYS).select("ch", "n", r6("z").alias("z"))


@query(f"WITH {SIGNAL} SELECT ch, n, round(x - lag(x) OVER (PARTITION BY ch ORDER BY n), 6) AS d FROM signal")
def first_difference(spark, sf_dir):
    return C.difference(signal(spark, sf_dir), KEYS).select("ch", "n", r6("d").alias("d"))


@query(f"WITH {SIGNAL}, r AS (SELECT ch, n, sqrt(sum(x * x) OVER (PARTITION BY ch ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7) AS rms FROM signal) SELECT ch, n, round(20 * log10(greatest(rms, 1e-10)), 6) AS db, 20 * log10(greatest(rms, 1e-10)) > 36.0 AS loud FROM r")
def silence_mask(spark, sf_dir):
    x = C.moving_rms(signal(spark, sf_dir), KEYS, 7)
    return x.select("ch", "n", r6(S.decibel(F.col("rms"))).alias("db"), C.loud(F.col("rms"), 36.0).alias("loud"))


@query(
    f"""WITH {SIGNAL}, k AS (SELECT ch, n // 10 AS k, x, lead(x) OVER (PARTITION BY ch ORDER BY n) AS nx FROM signal WHERE n % 10 = 0)
    SELECT p.ch AS ch, p.n AS p, round(k.x + (p.n - k.k * 10) / CAST(10 AS DOUBLE) * (coalesce(k.nx, k.x) - k.x), 6) AS v,
    k.x + (p.n - k.k * 10) / CAST(10 AS DOUBLE) * (coalesce(k.nx, k.x) - k.x) > 50.0005 AS open
    FROM signal p JOIN k ON p.ch = k.ch AND p.n // 10 = k.k WHERE p.n % 3 = 0"""
)
def interpolated_gate(spark, sf_dir):
    x = C.interpolated(signal(spark, sf_dir), KEYS, every=10, at=3)
    return x.select("ch", "p", r6("v").alias("v"), (F.col("v") > 50.0005).alias("open"))


@query(f"WITH {SIGNAL}, c AS (SELECT ch, count(*) AS len FROM signal GROUP BY ch), s AS (SELECT ch, len, unnest(generate_series(0, len - 1, 50)) AS start FROM c) SELECT ch, start // 50 AS seg_no, start, least(60, len - start) AS size FROM s WHERE len - start >= 10")
def segment_tiles(spark, sf_dir):
    lengths = signal(spark, sf_dir).groupBy("ch").agg(F.count("*").alias("len"))
    return C.segments(lengths, KEYS, 60, 50, 10)


FRAMES = "frames AS (SELECT ch, f AS frame, list(x ORDER BY n) AS v FROM (SELECT ch, n, x, unnest(generate_series(CAST(greatest(0, ceil((n - {n} + 1) / CAST({h} AS DOUBLE))) AS BIGINT), n // {h})) AS f FROM signal) GROUP BY ch, f HAVING count(*) = {n})"
BINS = "bins AS (SELECT ch, frame, k, list_sum(list_transform(range(0, {n}), lambda i: v[i + 1] * cos(2 * pi() * k * i / {n}))) AS re, list_sum(list_transform(range(0, {n}), lambda i: v[i + 1] * sin(2 * pi() * k * i / {n}))) AS im FROM frames, (SELECT unnest(range(0, {m} + 1)) AS k))"


@query(f"WITH {SIGNAL}, {FRAMES.format(n=16, h=8)} SELECT ch, frame, round(list_sum(v), 6) AS total, v[1] AS first_x, v[16] AS last_x FROM frames")
def stft_frames(spark, sf_dir):
    x = C.frames(signal(spark, sf_dir), KEYS, 16, 8)
    return x.select("ch", "frame", r6(F.aggregate("v", F.lit(0.0), lambda a, b: a + b)).alias("total"), F.get("v", 0).alias("first_x"), F.get("v", 15).alias("last_x"))


@query(f"WITH {SIGNAL}, {FRAMES.format(n=16, h=16)}, {BINS.format(n=16, m=8)} SELECT ch, frame, k AS bin, round(re * re + im * im, 4) AS power FROM bins")
def dft_power(spark, sf_dir):
    x = C.frames(signal(spark, sf_dir), KEYS, 16, 16)
    x = x.select("ch", "frame", F.posexplode(S.power_of_dft(F.col("v"), 16)).alias("bin", "power"))
    return x.select("ch", "frame", F.col("bin").cast("long").alias("bin"), r6("power", 4).alias("power"))


def spectra(x: DataFrame, n: int, bins: range) -> DataFrame:
    """ch, frame, k, re, im of frames by the definition of the DFT."""
    part = lambda f, k: F.aggregate(F.zip_with("v", F.array(*[F.lit(f(2 * math.pi * k * i / n)) for i in range(n)]), lambda a, c: a * c), F.lit(0.0), lambda a, b: a + b)
    each = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), part(math.cos, k).alias("re"), part(math.sin, k).alias("im")) for k in bins])
    return x.select("ch", "frame", F.explode(each).alias("b")).select("ch", "frame", "b.k", "b.re", "b.im")


@query(
    f"""WITH {SIGNAL}, {FRAMES.format(n=8, h=4)}, {BINS.format(n=8, m=4)},
    ph AS (SELECT ch, frame, k, atan2(-im, re) AS p FROM bins WHERE k BETWEEN 1 AND 3),
    d AS (SELECT ch, frame, k, p - lag(p) OVER (PARTITION BY ch, k ORDER BY frame) + pi() AS t FROM ph),
    w AS (SELECT ch, frame, k, t - 2 * pi() * floor(t / (2 * pi())) - pi() - 2 * pi() * k * 4 / 8 + pi() AS t FROM d WHERE t IS NOT NULL),
    e AS (SELECT ch, frame, sum((t - 2 * pi() * floor(t / (2 * pi())) - pi()) ** 2) AS energy FROM w GROUP BY ch, frame)
    SELECT ch, frame, round(energy, 5) AS energy, round(abs(energy - lag(energy) OVER (PARTITION BY ch ORDER BY frame)), 5) AS jump FROM e"""
)
def phase_discontinuity(spark, sf_dir):
    """Energy of phase deviations from the advance that a steady tone would have, and its jumps."""
    b = spectra(C.frames(signal(spark, sf_dir), KEYS, 8, 4), 8, range(1, 4)).withColumn("p", F.atan2(-F.col("im"), "re"))
    step = F.col("p") - F.lag("p").over(Window.partitionBy("ch", "k").orderBy("frame"))
    b = b.withColumn("d", S.wrapped(step)).where("d is not null").withColumn("d", S.wrapped(F.col("d") - 2 * math.pi * F.col("k") * 4 / 8))
    e = b.groupBy("ch", "frame").agg(F.sum(F.col("d") * F.col("d")).alias("energy"))
    jump = F.abs(F.col("energy") - F.lag("energy").over(Window.partitionBy("ch").orderBy("frame")))
    return e.select("ch", "frame", r6("energy", 5).alias("energy"), r6(jump, 5).alias("jump"))


@query(
    f"""WITH {SIGNAL}, {FRAMES.format(n=8, h=4)}, {BINS.format(n=8, m=4)},
    d AS (SELECT ch, frame, k, abs(sqrt(re * re + im * im) - lag(sqrt(re * re + im * im)) OVER (PARTITION BY ch, k ORDER BY frame)) AS s FROM bins),
    m AS (SELECT ch, frame, s, greatest(median(s) OVER (PARTITION BY ch, frame), 1e-10) AS md FROM d WHERE s IS NOT NULL)
    SELECT ch, frame, round(CAST(count(*) FILTER (s > 4 * md) AS DOUBLE) / count(*), 6) AS ratio FROM m GROUP BY ch, frame"""
)
def broadband_change(spark, sf_dir):
    b = spectra(C.frames(signal(spark, sf_dir), KEYS, 8, 4), 8, range(5)).withColumn("m", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2))
    b = C.difference(b.withColumn("n", F.col("frame")), ["ch", "k"], "m", "s").where("s is not null")
    per = b.groupBy("ch", "frame").agg(F.collect_list(F.abs("s")).alias("s"))
    usual = F.greatest(S.median_of(F.col("s")), F.lit(1e-10))
    return per.withColumn("u", usual).select("ch", "frame", r6(F.size(F.filter("s", lambda v: v > 4 * F.col("u"))) / F.size("s")).alias("ratio"))


@query(
    f"""WITH {SIGNAL}, {FRAMES.format(n=16, h=16)}, {BINS.format(n=16, m=8)}, edges AS (SELECT * FROM (VALUES (0, 0.5, 1.5), (1, 1.5, 3.7), (2, 3.7, 8.5)) t(band, lo, hi))
    SELECT ch, frame, CAST(band AS BIGINT) AS band, round(10 * log10(greatest(sum(re * re + im * im), 1e-10)), 5) AS db FROM bins JOIN edges ON k >= lo AND k < hi GROUP BY ch, frame, band"""
)
def band_power(spark, sf_dir):
    """Bins summed into bands by lo <= k < hi, a join with the few edges."""
    edges = spark.createDataFrame([(0, 0.5, 1.5), (1, 1.5, 3.7), (2, 3.7, 8.5)], "band long, lo double, hi double")
    b = spectra(C.frames(signal(spark, sf_dir), KEYS, 16, 16), 16, range(9))
    x = b.join(F.broadcast(edges), (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi"))).groupBy("ch", "frame", "band").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("p"))
    return x.select("ch", "frame", "band", r6(S.decibel(F.col("p"), 10.0), 5).alias("db"))


# The vector of an embedding in p bands, each the mean of as many neighbouring components.
def banded(e: DataFrame, p: int) -> DataFrame:
    """label and p columns b0, b1, ..: means of 64 / p components each, of every vector."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    size = F.size(v) / p
    mean = lambda i: F.aggregate(F.slice(v, (F.floor(size * i) + 1).cast("int"), F.floor(size * (i + 1)).cast("int") - F.floor(size * i).cast("int")), F.lit(0.0), lambda a, x: a + x) / size
    return e.select(F.col("label").cast("long").alias("label"), *[mean(i).alias(f"b{i}") for i in range(p)])


def neighbours(e: DataFrame, p: int) -> DataFrame:
    """left_label, right_label, n1, n2, d (differences of means) and s (pooled covariances, upper half by rows).

    Moments of a label are sums that partial aggregation combines: 1 + p + p (p + 1) / 2 numbers a label.
    """
    b = banded(e, p)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    m = b.groupBy("label").agg(F.count("*").alias("n"), F.array(*[F.avg(f"b{i}") for i in range(p)]).alias("m"), F.array(*[F.coalesce(F.covar_samp(f"b{i}", f"b{j}"), F.lit(1e-6 if i == j else 0.0)) for i, j in pairs]).alias("c"))
    x, y = m.alias("x"), m.alias("y")
    pooled = F.zip_with("x.c", "y.c", lambda a, b: ((F.col("x.n") - 1) * a + (F.col("y.n") - 1) * b) / (F.col("x.n") + F.col("y.n") - 2))
    j = x.join(y, F.col("y.label") == F.col("x.label") + 1)
    return j.select(F.col("x.label").alias("left_label"), F.col("y.label").alias("right_label"), F.col("x.n").alias("n1"), F.col("y.n").alias("n2"), F.zip_with("x.m", "y.m", lambda a, b: a - b).alias("d"), pooled.alias("s"))


@query(
    """WITH v AS (SELECT label, list_avg(list_transform(embedding[1:len(embedding) // 2], lambda x: CAST(x AS DOUBLE))) AS a, list_avg(list_transform(embedding[len(embedding) // 2 + 1:], lambda x: CAST(x AS DOUBLE))) AS b FROM embeddings),
    s AS (SELECT label, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM v GROUP BY label),
    p AS (SELECT CAST(x.label AS BIGINT) AS left_label, CAST(y.label AS BIGINT) AS right_label, x.n AS n1, y.n AS n2, x.ma - y.ma AS da, x.mb - y.mb AS db,
      ((x.n - 1) * x.va + (y.n - 1) * y.va) / (x.n + y.n - 2) + 1e-6 AS a, ((x.n - 1) * x.vb + (y.n - 1) * y.vb) / (x.n + y.n - 2) + 1e-6 AS b, ((x.n - 1) * x.c + (y.n - 1) * y.c) / (x.n + y.n - 2) AS c
      FROM s x JOIN s y ON y.label = x.label + 1)
    SELECT left_label, right_label, round(n1 * n2 / CAST(n1 + n2 AS DOUBLE) * (b * da * da - 2 * c * da * db + a * db * db) / (a * b - c * c), 5) AS t2 FROM p"""
)
def hotelling(spark, sf_dir):
    """Two-sample T^2 between neighbouring labels in two bands of all components, in closed form."""
    p = neighbours(table(spark, sf_dir, "embeddings"), 2).selectExpr("left_label", "right_label", "n1", "n2", "d[0] AS da", "d[1] AS db", "s[0] + 1e-6D AS a", "s[2] + 1e-6D AS b", "s[1] AS c")
    t2 = F.expr("n1 * n2 / double(n1 + n2) * (b * da * da - 2 * c * da * db + a * db * db) / (a * b - c * c)")
    return p.select("left_label", "right_label", r6(t2, 5).alias("t2"))


@query(None)
def hotelling_bands(spark, sf_dir):
    """T^2 between neighbouring labels in eight bands of all components: moments by aggregation, one 8 x 8 solve a pair."""

    def solve(n1: pd.Series, n2: pd.Series, d: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for a, b, x, half in zip(n1, n2, d, s):
            m = np.zeros((len(x), len(x)))
            m[np.triu_indices(len(x))] = half
            m = m + np.triu(m, 1).T + 1e-6 * np.eye(len(x))
            out.append(max(0.0, a * b / (a + b) * float(x @ np.linalg.solve(m, x))))
        return pd.Series(out, dtype=float)

    t2 = F.pandas_udf(solve, "double")
    return neighbours(table(spark, sf_dir, "embeddings"), 8).select("left_label", "right_label", r6(t2("n1", "n2", "d", "s"), 5).alias("t2"))


@query(f"WITH {SIGNAL}, z AS (SELECT ch, (x - avg(x) OVER (PARTITION BY ch)) / stddev_pop(x) OVER (PARTITION BY ch) AS z FROM signal) SELECT ch, round(greatest(quantile_cont(z, 0.999), CAST(4.0 AS DOUBLE)), 6) AS threshold, count(*) AS n FROM z GROUP BY ch")
def percentile_threshold(spark, sf_dir):
    z = C.zscore(signal(spark, sf_dir), KEYS)
    return z.groupBy("ch").agg(r6(F.greatest(F.percentile("z", F.lit(0.999)), F.lit(4.0))).alias("threshold"), F.count("*").alias("n"))


# A series for each user: short ones, some under 50 samples.
@query(
    """WITH s AS (SELECT user_id, value AS x, count(*) OVER (PARTITION BY user_id) AS c, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS r FROM events),
    a AS (SELECT *, (c - 1) * CAST(0.95 AS DOUBLE) AS p, (c - 1) * (1 - least(CAST(2.0 AS DOUBLE) / c, CAST(1.0 AS DOUBLE))) AS q FROM s),
    u AS (SELECT user_id, any_value(c) AS c, max(x) AS m, max(x) FILTER (r = floor(p)) + (any_value(p) - floor(any_value(p))) * (max(x) FILTER (r = ceil(p)) - max(x) FILTER (r = floor(p))) AS u,
      max(x) FILTER (r = floor(q)) + (any_value(q) - floor(any_value(q))) * (max(x) FILTER (r = ceil(q)) - max(x) FILTER (r = floor(q))) AS f FROM a GROUP BY user_id),
    e AS (SELECT u.user_id, count(*) FILTER (s.x > u.u) AS n FROM u JOIN s ON s.user_id = u.user_id GROUP BY 1)
    SELECT u.user_id AS user_id, e.n AS n_exceed, round(CASE WHEN c < 50 THEN m + 1 WHEN e.n < 10 THEN f END, 6) AS threshold FROM u JOIN e ON e.user_id = u.user_id"""
)
def tail_fallback(spark, sf_dir):
    """The guards of the tail threshold for each user's series: under 50 scores the maximum and 1, under 10 exceedances a percentile; null is left to the fit."""
    s = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("x"))
    u = s.groupBy("user_id").agg(F.count("*").alias("c"), F.max("x").alias("m"), F.percentile("x", F.lit(0.95)).alias("u"), F.sort_array(F.collect_list("x")).alias("v"))
    at = (F.col("c") - 1) * (1 - F.least(2.0 / F.col("c"), F.lit(1.0)))
    value = lambda k: F.get("v", k.cast("int"))
    f = value(F.floor(at)) + (at - F.floor(at)) * (value(F.ceil(at)) - value(F.floor(at)))
    n = F.size(F.filter("v", lambda y: y > F.col("u"))).cast("long")
    return u.select("user_id", n.alias("n_exceed"), r6(F.when(F.col("c") < 50, F.col("m") + 1).when(n < 10, f)).alias("threshold"))


@query(None)
def tail_threshold(spark, sf_dir):
    """The fitted tail threshold of each channel's z-scores, with 2 expected exceedances.

    Only what lies over the 95th percentile is gathered for the fit.
    """
    from ..functions.kernels import tail_limit

    z = C.zscore(signal(spark, sf_dir), KEYS)
    u = z.groupBy("ch").agg(F.count("*").alias("many"), F.max("z").alias("top"), F.percentile("z", F.lit(0.95)).alias("u"))
    over = z.join(u, "ch").where("z > u or z = top")

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        e = p.z[p.z > p.u.iloc[0]].to_numpy() - p.u.iloc[0]
        return pd.DataFrame({"ch": p.ch[:1], "threshold": [tail_limit(e, float(p.u.iloc[0]), int(p.many.iloc[0]), float(p.top.iloc[0]), int(p.many.iloc[0]), 2.0)]})

    return over.groupBy("ch").applyInPandas(fit, "ch string, threshold double")


PEAKS = f"""{SIGNAL}, q AS (SELECT ch, n, floor(x / 10) AS x FROM signal), nw AS (SELECT ch, n, x, CASE WHEN lag(x) OVER w IS NULL OR lag(x) OVER w <> x THEN 1 ELSE 0 END AS nw FROM q WINDOW w AS (PARTITION BY ch ORDER BY n)),
    rn AS (SELECT ch, n, x, sum(nw) OVER (PARTITION BY ch ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM nw), g AS (SELECT ch, run, min(x) AS x, min(n) AS l, max(n) AS r FROM rn GROUP BY ch, run),
    e AS (SELECT *, lag(x) OVER (PARTITION BY ch ORDER BY run) AS b, lead(x) OVER (PARTITION BY ch ORDER BY run) AS a FROM g), peaks AS (SELECT ch, CAST((l + r) // 2 AS INTEGER) AS n, x FROM e WHERE b < x AND a < x)"""


def coarse(spark, sf_dir) -> DataFrame:
    return signal(spark, sf_dir).withColumn("x", F.floor(F.col("x") / 10).cast("double"))


@query(f"WITH {PEAKS} SELECT ch, n, x FROM peaks")
def local_maxima(spark, sf_dir):
    return C.local_maxima(coarse(spark, sf_dir), KEYS)


@query(f"WITH {PEAKS}, k AS (SELECT ch, list_reduce(list([n] ORDER BY x DESC, n), lambda a, z: CASE WHEN len(list_filter(a, lambda j: abs(j - z[1]) < 20)) > 0 THEN a ELSE list_concat(a, z) END) AS ks FROM peaks WHERE x >= 8 GROUP BY ch) SELECT ch, unnest(ks) AS n FROM k")
def peak_suppression(spark, sf_dir):
    return C.suppressed(C.local_maxima(coarse(spark, sf_dir), KEYS).where("x >= 8"), KEYS, 20)


@query(
    f"""WITH {PEAKS}, p AS (SELECT ch, n, x AS h FROM peaks WHERE x >= 15), hi AS (SELECT p.ch, p.n, max(q.n) FILTER (q.n < p.n) AS lb, min(q.n) FILTER (q.n > p.n) AS rb FROM p LEFT JOIN q ON p.ch = q.ch AND q.x > p.h GROUP BY p.ch, p.n)
    SELECT p.ch AS ch, CAST(p.n AS BIGINT) AS n, any_value(h) - greatest(min(q.x) FILTER (q.n <= p.n AND (lb IS NULL OR q.n > lb)), min(q.x) FILTER (q.n >= p.n AND (rb IS NULL OR q.n < rb))) AS prominence FROM p JOIN hi ON p.ch = hi.ch AND p.n = hi.n JOIN q ON q.ch = p.ch GROUP BY p.ch, p.n"""
)
def peak_prominence(spark, sf_dir):
    """Prominences of all peaks of 15 or more, with bases as far out as the series goes."""
    x = coarse(spark, sf_dir)
    return C.prominences(x, C.local_maxima(x, KEYS).where("x >= 15"), KEYS)


@query(f"WITH {PEAKS} SELECT ch, n, x FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY x DESC, n) AS r FROM peaks) WHERE r <= 2")
def top_two(spark, sf_dir):
    return C.strongest(C.local_maxima(coarse(spark, sf_dir), KEYS), KEYS, 2)


@query(
    f"""WITH {SIGNAL}, s AS (SELECT ch, n, sqrt(avg(x * x) OVER (PARTITION BY ch ORDER BY n ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) AS l, sqrt(avg(x * x) OVER (PARTITION BY ch ORDER BY n ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) AS r,
    count(*) OVER (PARTITION BY ch ORDER BY n ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS cl, count(*) OVER (PARTITION BY ch ORDER BY n ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS cr FROM signal)
    SELECT ch, n, round(20 * log10(greatest(l, 1e-10)), 5) AS left_db, round(20 * log10(greatest(r, 1e-10)), 5) AS right_db FROM s WHERE cl >= 2 AND cr >= 2 AND 20 * log10(greatest(l, 1e-10)) > 36.0 AND 20 * log10(greatest(r, 1e-10)) > 36.0"""
)
def quiet_side_reject(spark, sf_dir):
    """Samples stay whose ten samples before and after are both loud."""
    w = C.over(KEYS)
    left, right = w.rowsBetween(-10, -1), w.rowsBetween(0, 9)
    sq = F.col("x") * F.col("x")
    x = signal(spark, sf_dir).withColumns({"l": S.decibel(F.sqrt(F.avg(sq).over(left))), "r": S.decibel(F.sqrt(F.avg(sq).over(right))), "cl": F.count("x").over(left), "cr": F.count("x").over(right)})
    return x.where("cl >= 2 and cr >= 2 and l > 36.0 and r > 36.0").select("ch", "n", r6("l", 5).alias("left_db"), r6("r", 5).alias("right_db"))


def _biquad(sr: int, cut: float = 2000.0) -> tuple[float, float, float]:
    k = math.tan(math.pi * cut / sr)
    n = 1 / (1 + math.sqrt(2) * k + k * k)
    return n, 2 * (k * k - 1) * n, (1 - math.sqrt(2) * k + k * k) * n


B0, A1, A2 = _biquad(16000)
TILE = 64


@query(
    f"""WITH RECURSIVE {SIGNAL}, f AS (SELECT ch, n, CAST({B0!r} AS DOUBLE) * x AS y, CAST({-2 * B0!r} AS DOUBLE) * x - CAST({A1!r} AS DOUBLE) * CAST({B0!r} AS DOUBLE) * x AS s1, CAST({B0!r} AS DOUBLE) * x - CAST({A2!r} AS DOUBLE) * CAST({B0!r} AS DOUBLE) * x AS s2 FROM signal WHERE n % {TILE} = 0
    UNION ALL SELECT s.ch, s.n, CAST({B0!r} AS DOUBLE) * s.x + f.s1, CAST({-2 * B0!r} AS DOUBLE) * s.x - CAST({A1!r} AS DOUBLE) * (CAST({B0!r} AS DOUBLE) * s.x + f.s1) + f.s2, CAST({B0!r} AS DOUBLE) * s.x - CAST({A2!r} AS DOUBLE) * (CAST({B0!r} AS DOUBLE) * s.x + f.s1) FROM f JOIN signal s ON s.ch = f.ch AND s.n = f.n + 1 WHERE s.n % {TILE} <> 0),
    d AS (SELECT ch, n // {TILE} AS tile, n - 1 AS n, abs(y - lag(y) OVER (PARTITION BY ch, n // {TILE} ORDER BY n)) AS d FROM f)
    SELECT ch, tile, n, round(d, 6) AS steepest FROM (SELECT *, row_number() OVER (PARTITION BY ch, tile ORDER BY round(d, 9) DESC, n) AS r FROM d WHERE d IS NOT NULL) WHERE r = 1"""
)
def steepest_sample(spark, sf_dir):
    """The steepest step of each tile of every series, high-passed from rest; the filter is a fold over the tile."""
    s = signal(spark, sf_dir).withColumn("tile", F.floor(F.col("n") / TILE))
    s = s.groupBy("ch", "tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda v: v["x"]).alias("v"))
    start = F.expr("named_struct('y', cast(array() as array<double>), 's1', 0.0D, 's2', 0.0D)")

    def step(acc, x):
        y = B0 * x + acc["s1"]
        return F.struct(F.concat(acc["y"], F.array(y)).alias("y"), (-2 * B0 * x - A1 * y + acc["s2"]).alias("s1"), (B0 * x - A2 * y).alias("s2"))

    y = F.aggregate("v", start, step, lambda a: a["y"])
    s = s.where(F.size("v") > 1).select("ch", "tile", y.alias("y")).select("ch", "tile", F.zip_with(F.slice("y", 2, F.size("y") - 1), F.slice("y", 1, F.size("y") - 1), lambda b, a: F.abs(b - a)).alias("d"))
    best = F.array_min(F.transform("d", lambda d, i: F.struct((-F.round(d, 9)).alias("m"), i.alias("i"), d.alias("d"))))
    return s.withColumn("b", best).select("ch", "tile", (F.col("tile") * TILE + F.col("b.i")).alias("n"), r6("b.d").alias("steepest"))
