"""Matching and scoring over ``events``: errors of a user as truth, purchases as detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import spaced_out
from ..operators import matching as M
from .catalog import query, table

HOUR = 3600.0
SIDES = """gt AS (SELECT user_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS gt, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS gi FROM events WHERE event_type = 'error'),
    det AS (SELECT user_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS det, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS di FROM events WHERE event_type = 'purchase'),
    pairs AS (SELECT gt.user_id AS user_id, gi, di, abs(gt - det) AS dist FROM gt JOIN det ON gt.user_id = det.user_id AND abs(gt - det) <= 3600)"""
FILES = f"""{SIDES}, taken AS (SELECT user_id, len(list_reduce(list({{'g': [gi], 'd': [di]}} ORDER BY dist, gi, di), lambda a, z: CASE WHEN list_contains(a.g, z.g[1]) OR list_contains(a.d, z.d[1]) THEN a ELSE {{'g': list_concat(a.g, z.g), 'd': list_concat(a.d, z.d)}} END).g) AS tp FROM pairs GROUP BY user_id),
    files AS (SELECT coalesce(g.user_id, d.user_id) AS user_id, coalesce(tp, 0) AS tp, coalesce(nd, 0) - coalesce(tp, 0) AS fp, coalesce(ng, 0) - coalesce(tp, 0) AS fn
      FROM (SELECT user_id, count(*) AS ng FROM gt GROUP BY user_id) g FULL JOIN (SELECT user_id, count(*) AS nd FROM det GROUP BY user_id) d ON g.user_id = d.user_id LEFT JOIN taken t ON t.user_id = coalesce(g.user_id, d.user_id))"""


def seconds(ts="ts"):
    """Seconds since 1970 of a timestamp without zone."""
    return (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).cast("double")


def sides(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    side = lambda kind, t, i: M.ranked(e.where(F.col("event_type") == kind).select("user_id", seconds().alias(t)), "user_id", t, i)
    return side("error", "gt", "gi"), side("purchase", "det", "di")


@query(f"WITH {SIDES} SELECT user_id, gi, di, round(dist, 3) AS dist FROM pairs")
def range_pairs(spark, sf_dir):
    p = M.range_pairs(*sides(spark, sf_dir), tolerance=HOUR, key="user_id")
    return p.select("user_id", F.col("gi").cast("long").alias("gi"), F.col("di").cast("long").alias("di"), F.round("dist", 3).alias("dist"))


@query(f"WITH {FILES} SELECT user_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN fn = 0 AND fp = 0 THEN 'OK' ELSE 'MISS' END AS status FROM files")
def match_files(spark, sf_dir):
    return M.status(M.match(*sides(spark, sf_dir), tolerance=HOUR, key="user_id"))


@query(
    f"""WITH {FILES}, t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) AS files FROM files),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall FROM t)
    SELECT tp, fp, fn, files, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 9) AS f1, round(CASE WHEN files > 0 THEN CAST(fp AS DOUBLE) / files ELSE 0.0 END, 9) AS fp_rate FROM r"""
)
def match_eval(spark, sf_dir):
    x = M.metrics(M.match(*sides(spark, sf_dir), tolerance=HOUR, key="user_id"))
    return x.select("tp", "fp", "fn", "files", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "fp_rate")])


@query(
    """WITH u AS (SELECT user_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS t FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 FROM events WHERE event_type = 'view'),
    k AS (SELECT user_id, list_reduce(list([t] ORDER BY t), lambda a, z: CASE WHEN z[1] - a[-1] > 7200 THEN list_concat(a, z) ELSE a END) AS ts FROM u GROUP BY user_id)
    SELECT user_id, CAST(len(ts) AS BIGINT) AS n_kept, round(ts[1], 3) AS first_t, round(ts[-1], 3) AS last_t FROM k"""
)
def union_dedup(spark, sf_dir):
    """The bag union of two kinds of hits of a user, thinned to more than two hours after the last kept."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    hits = e.where("event_type = 'click'").unionByName(e.where("event_type = 'view'")).select("user_id", seconds().alias("t"))
    k = hits.groupBy("user_id").agg(spaced_out(F.collect_list("t"), 7200.0).alias("ts"))
    return k.select("user_id", F.size("ts").cast("long").alias("n_kept"), F.round(F.element_at("ts", 1), 3).alias("first_t"), F.round(F.element_at("ts", -1), 3).alias("last_t"))


@query(
    """SELECT event_id, k % 2 = 0 AS spliced, CAST(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_times, CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) END AS first_time, k % 3 AS tier
    FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
)
def json_cases(spark, sf_dir):
    """Cases from JSON: a time counts only for spliced cases."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    spliced = F.col("k") % 2 == 0
    times = F.when(spliced, F.array(F.col("k").cast("double"))).otherwise(F.array().cast("array<double>"))
    return e.select("event_id", spliced.alias("spliced"), F.size(times).cast("long").alias("n_times"), F.get(times, 0).alias("first_time"), (F.col("k") % 3).alias("tier"))
