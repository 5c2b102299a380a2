"""Experiment logs and run telemetry, over ``orders``, ``events`` and texts in their place.

``orders`` is one log a market segment: o_orderkey numbers the experiments, o_totalprice is the metric
(lower is better), o_orderstatus the outcome: F keep, O discard, P crash, and of keys divisible by 97
missing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import ratio, shortened, status
from ..operators import telemetry as T
from ..operators.experiments import Log
from .catalog import query, table

LOG = """log AS (SELECT c_mktsegment AS series, o_orderkey AS exp_no, o_totalprice AS metric, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'KEEP' WHEN o_orderstatus = 'O' THEN 'DISCARD' ELSE 'CRASH' END AS status
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
VALID = "valid AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY exp_no) - 1 AS idx FROM log WHERE status IS DISTINCT FROM 'CRASH')"


def log(spark, sf_dir) -> Log:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    outcome = F.when(F.col("o_orderkey") % 97 == 0, None).when(F.col("o_orderstatus") == "F", "KEEP").when(F.col("o_orderstatus") == "O", "DISCARD").otherwise("CRASH")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("series"), F.col("o_orderkey").alias("exp_no"), F.col("o_totalprice").alias("metric"), outcome.alias("status"))
    return Log(x, "metric", True, ["series"])


@query(r"SELECT upper(regexp_replace(p, '^\s+|\s+$', '', 'g')) AS status, count(*) AS n, count(TRY_CAST(p AS DOUBLE)) AS numbers FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN '  ' || lower(o_orderpriority) || chr(9) ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 89 <> 0) GROUP BY 1")
def text_norm_counts(spark, sf_dir):
    """Statuses padded with blanks and tabs, normalised and counted; a missing one is not counted."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    padded = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit("\t"))).otherwise(F.col("o_orderpriority"))
    x = o.select(F.when(F.col("o_orderkey") % 89 != 0, padded).alias("p")).where("p is not null")
    return x.groupBy(status(F.col("p")).alias("status")).agg(F.count("*").alias("n"), F.count(F.col("p").try_cast("double")).alias("numbers"))


@query(f"WITH {LOG} SELECT series, status, count(*) AS n FROM log WHERE status IS NOT NULL GROUP BY series, status")
def outcomes(spark, sf_dir):
    return log(spark, sf_dir).outcomes()


@query(f"WITH {LOG}, c AS (SELECT series, count(*) AS total, count(*) FILTER (status = 'KEEP') AS n_keep, count(*) FILTER (status = 'DISCARD') AS n_discard, count(*) FILTER (status = 'CRASH') AS n_crash FROM log GROUP BY series) SELECT *, round(CASE WHEN n_keep + n_discard > 0 THEN CAST(n_keep AS DOUBLE) / (n_keep + n_discard) END, 9) AS keep_rate FROM c")
def keep_rate(spark, sf_dir):
    return log(spark, sf_dir).keep_rate().withColumn("keep_rate", F.round("keep_rate", 9))


@query(f"WITH {LOG} SELECT series, exp_no, round(metric, 6) AS metric FROM log WHERE status = 'KEEP'")
def kept_listing(spark, sf_dir):
    return log(spark, sf_dir).kept().select("series", "exp_no", F.round("metric", 6).alias("metric"))


@query(f"WITH {LOG}, {VALID} SELECT series, idx, metric, min(metric) OVER (PARTITION BY series ORDER BY idx ROWS UNBOUNDED PRECEDING) AS best FROM valid WHERE status = 'KEEP'")
def frontier(spark, sf_dir):
    return log(spark, sf_dir).frontier().select("series", F.col("idx").cast("long").alias("idx"), "metric", "best")


@query(f"WITH {LOG}, {VALID}, b AS (SELECT *, first_value(metric) OVER (PARTITION BY series ORDER BY idx) AS baseline FROM valid) SELECT series, idx, status, metric, baseline FROM b WHERE metric <= baseline + CAST(0.0005 AS DOUBLE)")
def near_baseline(spark, sf_dir):
    return log(spark, sf_dir).near_baseline().select("series", F.col("idx").cast("long").alias("idx"), "status", "metric", "baseline")


@query(
    f"""WITH {LOG}, s AS (SELECT series, arg_min(metric, exp_no) AS baseline, min(metric) FILTER (status = 'KEEP') AS best FROM log GROUP BY series),
    e AS (SELECT s.series, baseline, best, min(exp_no) AS best_exp FROM s JOIN log ON s.series = log.series AND metric = best AND status = 'KEEP' GROUP BY ALL)
    SELECT series, baseline, best, best_exp, round(baseline - best, 6) AS improvement, round((baseline - best) / baseline * 100, 6) AS percent, round((baseline - best) * CAST(0.15 AS DOUBLE), 6) AS margin FROM e"""
)
def best_row(spark, sf_dir):
    x = log(spark, sf_dir).summary()
    return x.select("series", "baseline", "best", "best_exp", *[F.round(c, 6).alias(c) for c in ("improvement", "percent", "margin")])


@query(
    f"""WITH {LOG}, k AS (SELECT series, exp_no, metric, lag(metric) OVER (PARTITION BY series ORDER BY exp_no) AS prev, row_number() OVER (PARTITION BY series ORDER BY exp_no) AS n FROM log WHERE status = 'KEEP'), h AS (SELECT *, prev - metric AS delta FROM k WHERE n > 1)
    SELECT series, exp_no, round(delta, 6) AS delta, row_number() OVER (PARTITION BY series ORDER BY delta DESC NULLS LAST, exp_no) AS rank, round(sum(delta) OVER (PARTITION BY series), 4) AS total FROM h"""
)
def hits_ranked(spark, sf_dir):
    x = log(spark, sf_dir).hits()
    return x.select("series", "exp_no", F.round("delta", 6).alias("delta"), F.col("rank").cast("long").alias("rank"), F.round("total", 4).alias("total"))


@query(
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN value END AS m FROM events), b AS (SELECT *, max(m) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e)
    SELECT user_id, event_id, CASE WHEN m IS NULL THEN 'crash' WHEN best IS NULL OR m > best THEN 'keep' ELSE 'discard' END AS label FROM b"""
)
def hillclimb(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("exp_no"), F.when(F.col("event_type") != "error", F.col("value")).alias("m"))
    return Log(e, "m", False, ["user_id"]).labelled().select("user_id", F.col("exp_no").alias("event_id"), "label")


@query(r"SELECT conv_id, turn, CASE WHEN length(t) > 45 THEN substr(t, 1, 42) || '...' ELSE t END AS label FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)")
def label_trunc(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", shortened(F.col("text")).alias("label"))


@query(
    r"""WITH l AS (SELECT conv_id, turn, 'splice_f1: 0.' || lpad(CAST(length(text) AS VARCHAR), 6, '0') || chr(10) || 'note' || chr(10) || 'elapsed: ' || CAST(turn * 31 AS VARCHAR) || '.5s' AS body FROM conversations)
    SELECT conv_id, turn, CAST(regexp_extract(body, '(?m)^splice_f1:\s*(\S+)', 1) AS DOUBLE) AS f1, CAST(regexp_extract(body, '(?m)^elapsed:\s*([0-9.]+)s', 1) AS DOUBLE) AS elapsed,
    CASE WHEN turn * 31 + 0.5 > 90 THEN 'crash' WHEN turn * 31 + 0.5 < 60 THEN 'ok' ELSE 'slow' END AS verdict FROM l"""
)
def log_grep(spark, sf_dir):
    """Metrics out of run logs made from conversations, and the verdict on their time."""
    from ..operators.experiments import within_budget
    from ..sources.logs import metric_of

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    body = F.concat(F.lit("splice_f1: 0."), F.lpad(F.length("text").cast("string"), 6, "0"), F.lit("\nnote\nelapsed: "), (F.col("turn") * 31).cast("string"), F.lit(".5s"))
    x = c.select("conv_id", "turn", body.alias("b")).select("conv_id", "turn", metric_of("b", "splice_f1").alias("f1"), metric_of("b", "elapsed").alias("elapsed"))
    return within_budget(x)


STEPS = "steps AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, count(*) OVER (PARTITION BY user_id) AS n, value FROM events)"


def steps(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return e.select("user_id", (F.row_number().over(w.orderBy("event_id")) - 1).cast("long").alias("step"), F.count("*").over(w).alias("n"), "value")


@query(
    f"""WITH {STEPS}, p AS (SELECT *, CAST(step AS DOUBLE) / n AS pr FROM steps) SELECT user_id, step, round(CASE WHEN pr < CAST(0.1 AS DOUBLE) THEN pr / CAST(0.1 AS DOUBLE) WHEN pr < 1.0 - CAST(0.5 AS DOUBLE) THEN 1.0 ELSE (1.0 - pr) / 0.5 + (1.0 - (1.0 - pr) / 0.5) * 0.05 END, 9) AS lr,
    round((1 - least(step / CAST(300 AS DOUBLE), 1.0)) * 0.85 + least(step / CAST(300 AS DOUBLE), 1.0) * 0.95, 9) AS momentum, round(0.2 * (1 - pr), 9) AS decay FROM p"""
)
def lr_schedule(spark, sf_dir):
    x = steps(spark, sf_dir).withColumn("pr", F.col("step") / F.col("n"))
    return x.select("user_id", "step", F.round(T.lr_multiplier(F.col("pr"), 0.1, 0.5, 0.05), 9).alias("lr"), F.round(T.momentum(F.col("step")), 9).alias("momentum"), F.round(T.weight_decay(F.col("pr"), 0.2), 9).alias("decay"))


@query(
    f"""WITH {STEPS}, l AS (SELECT user_id, list(value ORDER BY step) AS v FROM steps GROUP BY user_id)
    SELECT user_id, round(list_reduce(list_concat([CAST(0.0 AS DOUBLE)], v), lambda a, x: a * CAST(0.9 AS DOUBLE) + (1 - CAST(0.9 AS DOUBLE)) * x) / (1 - pow(CAST(0.9 AS DOUBLE), len(v))), 6) AS ema FROM l"""
)
def ema_loss(spark, sf_dir):
    v = F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda s: s["value"])
    return steps(spark, sf_dir).groupBy("user_id").agg(v.alias("v")).select("user_id", F.round(T.ema(F.col("v")), 6).alias("ema"))


@query(f"WITH {STEPS}, e AS (SELECT user_id, step, value, sum(CASE WHEN step > 10 THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS el FROM steps) SELECT user_id, step, round(el, 6) AS elapsed, round(least(el / 3000.0, 1.0) * 100, 6) AS pct, CAST(floor(524288 / value) AS BIGINT) AS tok_per_sec, round(100 * 1e9 * (524288 / value) / 989.5e12, 9) AS mfu, round(greatest(0.0, 3000.0 - el), 6) AS remaining_s FROM e WHERE value > 0")
def progress_figures(spark, sf_dir):
    x = T.running_time(steps(spark, sf_dir).withColumnRenamed("value", "dt"), series=["user_id"]).where("dt > 0")
    x = T.progress_figures(x, 524288, 1e9, 989.5e12, 3000.0)
    return x.select("user_id", "step", F.round("elapsed", 6).alias("elapsed"), F.round("pct", 6).alias("pct"), "tok_per_sec", F.round("mfu", 9).alias("mfu"), F.round("remaining_s", 6).alias("remaining_s"))


@query("SELECT CAST(i AS INTEGER) AS layer, CAST(CASE WHEN substr('SSSL', i % 4 + 1, 1) = 'L' OR i = 7 THEN 2048 ELSE 1024 END AS INTEGER) AS window, i % 2 = 1 AS has_value_embedding FROM (SELECT unnest(range(0, 8)) AS i)")
def layer_windows(spark, sf_dir):
    return T.layers(spark, 8, "SSSL", 2048)


@query("SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS numel, CAST(ceil(max(p_size) / CAST(2 AS DOUBLE)) * 128 AS BIGINT) AS width, round(pow(ceil(max(p_size) / CAST(2 AS DOUBLE)) * 128 / 768.0, CAST(-0.5 AS DOUBLE)), 9) AS lr_scale FROM part GROUP BY p_brand")
def parameter_groups(spark, sf_dir):
    """Sizes by group, the width that a depth is rounded up to, and the rate that goes with it."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.sum("p_size").alias("numel"), F.max("p_size").alias("depth"))
    width = F.ceil(F.col("depth") * 64 / 128) * 128
    return p.select("brand", "numel", width.alias("width"), F.round(T.lr_scale(width), 9).alias("lr_scale"))


@query("SELECT (SELECT CAST(6 * sum(CASE WHEN p_size > 10 THEN p_size ELSE 0 END) AS BIGINT) FROM part) + CAST(12 * 4 * 128 * (6 * 1024 + 2 * 2048) AS BIGINT) AS flops")
def flops_per_token(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("numel"), (F.col("p_size") > 10).alias("counted"))
    return T.flops_per_token(parts, T.layers(spark, 8, "SSSL", 2048), 4, 128)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))) / len(embedding)))), 5) AS total FROM embeddings")
def rms_norm(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rms = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) / F.size("v"))
    return e.withColumn("r", rms).select("vec_id", F.round(F.aggregate(F.transform("v", lambda x: x / F.col("r")), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT event_type, count(*) FILTER (value > 100) AS failed, round(CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (value > 100) AS DOUBLE) / count(*) END, 9) AS failed_share FROM events GROUP BY event_type")
def failed_steps(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(T.failed(F.col("value"))).alias("failed"), F.count("*").alias("n"))
    return e.select("event_type", "failed", F.round(ratio(F.col("failed"), F.col("n")), 9).alias("failed_share"))


BUDGET = f"{STEPS}, e AS (SELECT user_id, step, value, sum(CASE WHEN step > 10 THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS el FROM steps), b AS (SELECT *, lag(el) OVER (PARTITION BY user_id ORDER BY step) AS before FROM e), made AS (SELECT * FROM b WHERE NOT (step - 1 > 10 AND coalesce(before, 0) >= 1500.0))"


def made(spark, sf_dir):
    return T.until_budget(T.running_time(steps(spark, sf_dir).withColumnRenamed("value", "dt"), series=["user_id"]), 1500.0, series=["user_id"])


@query(f"WITH {BUDGET} SELECT user_id, step, round(el, 6) AS elapsed FROM made")
def budget_stop(spark, sf_dir):
    """The steps of each run until the first after the tenth that reaches the time budget."""
    return made(spark, sf_dir).select("user_id", "step", F.round("elapsed", 6).alias("elapsed"))


@query(
    f"""WITH {BUDGET}, s AS (SELECT user_id, count(*) AS n, coalesce(sum(value) FILTER (step > 10), 0.0) AS t FROM made GROUP BY user_id)
    SELECT user_id, n AS num_steps, round(t, 6) AS training_seconds, n * 524288 AS total_tokens, round(CASE WHEN t > 0 THEN 100 * 1e9 * 524288 * (n - 10) / t / 989.5e12 ELSE 0 END, 9) AS mfu_percent FROM s"""
)
def run_summary(spark, sf_dir):
    x = T.run_summary(made(spark, sf_dir), 524288, 1e9, 989.5e12, series=["user_id"])
    return x.select("user_id", "num_steps", F.round("training_seconds", 6).alias("training_seconds"), "total_tokens", F.round("mfu_percent", 9).alias("mfu_percent"))


@query(f"WITH {LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY exp_no) AS r FROM log) SELECT series, exp_no, metric, status FROM n WHERE r <= 10")
def log_head(spark, sf_dir):
    """The first ten rows of each log."""
    return log(spark, sf_dir).head().select("series", "exp_no", "metric", "status")


@query(f"WITH {LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY metric, exp_no) AS r FROM log WHERE status = 'KEEP' AND metric IS NOT NULL) SELECT series, exp_no, metric, status, '#' || exp_no || ' of ' || series AS description FROM k WHERE r = 1")
def best_description(spark, sf_dir):
    """The whole row of the best kept metric, its description with it."""
    x = log(spark, sf_dir)
    text = F.concat(F.lit("#"), F.col("exp_no").cast("string"), F.lit(" of "), "series")
    return Log(x.df.withColumn("description", text), x.metric, x.low, x.series).best_row().select("series", "exp_no", "metric", "status", "description")


@query(f"WITH {LOG}, {VALID} SELECT series, idx, metric AS y FROM valid WHERE status = 'DISCARD' AND metric IS NOT NULL")
def discard_series(spark, sf_dir):
    return log(spark, sf_dir).series_of("DISCARD")


@query(
    f"""WITH {LOG}, s AS (SELECT series, arg_min(metric, exp_no) AS a, min(metric) FILTER (status = 'KEEP') AS b FROM log GROUP BY series)
    SELECT series, printf('%.6f', a) AS baseline, printf('%.6f', b) AS best, printf('%+.6f', a - b) AS gain, printf('%.1f', (a - b) / a * 100) || '%' AS percent, round(least(a, b) - 0.15 * abs(a - b), 6) AS low, round(greatest(a, b) + 0.15 * abs(a - b), 6) AS high FROM s"""
)
def formatted_summary(spark, sf_dir):
    """The summary's numbers as text, and the chart's axis."""
    from ..operators.report import fixed, percent

    x = log(spark, sf_dir)
    s = x.summary().join(x.axes(), "series")
    return s.select("series", fixed("baseline", 6).alias("baseline"), fixed("best", 6).alias("best"), fixed("improvement", 6, signed=True).alias("gain"), percent(F.col("improvement") / F.col("baseline")).alias("percent"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
