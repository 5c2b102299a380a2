"""Schedules, running figures and sizing of a training run, as columns over its step log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lr_multiplier(progress: Column, warm_up: float = 0.0, cool_down: float = 0.5, final: float = 0.0) -> Column:
    """Rises over ``warm_up``, stays at 1, and falls to ``final`` over the last ``cool_down`` of progress."""
    left = (1.0 - progress) / cool_down if cool_down else F.lit(1.0)
    rise = progress / warm_up if warm_up else F.lit(1.0)
    return F.when(progress < warm_up, rise).when(progress < 1.0 - cool_down, 1.0).otherwise(left + (1.0 - left) * final)


def momentum(step: Column, low: float = 0.85, high: float = 0.95, steps: int = 300) -> Column:
    part = F.least(step / steps, F.lit(1.0))
    return (1 - part) * low + part * high


def weight_decay(progress: Column, start: float) -> Column:
    return start * (1 - progress)


def running_time(log: DataFrame, order: str = "step", dt: str = "dt", skip: int = 10, series: Sequence[str] = ()) -> DataFrame:
    """``elapsed``: time so far without the first steps, up to and with number ``skip``.

    Times are added as decimals, so that times that make a budget exactly are not a rounding error short
    of it; where one is no decimal of 18 places (NaN, infinite, 1e20), as doubles.
    """
    w = Window.partitionBy(*series).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = F.when(F.col(order) > skip, F.col(dt)).otherwise(0.0)
    exact = t.try_cast("decimal(38,18)")
    odd = F.count_if(t.isNotNull() & exact.isNull()).over(w)
    return log.withColumn("elapsed", F.coalesce(F.when(odd == 0, F.try_sum(exact).over(w).cast("double")), F.sum(t).over(w)))


def ema(values: Column, beta: float = 0.9) -> Column:
    """Bias-corrected moving average after the last of an array of values, by a fold."""
    state = F.aggregate(values, F.lit(0.0), lambda a, v: a * beta + (1 - beta) * v)
    return state / (1 - F.pow(F.lit(beta), F.size(values)))


def layers(spark, depth: int, pattern: str, context: int) -> DataFrame:
    """layer, window, has_value_embedding: the pattern's letters in turn, S half and L whole context; the last is whole."""
    x = spark.range(depth).select(F.col("id").cast("int").alias("layer"))
    letter = F.substring(F.lit(pattern), F.col("layer") % len(pattern) + 1, F.lit(1))
    window = F.when((letter == "L") | (F.col("layer") == depth - 1), context).otherwise(context // 2)
    return x.select("layer", window.cast("int").alias("window"), ((F.col("layer") % 2) == (depth - 1) % 2).alias("has_value_embedding"))


def model_width(depth: int, aspect: int = 64, head: int = 128) -> int:
    return -(-depth * aspect // head) * head


def lr_scale(width: Column) -> Column:
    return F.pow(width / 768.0, F.lit(-0.5))


def flops_per_token(parts: DataFrame, layer_rows: DataFrame, heads: int, head_dim: int) -> DataFrame:
    """flops: 6 a weight (of ``parts``: name, numel, counted) and 12 heads * head_dim * window a layer."""
    a = parts.agg((6 * F.sum(F.when(F.col("counted"), F.col("numel")).otherwise(0))).alias("weights"))
    b = layer_rows.agg((12 * heads * head_dim * F.sum("window")).alias("attention"))
    return a.crossJoin(b).select((F.col("weights") + F.col("attention")).cast("long").alias("flops"))  # one row each


def accumulation(total: int, per_step: int) -> int:
    if total % per_step:
        raise ValueError("the batch is no multiple of a step's tokens")
    return total // per_step


def progress_figures(log: DataFrame, tokens: int, flops: float, peak: float, budget_s: float) -> DataFrame:
    """pct, tok_per_sec, mfu, remaining_s of each row with elapsed and dt."""
    rate = tokens / F.col("dt")
    return log.withColumns({"pct": F.least(F.col("elapsed") / budget_s, F.lit(1.0)) * 100, "tok_per_sec": F.floor(rate), "mfu": 100 * flops * rate / peak, "remaining_s": F.greatest(F.lit(0.0), budget_s - F.col("elapsed"))})


def until_budget(log: DataFrame, budget_s: float, order: str = "step", skip: int = 10, series: Sequence[str] = ()) -> DataFrame:
    """The steps that a run makes: all up to the first one after ``skip`` whose elapsed time reaches the budget.

    ``log`` has elapsed (see ``running_time``). Elapsed time grows, so a step is made if the one before it
    did not end the run.
    """
    before = F.lag("elapsed").over(Window.partitionBy(*series).orderBy(order))
    over = (F.col(order) - 1 > skip) & (F.coalesce(before, F.lit(0.0)) >= budget_s)
    return log.withColumn("_over", over).where(~F.col("_over")).drop("_over")


def run_summary(log: DataFrame, tokens: int, flops: float, peak: float, skip: int = 10, series: Sequence[str] = ()) -> DataFrame:
    """One row a run: num_steps, training_seconds, total_tokens, mfu_percent of the steps after the first ``skip``."""
    x = log.groupBy(*series).agg(F.count("*").alias("num_steps"), F.coalesce(F.sum(F.when(F.col("step") > skip, F.col("dt"))), F.lit(0.0)).alias("training_seconds"))
    mfu = 100 * flops * tokens * (F.col("num_steps") - skip) / F.col("training_seconds") / peak
    return x.withColumn("total_tokens", F.col("num_steps") * tokens).withColumn("mfu_percent", F.when(F.col("training_seconds") > 0, mfu).otherwise(0.0))


# What the training run is set up with.
PARAMETERS = {
    "aspect_ratio": 64.0, "head_dim": 128.0, "total_batch_size": 524288.0, "device_batch_size": 128.0, "depth": 8.0,
    "embedding_lr": 0.6, "unembedding_lr": 0.004, "matrix_lr": 0.04, "scalar_lr": 0.5, "weight_decay": 0.2,
    "adam_beta1": 0.8, "adam_beta2": 0.95, "warmup_ratio": 0.0, "warmdown_ratio": 0.5, "final_lr_frac": 0.0,
}


def parameters(spark, **changed: float) -> DataFrame:
    """name, value of every parameter, with those of ``changed`` in place of the fixed ones."""
    if unknown := changed.keys() - PARAMETERS.keys():
        raise ValueError(f"no such parameter: {', '.join(sorted(unknown))}")
    rows = [(k, float(v)) for k, v in sorted((PARAMETERS | changed).items())]
    return spark.createDataFrame(rows, "name string, value double")


def failed(loss: Column, most: float = 100.0) -> Column:
    return F.isnan(loss) | (loss > most)
