"""Results as lines of text: per file, the metrics, a run's summary. Numbers are formatted on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(c: str | Column, places: int, signed: bool = False) -> Column:
    """A number with so many decimals, with its sign if asked for; null is empty."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(x.isNull(), F.lit("")).otherwise(F.format_string(f"%{'+' if signed else ''}.{places}f", x))


def percent(c: str | Column, places: int = 1) -> Column:
    """A share as a percentage."""
    return F.concat(fixed((F.col(c) if isinstance(c, str) else c) * 100, places), F.lit("%"))


def listed(times: Column) -> Column:
    """Times in brackets, with the decimals they have."""
    return F.concat(F.lit("["), F.array_join(F.transform(times, lambda t: t.cast("string")), ", "), F.lit("]"))


def file_lines(per_file: DataFrame, times: bool = False) -> DataFrame:
    """name, line: one for each file; skipped files and errors have no counts. With ``times``, gt and det follow."""
    counts = F.format_string("TP=%d FP=%d FN=%d", "tp", "fp", "fn")
    counts = F.concat(counts, F.lit(" gt="), listed(F.col("gt")), F.lit(" det="), listed(F.col("det"))) if times else counts
    head = F.format_string("  T%d %-4s %s", "tier", "status", "name")
    plain = F.format_string("  %s %s", "status", "name")
    return per_file.select("name", F.when(F.col("status").isin("SKIP", "ERROR"), plain).otherwise(F.concat(head, F.lit(": "), counts)).alias("line"))


def metric_lines(metrics: DataFrame) -> DataFrame:
    """no, line: the primary metric first, then the others, then the counts."""
    text = lambda k, c, p: F.concat(F.lit(f"{k}: "), fixed(c, p))
    last = F.format_string("  TP=%d FP=%d FN=%d files=%d errors=%d", "tp", "fp", "fn", "files", F.col("errors") if "errors" in metrics.columns else F.lit(0))
    lines = F.array(text("splice_f1", "f1", 6), text("precision", "precision", 2), text("recall", "recall", 2), text("fp_rate", "fp_rate", 2), last)
    return metrics.select(F.posexplode(lines).alias("no", "line"))


def summary_lines(summary: DataFrame, *keys: str) -> DataFrame:
    """keys, no, line: a training run's summary, its numbers in one column."""
    items = [("training_seconds", fixed("training_seconds", 1)), ("mfu_percent", fixed("mfu_percent", 2)), ("total_tokens_M", fixed(F.col("total_tokens") / 1e6, 1)), ("num_steps", F.col("num_steps").cast("string"))]
    return summary.select(*keys, F.posexplode(F.array(*[F.concat(F.rpad(F.lit(f"{k}:"), 18, " "), v) for k, v in items])).alias("no", "line"))
