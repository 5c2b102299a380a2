"""Analytics of an experiment log with an explicit order, for a metric that is better low or high."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio, shortened


class Log:
    """A log with columns exp_no, status and a metric; ``series`` splits it into independent logs.

    Order is by exp_no, never by position. A null metric stays in the log but is nobody's best.
    """

    def __init__(self, df: DataFrame, metric: str, lower_is_better: bool = True, series: list[str] | None = None):
        self.df, self.metric, self.low, self.series = df, metric, lower_is_better, series or []

    def _w(self, order: str | Column = "exp_no"):
        return Window.partitionBy(*self.series).orderBy(order) if self.series else Window.orderBy(order)

    def _best(self, c: str | Column) -> Column:
        return F.min(c) if self.low else F.max(c)

    def outcomes(self) -> DataFrame:
        """status, n: most frequent first; a missing status is not counted."""
        return self.df.where("status is not null").groupBy(*self.series, "status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")

    def keep_rate(self) -> DataFrame:
        n = lambda s: F.count_if(F.col("status") == s)
        x = self.df.groupBy(*self.series).agg(F.count("*").alias("total"), n("KEEP").alias("n_keep"), n("DISCARD").alias("n_discard"), n("CRASH").alias("n_crash"))
        return x.withColumn("keep_rate", ratio(F.col("n_keep"), F.col("n_keep") + F.col("n_discard")))

    def kept(self) -> DataFrame:
        return self.df.where("status = 'KEEP'")

    def renumbered(self) -> DataFrame:
        """Without crashes (a missing status stays), numbered from 0 in ``idx``."""
        return self.df.where(~F.col("status").eqNullSafe("CRASH")).withColumn("idx", F.row_number().over(self._w()) - 1)

    def frontier(self) -> DataFrame:
        """The kept rows of ``renumbered`` with ``best``, the best metric so far; null where the metric is."""
        so_far = self._best(self.metric).over(self._w("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return self.renumbered().where("status = 'KEEP'").withColumn("best", F.when(F.col(self.metric).isNotNull(), so_far))

    def near_baseline(self, margin: float = 0.0005) -> DataFrame:
        """Rows of ``renumbered`` no worse than the first of them by more than ``margin``."""
        whole = self._w("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        x = self.renumbered().withColumn("baseline", F.first(self.metric).over(whole))
        m, b = F.col(self.metric), F.col("baseline")
        return x.where(m <= b + margin if self.low else m >= b - margin)

    def summary(self) -> DataFrame:
        """baseline (the very first row), best, improvement, percent, best_exp, axis margin."""
        m = F.col(self.metric)
        kept = (F.col("status") == "KEEP") & m.isNotNull()
        key = F.struct(m if self.low else -m, F.col("exp_no"))
        x = self.df.groupBy(*self.series).agg(F.min_by(self.metric, "exp_no").alias("baseline"), self._best(F.when(kept, m)).alias("best"), F.min_by("exp_no", F.when(kept, key)).alias("best_exp"))
        gain = F.col("baseline") - F.col("best") if self.low else F.col("best") - F.col("baseline")
        return x.withColumn("improvement", gain).withColumn("percent", F.try_divide(gain, F.col("baseline")) * 100).withColumn("margin", gain * 0.15)

    def best_row(self) -> DataFrame:
        """The whole row of the best kept metric, the first of equals; rows without a metric are nobody's best."""
        m = F.col(self.metric)
        key = F.struct(m if self.low else -m, F.col("exp_no"))
        row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in self.df.columns]), key).alias("_row")
        return self.kept().where(m.isNotNull()).groupBy(*self.series).agg(row).select("_row.*")

    def series_of(self, status: str) -> DataFrame:
        """exp idx and metric of the rows of a status, as a chart's scatter series, in the numbering without crashes."""
        x = self.renumbered().where((F.col("status") == status) & F.col(self.metric).isNotNull())
        return x.select(*self.series, "idx", F.col(self.metric).alias("y"))

    def axes(self, margin: float = 0.15) -> DataFrame:
        """low and high of a chart's vertical axis: from the best to the baseline, and ``margin`` of that beyond."""
        s = self.summary().withColumns({"_a": F.least("baseline", "best"), "_b": F.greatest("baseline", "best")})
        gap = (F.col("_b") - F.col("_a")) * margin
        return s.select(*self.series, (F.col("_a") - gap).alias("low"), (F.col("_b") + gap).alias("high"))

    def head(self, n: int = 10) -> DataFrame:
        """The first rows of each series in the log's order."""
        return self.df.withColumn("_n", F.row_number().over(self._w())).where(F.col("_n") <= n).drop("_n")

    def hits(self) -> DataFrame:
        """Kept rows after the first with delta to the kept row before, ranked by it; total in each row."""
        m = F.col(self.metric)
        x = self.kept().withColumn("prev", F.lag(m).over(self._w())).withColumn("_n", F.row_number().over(self._w())).where("_n > 1")
        x = x.withColumn("delta", F.col("prev") - m if self.low else m - F.col("prev"))
        order = [F.desc_nulls_last("delta"), F.asc("exp_no")]
        w = Window.partitionBy(*self.series) if self.series else Window.partitionBy(F.lit(1))
        return x.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("total", F.sum("delta").over(w)).drop("_n")

    def labelled(self) -> DataFrame:
        """``label``: keep if strictly better than all before, crash without a metric, else discard."""
        m = F.col(self.metric)
        before = self._best(m).over(self._w().rowsBetween(Window.unboundedPreceding, -1))
        better = before.isNull() | (m < before if self.low else m > before)
        return self.df.withColumn("label", F.when(m.isNull(), "crash").when(better, "keep").otherwise("discard"))

    def labels(self, text: str = "description") -> DataFrame:
        return self.kept().withColumn("label_text", shortened(F.col(text)))


def within_budget(runs: DataFrame, budget_s: float = 60.0, kill_s: float = 90.0) -> DataFrame:
    """``verdict`` of each run's elapsed seconds: ok, slow, or crash (killed, or no time)."""
    e = F.col("elapsed")
    return runs.withColumn("verdict", F.when(e.isNull() | (e > kill_s), "crash").when(e < budget_s, "ok").otherwise("slow"))
