"""Mixing sources to target weights along a curriculum that varies over training time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Rates at the start and at the end of training, by turns.
SCHEDULE = ((1.0, 0.0), (0.5, 1.0), (1.0, 0.5))
#: Documents a bucket of the hash, about.
PER_BUCKET = 1024
#: Rows of two numbers and a name that are broadcast at most.
FEW_SOURCES = 50_000


def source_targets(sizes: DataFrame, ws: Workspace, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Words to take of each source: source, source_size, weight, turn, target.

    ``sizes`` has one row per source: source, source_size. Sources by code point, null last, get the
    weights in turn and share ``share`` times all words by weight; a target stops at ``most`` times
    its source's size and what is left over is shared again by weight. So target = min(most * size,
    weight * level) for one level, found in rounds: each is one sum over the sources, and more of them are
    full than before. Sources without words get 0. Empty input gives no rows. Sources are numbered
    by ranges of their names, so no task has them all.
    """
    named = sizes.repartitionByRange(F.col("source").isNull(), "source").withColumn("_part", F.spark_partition_id())
    named = ws.save(named, "named")
    starts = named.groupBy("_part").count()  # a row a partition
    starts = starts.withColumn("_start", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    turn = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").isNull(), "source")) - 1 + F.col("_start")
    ranked = named.join(F.broadcast(starts), "_part").withColumn("turn", turn)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    ranked = ws.save(ranked.select("source", "source_size", weight.alias("weight"), "turn"), "ranked")
    cap, level, before = F.col("source_size") * F.lit(float(most)), 0.0, -1
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        r = ranked.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if r[3] == before or not r[2]:
            level = level if r[2] else float("inf")
            break
        level, before = (r[0] * share - (r[1] or 0.0)) / r[2], r[3]
    return ranked.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def source_key(source: Column) -> Column:
    """A string for each source, for null too."""
    return F.concat(F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source.cast("string"), F.lit("")))


def words_of(text: Column) -> Column:
    """The number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Mix:
    """What ``plan`` found: where each bucket of a source begins, and one document a source that evens it out."""

    offsets: DataFrame
    bits: int
    names: dict[str, str]
    most: float
    schedule: Sequence[tuple[float, float]]
    flips: DataFrame | None = None

    def keyed(self, docs: DataFrame, *more: Column) -> DataFrame:
        """doc_id, source, size, and the keys _g (source), _h (hash of id and text), _b (its first bits)."""
        doc_id, text, source = (F.col(self.names[c]) for c in ("doc_id", "text", "source"))
        return docs.select(doc_id.alias("doc_id"), source.alias("source"), words_of(text).alias("size"), source_key(source).alias("_g"), F.xxhash64(doc_id, text).alias("_h"), *more)

    def place(self, rows: DataFrame, *ties: str) -> DataFrame:
        """Rows of ``keyed`` with _row, _mid, times, target, source_size and _curve."""
        x = rows.withColumn("_b", F.shiftright("_h", 64 - self.bits))
        order = Window.partitionBy("_g", "_b").orderBy("_h", "doc_id", *ties)
        before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        x = x.withColumns({"_before": before, "_row": F.row_number().over(order)}).join(self.offsets, ["_g", "_b"])
        middle = F.col("_base") + F.col("_before") + F.col("size") / 2.0
        passes = F.least(F.greatest(F.lit(0), F.ceil((F.col("target") - middle) / F.col("source_size"))), F.lit(int(self.most)))
        times = F.when((F.col("size") > 0) & (F.col("source_size") > 0), passes).otherwise(F.lit(0)).cast("int")
        x = x.withColumns({"_mid": middle, "times": times, "_curve": schedule_of(self.schedule, F.col("turn"))}).drop("turn", "_before", "_base")
        if self.flips is not None:
            one = self.flips.withColumnRenamed("_g", "_fg")
            x = x.join(one, (F.col("_g") == F.col("_fg")) & (F.col("_b") == F.col("_fb")), "left")
            x = x.withColumn("times", F.col("times") + F.when(F.col("_row") == F.col("_frow"), F.col("_add")).otherwise(F.lit(0))).drop("_fg", "_fb", "_frow", "_add")
        return x


def plan(docs: DataFrame, ws: Workspace, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, schedule: Sequence[tuple[float, float]] = SCHEDULE, per_bucket: int = PER_BUCKET) -> tuple[Mix, DataFrame]:
    """The mix of ``docs`` and its documents without their texts, for ``Mix.place``."""
    found = Mix(docs, 0, {"doc_id": doc_id, "text": text, "source": source}, most, schedule)
    slim = ws.save(found.keyed(docs), "sizes")
    rows = slim.count()
    found.bits = max(4, (rows // per_bucket).bit_length())
    first, all_of = F.shiftright("_h", 64 - found.bits // 2).alias("_c"), F.sum("size").alias("_s")
    sums = ws.save(slim.groupBy("_g", "source", first, F.shiftright("_h", 64 - found.bits).alias("_b")).agg(all_of), "bucket_sums")
    upto = lambda *keys, by: F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = sums.groupBy("_g", "_c").agg(F.sum("_s").alias("_s")).select("_g", "_c", upto("_g", by="_c").alias("_cbase"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_s").alias("source_size")), ws, weights, share, most)
    targets = targets.withColumn("_g", source_key(F.col("source"))).drop("source", "weight")
    offsets = sums.withColumn("_base", upto("_g", "_c", by="_b")).join(coarse, ["_g", "_c"]).withColumn("_base", F.col("_base") + F.col("_cbase"))
    found.offsets = ws.save(offsets.join(targets, "_g").drop("source", "_c", "_s", "_cbase"), "offsets")
    placed = ws.save(found.place(slim).select("_g", "_b", "_row", "_h", "size", "times", "target"), "placed")
    miss = placed.groupBy("_g").agg((F.first("target") - F.sum(F.col("times") * F.col("size"))).alias("_miss"))
    off = F.abs(F.abs("_miss") - F.col("size"))
    can = F.when(F.col("_miss") > 0, F.col("times") < int(most)).otherwise(F.col("times") > 0) & (F.col("size") > 0) & (off < F.abs("_miss"))
    miss = ws.save(miss, "misses")
    # a row a source: sent to all tasks while it is small, so a large source stays spread
    miss = F.broadcast(miss) if miss.count() <= FEW_SOURCES else miss
    best = placed.join(miss, "_g").where(can).groupBy("_g").agg(F.min(F.struct(off.alias("off"), "_h", "_b", "_row")).alias("m"), F.first(F.signum("_miss")).alias("s"))
    found.flips = ws.save(best.select("_g", F.col("m._b").alias("_fb"), F.col("m._row").alias("_frow"), F.col("s").cast("int").alias("_add")), "flips")
    ws.drop("placed", "bucket_sums")
    return found, slim


def mix(docs: DataFrame, ws: Workspace, **how) -> DataFrame:
    """One row per document: how many times it is taken, its size and its source's size and target.

    With the stream offset of its middle word, ``_mid``, and its source's rates, ``_curve``,
    ``positions`` places the takings; _g, _b and _row number a source's rows. For ``how``, see ``plan``.

    The sources' schedules, by turns, are rates (at the start, at the end) that change evenly over
    training time t from 0 to 1; a source's demand up to t is the integral of its rate, scaled to its
    target. Its documents, in the order of a hash of their id and text, form a stream that begins again
    after the last; a document whose middle word has stream offset c is taken, if c is below the target,
    at the t where demand reaches c. Then one document a source, the one that leaves the least, is taken
    once more or once less if that brings the taken words nearer to the target (its next taking stands at
    the end). None is taken more than ``most`` times.

    The running offset of a source needs no task that holds a source: documents are dealt into buckets
    by the first bits of their hash, and sums per source and bucket are accumulated in two steps, so a
    source with a third of all rows is spread over all buckets. The order is the hash's own, whatever
    the number of buckets.

    Null ids and texts count (null text: no words); a source of null is a source of its own; repeated
    rows are documents of their own; equal hashes go by id. A document without words is never taken.
    Other columns are ignored. An empty table gives no rows.
    """
    found, slim = plan(docs, ws, **how)
    return found.place(slim)


def schedule_of(schedule: Sequence[tuple[float, float]], turn):
    arr = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in schedule])
    return F.element_at(arr, (turn % len(schedule) + 1).cast("int"))


def positions(mixed: DataFrame, untaken: bool = False) -> DataFrame:
    """Each taking of a document with its training time ``position``, from the output of ``mix``.

    With ``untaken``, documents that are not taken have one row, with null epoch and position. Nulls
    and repeated rows are as in ``mix``; takings of one position are told apart by _g, _b, _row and epoch.

    Rates a at t=0 and b at t=1 give demand D(t) = target * (a t + (b - a) t^2 / 2) / ((a + b) / 2);
    D(t) = c is solved in a form that stays exact as b - a goes to 0.
    """
    epochs = F.when(F.col("times") > 0, F.sequence(F.lit(0), F.greatest(F.col("times") - 1, F.lit(0))))
    x = mixed.withColumn("epoch", F.explode_outer(epochs) if untaken else F.explode(epochs))
    c = (F.col("_mid") + F.col("epoch") * F.col("source_size")) / F.col("target")
    a, b = F.col("_curve.a"), F.col("_curve.b")
    area = c * (a + b) / 2
    root = F.sqrt(F.greatest(a * a + 2 * (b - a) * area, F.lit(0.0)))
    t = 2 * area / (a + root)
    return x.withColumn("position", F.when(F.col("epoch").isNotNull(), F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))))


def takings(docs: DataFrame, ws: Workspace, untaken: bool = False, **how) -> DataFrame:
    """Each taking in training order: doc_id, size, source_size, target, position, epoch, and its row of ``docs`` as _docs.

    Rows are range-partitioned and sorted by training position; ties go by id, epoch and a hash of the
    row. _g, _b and _row number a source's rows. With ``untaken``, documents that are not taken follow
    after the last, once each and without their row (_docs is null).
    Texts are shuffled by source and bucket and then by position, and joined with nothing but a row a bucket.
    """
    found, _ = plan(docs, ws, **how)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_docs")
    rows = found.keyed(docs, row).withColumn("_tie", F.xxhash64("_docs"))
    x, place = positions(found.place(rows, "_tie"), untaken), F.col("position")
    if untaken:
        x, place = x.withColumn("_docs", F.when(F.col("position").isNotNull(), F.col("_docs"))), place.asc_nulls_last()
    x = x.select("position", "doc_id", "epoch", "_tie", "_docs", "_g", "_b", "_row", "size", "source_size", "target")
    return x.repartitionByRange(place, "doc_id", "epoch", "_tie").sortWithinPartitions(place, "doc_id", "epoch", "_tie")


def curriculum(docs: DataFrame, ws: Workspace, *, placed: bool = False, **how) -> DataFrame:
    """The documents in training order (see ``takings``): every column of ``docs``, repeated as often as taken.

    With ``placed``, columns position and epoch follow (and replace any of their name). Documents that
    are not taken are left out; repeated rows are taken each for itself; columns may have any name.
    """
    x = takings(docs, ws, **how)
    extra = ["position", "epoch"] if placed else []
    return x.select(*[F.col(f"_docs.`{c}`") for c in docs.columns if c.lower() not in extra], *extra)


def placings(docs: DataFrame, ws: Workspace, *, text: str = "text", **how) -> DataFrame:
    """The takings as ``curriculum`` has them in order, written, each with its ``place`` there, from 0.

    ``words`` counts the words of the text that stands at the place; _g, _b, _row, doc_id, size,
    source_size, target, position and epoch are those of ``takings``. Documents that are not taken have
    one row with null place, position and epoch and no words. Places are the lines of the sorted
    partitions, counted on from one to the next by a row a partition.
    """
    x = takings(docs, ws, untaken=True, text=text, **how)
    kept = ["_g", "_b", "_row", "doc_id", "size", "source_size", "target", "position", "epoch"]
    x = ws.save(x.select(*kept, words_of(F.col(f"_docs.`{text}`")).alias("words"), F.monotonically_increasing_id().alias("_line")), "training_order")
    x = x.withColumns({"_part": F.shiftright("_line", 33), "_line": F.col("_line").bitwiseAND(2**33 - 1)})
    starts = x.groupBy("_part").count()  # a row a partition
    starts = starts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.when(F.col("position").isNotNull(), F.col("_start") + F.col("_line"))
    return x.join(F.broadcast(starts), "_part").select(*kept, "words", place.alias("place"))
