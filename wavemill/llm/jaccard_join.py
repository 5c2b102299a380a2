"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles. Sets are put into one global order, tokens that many
documents have last. Two sets with Jaccard similarity of at least PERCENT have an overlap of at least
t = ceil(PERCENT n / 100) for either size n, so the first l of the tokens they share stand in the
first n - t + l tokens of both: with prefixes for l, partners share at least l prefix tokens. Every
document chooses its own l: a longer prefix costs more postings, but asks for more matches before a
candidate is verified; a pair has to share as many as the smaller l of the two. A pair's own overlap
must reach a = ceil(PERCENT (n + m) / (100 + PERCENT)), so its l-th shared token has a - l others
behind it in both sets: only shared tokens at places before n - a + l and m - a + l are paired at all,
which for sets of like size is far less than the prefixes.

Shingles are compared by 64-bit hashes up to the last step; a link needs that the shingles' words
themselves overlap enough, and documents are only taken for copies by a digest of all their words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import Workspace
from .words import LOWER, chunks, digests, joined, sequence_hash, spans, text_bytes, window_hashes, word_hashes

SHINGLE = 5
PERCENT = 75
MAX_MATCH = 8
#: What a candidate costs to verify, in postings.
VERIFY_COST = 8.0
#: Documents of a posting list that the others are paired with, by round.
LEADERS = (8, 32)
#: Counters of the frequency sketch; fixed, so what is broadcast doesn't grow with the corpus.
CELLS, SLICES = 1 << 22, 64
#: Documents in more than one in so many of the pairs are spread over tasks; there are twice as many at most.
COMMON = 4096
#: Comparisons within one posting list that one task makes.
LIST_WORK = 4_000_000
LOWEST = -(2**63)
_FOLD = bytes(LOWER)


def _shingled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    words = word_hashes(data, starts, ends)
    grams = window_hashes(words, SHINGLE)
    out = []
    for a, b in zip(w[:-1].tolist(), w[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(sequence_hash(words[a:b])[None] if b > a else np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; fewer words than a shingle make one."""
    data, offs = text_bytes(texts)
    data = LOWER[data]
    return _shingled(data, *spans(data, offs))


def real_set(text: str) -> set[bytes]:
    """The distinct shingles of a text themselves."""
    w = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return {b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def similar(a: int, b: int, both: int) -> bool:
    """Whether sets of a and b elements, so many of them in both, have the similarity."""
    return both > 0 and 100 * both >= PERCENT * (a + b - both)


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document, d, the size of its set and a digest of its words, and last the task's counters in slices."""
    cells = np.zeros(CELLS, np.int64)
    names = ["d", "n", "s1", "s2", "slice", "part"]
    for t in chunks(batches, "text"):
        data, offs = text_bytes(t.column("text"))
        data = LOWER[data]
        starts, ends, w = spans(data, offs)
        sets = _shingled(data, starts, ends, w)
        text, at = joined(data, starts, ends)
        same = digests(text, at[w[:-1]], at[w[1:]])
        np.add.at(cells, (np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), 1)
        size = pa.array(np.array([len(s) for s in sets], np.int64))
        yield pa.RecordBatch.from_arrays([t.column("d").combine_chunks(), size, pa.array(same[:, 0]), pa.array(same[:, 1]), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
    if cells.any():
        parts = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in np.split(np.minimum(cells, 2**32 - 1), SLICES)]
        none = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts)], names)


def _summed(rows: DataFrame) -> DataFrame:
    """Counters of each slice summed within partitions, streaming."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(p), np.uint32).astype(np.int64)
                total[s] = np.minimum(total.get(s, 0) + x, 2**32 - 1)
        if total:
            parts = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(parts)], ["slice", "part"])

    return rows.select("slice", "part").mapInArrow(run, "slice int, part binary")


def usual_count(cells: np.ndarray) -> float:
    """Up to what count a counter may hold rare tokens alone."""
    mean = float(cells.mean()) if len(cells) else 0.0
    return mean + 4 * np.sqrt(mean) + 1


def prefix(tokens: np.ndarray, counts: np.ndarray, usual: float) -> tuple[np.ndarray, int, int]:
    """A set's prefix in the global order, the number l of matches it asks for, and its rank to lead, 0 to 255.

    ``tokens`` are sorted; ``counts`` are their counters, which give the order and, by what exceeds
    ``usual``, the estimated number of other documents. For each l the estimate is the postings
    written, plus what the candidates cost to verify: the documents met at the places that are
    paired with sets of the same size, over the matches that each of them needs. The cheapest l is
    taken. A set leads the more, the more documents its prefix meets: of a group of near copies those
    with the fewest edits, which link to most of the others.
    """
    n = len(tokens)
    t = -(-PERCENT * n // 100)
    order = np.argsort(counts, kind="stable")
    met = np.cumsum(np.maximum(0.0, counts[order] - usual))
    most = min(MAX_MATCH, t)
    ells = np.arange(1, most + 1)
    lengths = n - t + ells
    paired = n + 2 * PERCENT * n // -(100 + PERCENT) + ells
    cost = lengths + met[paired - 1] * (1 + VERIFY_COST / ells)
    ell = int(ells[np.argmin(cost)])
    return tokens[order[: n - t + ell]], ell, min(255, int(8 * np.log2(1 + met[n - t])))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a, b whose texts' sets have the similarity; rows with equal a follow each other.

    Hashes rule most pairs out; those they leave are counted again by the words.
    """
    kept = own = real = None
    for t in chunks(batches, "right", 1 << 20):
        sets = shingle_sets(t.column("right"))
        a, left, right = t.column("a").to_pylist(), t.column("left"), t.column("right")
        ok = []
        for i, s in enumerate(sets):
            x = left[i].as_py()
            if x != kept:
                kept, own, real = x, shingle_sets(pa.array([x]))[0], None
            if similar(len(own), len(s), len(np.intersect1d(own, s, assume_unique=True))):
                real = real_set(x) if real is None else real
                other = real_set(right[i].as_py())
                if similar(len(real), len(other), len(real & other)):
                    ok.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), t.column("b").combine_chunks().take(pa.array(ok, pa.int64()))], ["a", "b"])


class JaccardJoin:
    """The join of one table, step by step; ``members``, ``links`` and ``components`` are its results.

    Documents of the same words, A-Z folded, form a class, whose representative, the smallest id, stands
    for it from then on, so exact copies cost one row each. Ids are nodes: rows that share an id count as one, and
    so do rows of null id; null counts as the smallest id. Null and empty texts have empty sets and no links. Other columns are ignored.
    """

    def __init__(self, docs: DataFrame, ws: Workspace, *, doc_id: str = "doc_id", text: str = "text"):
        self.ws, self.spark = ws, docs.sparkSession
        self.docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("d"), F.col(text).alias("text"))
        census = ws.save(self.docs.mapInArrow(_census, "d long, n long, s1 long, s2 long, slice int, part binary"), "census")
        rows = census.where("slice is null").select("d", "n", "s1", "s2")
        classes = ws.save(rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("d").alias("rep")), "classes")
        parts = census.where("slice is not null").withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(64)))
        got = _summed(_summed(parts.repartition("slice", "salt")).repartition("slice")).collect()  # SLICES rows of a fixed size
        by = {r["slice"]: np.frombuffer(zlib.decompress(r["part"]), np.uint32) for r in got}
        cells = np.concatenate([by[i] for i in range(SLICES)]) if by else np.zeros(CELLS, np.uint32)
        self.rows, self.classes = rows, classes
        self._sketch = self.spark.sparkContext.broadcast((cells, usual_count(cells)))
        self._posted = self._post()

    @property
    def members(self) -> DataFrame:
        """d, n (size of the set), rep (the class's representative; itself for an empty set)."""
        full = self.rows.where("n > 0").join(self.classes, ["s1", "s2", "n"]).select("d", "n", "rep")
        return full.unionByName(self.rows.where("n = 0").select("d", "n", F.col("d").alias("rep")))

    def _post(self) -> DataFrame:
        """Posting lists t, d, n, p, r of the prefix tokens that two classes have at least.

        p is 16 times the token's place in the document's order, from 0, plus the document's l.
        r numbers a list's documents by their rank to lead, then a hash of their id, so the same few
        lead all lists they are in. A list is only streamed in that order: nothing is gathered.
        """
        sketch = self._sketch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, usual = sketch.value
            for t in chunks(batches, "text"):
                sets = shingle_sets(t.column("text"))
                made = [prefix(s, counts[(s & np.uint64(CELLS - 1)).astype(np.int64)], usual) if len(s) else (s, 0, 0) for s in sets]
                w = np.array([len(p) for p, _, _ in made])
                tokens = np.concatenate([p for p, _, _ in made]).view(np.int64)
                d = np.repeat(t.column("d").to_numpy(), w)
                n = np.repeat(np.array([len(s) for s in sets], np.int32), w)
                place = np.concatenate([(lead << 40) + np.arange(len(x), dtype=np.int64) * 16 + e for x, e, lead in made])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens, d, n, place)], ["t", "d", "n", "p"])

        reps = self.docs.join(self.classes.select(F.col("rep").alias("d")).distinct(), "d", "left_semi")
        post = reps.mapInArrow(run, "t long, d long, n int, p long")
        ordered = Window.partitionBy("t").orderBy(F.shiftright("p", 40).desc(), F.xxhash64("d"), "d")
        post = post.withColumn("r", F.row_number().over(ordered)).withColumn("_next", F.lead("d").over(ordered))
        post = self.ws.save_bucketed(post.where("r > 1 or _next is not null").select("t", "d", "n", (F.col("p") % (1 << 40)).cast("int").alias("p"), "r"), "postings", "t", hashes=True)
        involved = post.select("d").distinct()
        self.texts = self.ws.save_bucketed(self.docs.join(involved, "d", "left_semi"), "texts", "d")
        return post

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs a, b of ``pairs`` that have the similarity, by their whole texts.

        Texts lie in buckets of their id, so the pairs go to them: to b's, then, with it, to a's. An a
        that stands in very many pairs is sent to several tasks instead, each with a part of them.
        """
        t = self.texts
        left, right = (t.select(F.col("d").alias(c), F.col("text").alias(of)) for c, of in (("a", "left"), ("b", "right")))
        often = self.ws.save(pairs.groupBy("a").agg(F.count("*").alias("n")), f"{name}-often")
        total = often.agg(F.sum("n")).first()[0] or 0
        parts = F.ceil(F.col("n") * COMMON / F.lit(max(1, total))).cast("int").alias("parts")
        often = often.where(F.col("n") * COMMON > 2 * total).select("a", parts)  # under COMMON / 2 rows
        few = pairs.join(F.broadcast(often), "a", "left_anti").join(right, "b").join(left, "a")
        many = pairs.join(F.broadcast(often), "a").join(right, "b").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        spread = left.join(F.broadcast(often), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        x = few.select("a", "b", "left", "right").unionByName(many.join(spread, ["a", "part"]).select("a", "b", "left", "right"))
        out = self.ws.save(x.mapInArrow(_overlaps, "a long, b long").distinct(), name)
        self.ws.drop(f"{name}-often")
        return out

    def _pairs(self, lists: DataFrame, leaders: int | None = None, main: DataFrame | None = None) -> DataFrame:
        """Candidates a, b among the documents of each posting list.

        With ``leaders``, a is one of the list's first so many documents, so that matches in other
        lists go uncounted and the pair may be left to a later round. With ``main`` (t, main: the
        largest component of the list's, work), only documents of different components are paired.
        One of the two is then none of main's: without leaders, those are joined to the list, in as
        many parts as its ``work``, the comparisons to make, asks for.
        """
        sides = [lists.select("t", *[F.col(c).alias(f"{c}{i}") for c in lists.columns if c != "t"]) for i in (1, 2)]
        first = lambda x, y: F.when(F.col("r1") < F.col("r2"), F.col(x)).otherwise(F.col(y))
        if leaders or main is None:
            x, y = (side if main is None else side.join(main, "t", "left_semi") for side in sides)
            x = x.where(F.col("r1") <= leaders) if leaders else x
            apart = (F.col("r1") < F.col("r2")) if main is None else (F.col("r1") < F.col("r2")) & (F.col("c1") != F.col("c2"))
            both = x.join(y, (x["t"] == y["t"]) & apart & self._close())
        else:
            parts = F.ceil(F.col("work") / LIST_WORK).cast("int")
            # a pair of two outsiders meets in both orders; it counts once
            once = (F.col("c1") != F.col("c2")) & ((F.col("c2") == F.col("main")) | (F.col("r1") < F.col("r2")))
            light, heavy = main.where(F.col("work") <= LIST_WORK), main.where(F.col("work") > LIST_WORK)
            x, y = (side.join(light, "t") for side in sides)
            both = x.where("c1 <> main").drop("main", "work").join(y, "t").where(once & self._close())
            x, y = (side.join(heavy, "t") for side in sides)
            x = x.where("c1 <> main").withColumn("part", F.pmod(F.xxhash64("d1"), parts).cast("int")).drop("main", "work")
            y = y.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
            same = ["d1", "d2", "r1", "r2", "n1", "n2", "p1", "p2"]
            both = both.select(*same).unionByName(x.join(y, ["t", "part"]).where(once & self._close()).select(*same))
        ell = F.least(F.col("p1").bitwiseAND(15), F.col("p2").bitwiseAND(15))
        both = both.groupBy(first("d1", "d2").alias("a"), first("d2", "d1").alias("b")).agg(F.count("*").alias("m"), F.min(ell).alias("l"), F.min(self._overlap()).alias("o"), F.min(self._behind()).alias("k"))
        return both.where("m >= l and m + k >= o").select("a", "b")

    @staticmethod
    def _overlap() -> Column:
        return F.ceil(PERCENT * (F.col("n1") + F.col("n2")) / (100 + PERCENT))

    @staticmethod
    def _behind() -> Column:
        """Shared tokens after this one at most."""
        return F.least(*[F.col(f"n{i}") - 1 - F.shiftright(f"p{i}", 4) for i in (1, 2)])

    def _close(self) -> Column:
        """Whether sizes and places of a shared token leave the similarity possible."""
        ell = F.least(F.col("p1").bitwiseAND(15), F.col("p2").bitwiseAND(15))
        return (100 * F.least("n1", "n2") >= PERCENT * F.greatest("n1", "n2")) & (self._behind() >= self._overlap() - ell)

    def links(self) -> DataFrame:
        """a, b: all pairs of class representatives whose sets have the similarity."""
        return self._verified(self._pairs(self._posted), "links")

    def components(self) -> DataFrame:
        """node, component: classes that links connect, by their representatives.

        In rounds, documents are paired with the LEADERS of their posting lists, more each time, and
        only with those of another component than their own; the last round has no leaders and
        searches the lists whole. A pair within one component cannot change the result, so none is
        lost; and since the leaders of a group of near copies connect most of it, what is left to pair
        in full are the few outside: within a list, all documents but those of its largest component
        are joined to the rest, in several tasks if they are many, so a group of near copies costs its
        size times what stands outside it and not its square.
        """
        tried = links = groups = None
        longest = self._posted.agg(F.max("r")).first()[0] or 0
        for k, leaders in enumerate((*LEADERS, None)):
            if k and LEADERS[k - 1] >= longest:
                break  # every list has been searched whole
            lists, main = self._posted, None
            if groups is not None:
                lists = lists.join(groups.withColumnRenamed("node", "d"), "d", "left").withColumn("c", F.coalesce("component", "d")).drop("component")
                lists = self.ws.save_bucketed(lists, f"lists{k}", "t", hashes=True)
                main = lists.groupBy("t", "c").agg(F.count("*").alias("n")).groupBy("t").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("all"))
                main = main.where(F.col("top.n") < F.col("all")).select("t", F.col("top.c").alias("main"), ((F.col("all") - F.col("top.n")) * F.col("all")).alias("work"))
                main = self.ws.save_bucketed(main, f"main{k}", "t", shuffle=False)
            pairs = self._pairs(lists, leaders, main)
            pairs = self.ws.save(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), f"pairs{k}")
            self.ws.drop(f"lists{k}", f"main{k}")
            found = self._verified(pairs, f"links{k}")
            tried = pairs if tried is None else tried.union(pairs)
            links = found if links is None else links.union(found)
            groups = connected_components(links.toDF("u", "v"), self.ws, f"groups{k}")
        return groups


def near_duplicates(docs: DataFrame, ws: Workspace, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for each row: exact classes, and what links connect.

    A component's id is the smallest id in it. See ``JaccardJoin`` for nulls, ties and repeated rows.
    """
    join = JaccardJoin(docs, ws, doc_id=doc_id, text=text)
    comp = join.components()
    ws.drop("postings", "texts", *[f"{kind}{k}" for kind in ("pairs", "links") for k in range(len(LEADERS) + 1)])  # the result reads members and components only
    x = join.members.join(comp, F.col("rep") == F.col("node"), "left")
    real = lambda c: F.when(c != LOWEST, c)
    return x.select(real(F.col("d")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.col("rep")).alias("class_id"), real(F.coalesce("component", "rep")).alias("component_id"))
