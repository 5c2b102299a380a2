"""Exact top-k by inner product: tiles of matrix products and a tree of merged top lists."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace

LISTS = "query_no long, query_id long, beyond int, score long, exact binary, vec_id long"
#: Queries that one task holds. Up to so many are broadcast; more are dealt in groups of about so many.
QUERY_GROUP = 65_536
#: Rows of a tile of the product, on either side.
TILE_ROWS = 2048
#: Lists that are merged at once on each level of the tree, and the levels.
FAN, LEVELS = 32, 2
#: Components up to this size make plain tiles, in doubles or 64-bit integers; others go as whole numbers of any size.
PLAIN = 2.0**22
NONE = -(2**63)
#: Bits of an exact score: two doubles multiplied, summed up.
EXACT_BITS = 2176


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id, v: array of floor(scale * x) as doubles, which hold it exactly at any size.

    Without rows of null id, null vectors and vectors with null, NaN or infinite components.
    """
    x = F.col("_e").cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float("inf"))
    out = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("_e")).where(F.col("_e").isNotNull() & F.col("vec_id").isNotNull())
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    return out.where(F.forall(x, finite)).select("vec_id", F.transform(x, lambda c: whole(c * scale)).alias("v"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest scores and their ids, ties to smaller id; a score of NONE is no candidate.

    ``ids`` ascend along the row, except that merged lists (few columns) may come in any order.
    """
    if scores.shape[1] > 4 * k:  # partial selection: what is above the k-th score, and the first of those that equal it
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        above, equal = scores > kth, scores == kth
        room = k - above.sum(axis=1, keepdims=True)
        keep = above | (equal & (np.cumsum(equal, axis=1) <= room))
        cols = np.nonzero(keep)[1].reshape(len(scores), k)
        scores, ids = np.take_along_axis(scores, cols, 1), np.take_along_axis(ids, cols, 1)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact int64 scores of plain rows."""
    if PLAIN * PLAIN * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def _exact(q: list[int], x: np.ndarray) -> list[int]:
    return [sum(a * int(b) for a, b in zip(q, row)) for row in x.tolist()]


class Search:
    """The top lists of a set of queries of one length, over tiles of candidates."""

    def __init__(self, no: np.ndarray, own: np.ndarray, q: np.ndarray, k: int):
        self.k, self.no, self.own, self.q = k, no, own, q
        self.plain = np.abs(q).max(axis=1, initial=0) <= PLAIN
        self.tiles = [at for at in np.split(np.flatnonzero(self.plain), range(TILE_ROWS, int(self.plain.sum()), TILE_ROWS)) if len(at)]
        self.best = [(np.full((len(at), 0), NONE), np.zeros((len(at), 0), np.int64)) for at in self.tiles]
        #: Query to its best by whole numbers of any size: (-score, vec_id).
        self.wild: dict[int, list[tuple[int, int]]] = {}

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Multiply one tile of candidates with all queries and keep what is best."""
        plain = np.abs(x).max(axis=1, initial=0) <= PLAIN
        order = np.argsort(ids, kind="stable")
        order = order[plain[order]]
        if len(order):
            for j, at in enumerate(self.tiles):
                scores = _products(self.q[at], x[order])
                cand = np.broadcast_to(ids[order], scores.shape)
                scores[cand == self.own[at][:, None]] = NONE
                new = _best(scores, cand, self.k)
                self.best[j] = _best(np.hstack([self.best[j][0], new[0]]), np.hstack([self.best[j][1], new[1]]), self.k)
        for i in range(len(self.q)) if not plain.all() else np.flatnonzero(~self.plain).tolist():
            rest = np.flatnonzero(~plain) if self.plain[i] else np.arange(len(ids))
            rest = rest[ids[rest] != self.own[i]]
            found = [(-s, int(v)) for s, v in zip(_exact([int(c) for c in self.q[i].tolist()], x[rest]), ids[rest])]
            self.wild[i] = heapq.nsmallest(self.k, found + self.wild.get(i, []))

    def lists(self) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LISTS.split(", ")]
        for at, (scores, ids) in zip(self.tiles, self.best):
            keep = scores != NONE
            w = keep.sum(axis=1)
            n = int(w.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.no[at], w)), pa.array(np.repeat(self.own[at], w)), pa.array(np.zeros(n, np.int32)), pa.array(scores[keep]), pa.nulls(n, pa.binary()), pa.array(ids[keep])], names)
        rows = []
        for i, found in self.wild.items():
            for s, v in found:
                beyond = 1 if -s > 2**63 - 1 else -1 if -s < -(2**63) else 0
                exact = (-s + (1 << EXACT_BITS - 1)).to_bytes(EXACT_BITS // 8, "big") if beyond else None
                rows.append((int(self.no[i]), int(self.own[i]), beyond, max(-(2**63), min(2**63 - 1, -s)), exact, v))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _by_length(vectors: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per vector length: the length, row numbers, matrix."""
    col = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lens = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(lens)
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        yield int(n), at, flat[(ends[at] - n)[:, None] + np.arange(n)] if n else np.zeros((len(at), 0))


def _searches(no: np.ndarray, own: np.ndarray, vectors: pa.Array | pa.ChunkedArray, k: int) -> dict[int, Search]:
    return {n: Search(no[at], own[at], q, k) for n, at, q in _by_length(vectors)}


def _feed(searches: dict[int, Search], ids: np.ndarray, vectors: pa.Array) -> None:
    for s in range(0, len(ids), TILE_ROWS):
        for n, at, x in _by_length(vectors.slice(s, TILE_ROWS)):
            if n in searches:
                searches[n].add(ids[s : s + TILE_ROWS][at], x)


def _by_broadcast(numbered: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Lists by one pass over the candidates, with the queries, at most QUERY_GROUP, sent to all tasks."""
    got = numbered.toArrow()
    sent = candidates.sparkSession.sparkContext.broadcast((got.column("query_no").to_numpy(), got.column("vec_id").to_numpy(), got.column("v").combine_chunks()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(*sent.value, k)
        for b in batches:
            _feed(searches, b.column(0).to_numpy(), b.column(1))
        for s in searches.values():
            yield from s.lists()

    return candidates.select("vec_id", "v").mapInArrow(search, LISTS).withColumn("part", F.spark_partition_id())


def _by_groups(numbered: DataFrame, candidates: DataFrame, queries: int, group: int, k: int) -> DataFrame:
    """Lists by group of queries g and shard of candidates s: each such block is one key of a shuffle.

    A block's queries come first and are held; its candidates stream past them. Queries are sent to all
    shards and candidates to all groups: for a row that is sent, ``group`` products are made.
    """
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = -(-queries // group)
    shards = max(1, -(-parts // groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = numbered.withColumn("g", F.pmod(F.xxhash64("query_no"), F.lit(groups)).cast("int")).withColumn("s", every(shards)).withColumn("kind", F.lit(0))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    c = candidates.select("vec_id", "v").withColumn("s", spread).withColumn("g", every(groups)).withColumns({"kind": F.lit(1), "query_no": F.lit(None).cast("long")})
    x = q.unionByName(c).repartition(max(parts, groups), "g", "s").sortWithinPartitions("g", "s", "kind").select("g", "s", "kind", "query_no", "vec_id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, searches = None, [], None

        def done(searches: dict[int, Search] | None) -> Iterator[pa.RecordBatch]:
            for s in (searches or {}).values():
                for b in s.lists():
                    yield b.append_column("part", pa.array(np.full(b.num_rows, key[1], np.int32)))

        for b in batches:
            tag = np.stack([b.column(i).to_numpy() for i in range(3)])
            edges = [0, *(np.flatnonzero((tag[:, 1:] != tag[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for at, end in zip(edges[:-1], edges[1:]):
                g, s, kind = tag[:, at].tolist()
                if (g, s) != key:
                    yield from done(searches)
                    key, held, searches = (g, s), [], None
                part = b.slice(at, end - at)
                if kind == 0:
                    held.append(part)
                    continue
                if searches is None and held:
                    t = pa.Table.from_batches(held)
                    searches, held = _searches(t.column("query_no").to_numpy(), t.column("vec_id").to_numpy(), t.column("v"), k), []
                _feed(searches or {}, part.column("vec_id").to_numpy(), part.column("v"))
        yield from done(searches)

    return x.mapInArrow(search, f"{LISTS}, part int")


def merged(lists: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with rank: lists are merged FAN by FAN, LEVELS times, the tree's root last."""
    best_first = [F.desc("beyond"), F.desc("score"), F.desc("exact"), F.col("vec_id")]
    for level in range(LEVELS, -1, -1):
        keys = ["query_no"] if level == 0 else ["query_no", "part"]
        lists = lists.withColumn("part", F.pmod("part", F.lit(FAN**level)).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first))).where(F.col("rank") <= k)
    return lists


def top_k(queries: DataFrame, candidates: DataFrame, ws: Workspace, k: int = 5, group: int = QUERY_GROUP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates, all if fewer.

    Both inputs come from ``quantized``: vec_id, v. A candidate with the query's own vec_id takes no
    part; so does one of another length. Ties go to the smaller vec_id; repeated candidate rows count
    each, repeated query rows get a list each. Empty inputs give no rows. Order is by the exact score
    at any size; a score beyond 64 bits is shown as the bound of a long.

    Queries are numbered in a table. Up to ``group`` of them are sent to every task of one pass over the
    candidates; more are dealt into groups, so neither the driver nor a task ever has more than about
    ``group``. A task multiplies tiles of its candidates with tiles of its queries, selects the k best
    of each, and merges them from tile to tile; the tasks' lists are merged in a tree.
    """
    numbered = ws.save(queries.select(F.monotonically_increasing_id().alias("query_no"), "vec_id", "v"), "queries")
    n = numbered.count()
    lists = _by_broadcast(numbered, candidates, k) if n <= group else _by_groups(numbered, candidates, n, group, k)
    return merged(lists, k).select("query_id", "rank", "vec_id", "score")
