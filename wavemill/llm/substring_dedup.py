"""Substring dedup: a log-structured index of window fingerprints finds repeated word windows exactly.

A window is WINDOW consecutive words of one document. Every window has an anchor: of the GRAM-word
grams in it, the one with the smallest hash, the first of equals. Equal windows have equal anchors at
equal places, so only windows whose anchor occurs again can repeat, and one of about seven positions
is an anchor. Per batch of documents:

1. the batch's anchors, sorted in buckets of their hash, are merge-joined with the index's runs of
   anchors, which lie in the same buckets and stay where they are. An anchor that is new is kept as a
   single; one that occurs again exposes its windows, and those of the single that it meets;
2. exposed windows are verified by their words: the key that is merge-joined with the index's runs of
   windows is a digest of the 20 words themselves. All but the first of equal windows are repeats, and
   their words go;
3. the batch's anchors and first windows become new sorted runs; beyond FANOUT runs, all are
   compacted into one, a row a key, again bucket by bucket.

Groups of copies never meet in one task as rows: a part of about CHUNK_BYTES of text sends an anchor
and a window on once, and settles the rest by itself. Within a bucket, the rows of a key are counted by
a combinable sum and then stream past the one row that says what becomes of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, unused
from .words import chunks, digests, joined, mix, spans, text_bytes, widened, window_hashes, word_hashes

WINDOW = 20
GRAM = 8
SPAN = WINDOW - GRAM + 1
FANOUT = 2
#: Batches of a whole table: more than FANOUT, so that its own runs are compacted, too.
BATCHES = 4
#: A text of more than one in so many documents is told from others by a broadcast table of, at most, so many rows.
COMMON = 4096
LOWEST = -(2**63)
ANCHORS = "h long, d long, k long, pos int, n int, more array<int>"
WINDOWS = "w long, v long, d long, k long, pos int, starts array<int>, counts array<int>, new boolean"


def anchors(words: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes; window starts; each window's anchor (all as positions in ``words``)."""
    grams = window_hashes(words, GRAM)
    n = len(words) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return grams, none, none

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[a] <= grams[b], a, b)

    at, reach = np.arange(len(grams)), 1
    while reach * 2 <= SPAN:
        at, reach = least(at[:-reach], at[reach:]), reach * 2
    if reach < SPAN:
        at = least(at[: len(at) - (SPAN - reach)], at[SPAN - reach :])
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    starts = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    return grams, starts, at[starts]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32)))


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _salt(d: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Spreads rows that belong to a document and to no key."""
    return mix(k.view(np.uint64) ^ mix(d.view(np.uint64)))


def _batch(schema: str, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), [c.split()[0] for c in schema.split(", ")])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's anchors, a row a hash; the further places of a hash in the part, a row a document."""
    for t in chunks(batches, "text"):
        d, k = t.column("d").to_numpy(), t.column("k").to_numpy()
        data, offs = text_bytes(t.column("text"))
        starts, ends, w = spans(data, offs)
        grams, _, at = anchors(word_hashes(data, starts, ends), w)
        at = at[np.flatnonzero(np.diff(at, prepend=-1))]  # they never go back
        owner = np.searchsorted(w, at, side="right") - 1
        pos = (at - w[owner]).astype(np.int32)
        h, first, count = np.unique(grams[at], return_index=True, return_counts=True)
        rest = np.ones(len(at), bool)
        rest[first] = False
        docs, begin = np.unique(owner[rest], return_index=True)  # owners ascend
        own = owner[first]
        yield _batch(ANCHORS, _longs(h), _longs(d[own]), _longs(k[own]), pa.array(pos[first]), _ints(np.minimum(count, 2)), pa.nulls(len(h), pa.list_(pa.int32())))
        if len(docs):
            lists = _lists(np.split(pos[rest], begin[1:]))
            yield _batch(ANCHORS, _longs(_salt(d[docs], k[docs])), _longs(d[docs]), _longs(k[docs]), pa.nulls(len(docs), pa.int32()), _ints(np.zeros(len(docs))), lists)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each part whose anchor is a hit, a row a digest of words; and what repeats within the part."""
    for t in chunks(batches, "text"):
        d, k, new = t.column("d").to_numpy(), t.column("k").to_numpy(), np.asarray(t.column("new"))
        data, offs = text_bytes(t.column("text"))
        first, last, w = spans(data, offs)
        words = word_hashes(data, first, last)
        _, starts, at = anchors(words, w)
        hits = t.column("hits").combine_chunks() if isinstance(t.column("hits"), pa.ChunkedArray) else t.column("hits")
        lens = pa.compute.list_value_length(hits).to_numpy(zero_copy_only=False).astype(np.int64)
        marked = np.zeros(len(words) + 1, bool)
        marked[hits.flatten().to_numpy(zero_copy_only=False) + np.repeat(w[:-1], lens)] = True
        starts = starts[marked[at]]
        text, begin = joined(data, first, last)
        key = digests(text, begin[starts], begin[starts + WINDOW] - 1)
        owner = np.searchsorted(w, starts, side="right") - 1
        pos = starts - w[owner]
        # documents in their order, equal keys alike: of equal windows here, the first stands for all
        order = np.lexsort((k, d, new))
        step = np.zeros(len(order), np.int64)
        step[1:] = (new[order][1:] != new[order][:-1]) | (d[order][1:] != d[order][:-1]) | (k[order][1:] != k[order][:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(step)
        when = (place[owner] << 32) | pos
        by = np.lexsort((when, key[:, 1], key[:, 0]))
        head = np.ones(len(by), bool)
        head[1:] = (key[by][1:] != key[by][:-1]).any(axis=1)
        lead = by[head]
        none = pa.nulls(len(lead), pa.list_(pa.int32()))
        yield _batch(WINDOWS, _longs(key[lead, 0]), _longs(key[lead, 1]), _longs(d[owner[lead]]), _longs(k[owner[lead]]), _ints(pos[lead]), none, none, pa.array(new[owner[lead]]))
        gone = np.sort(by[when[by] > when[lead][np.cumsum(head) - 1]] if len(by) else by)
        gone = gone[new[owner[gone]]]
        if len(gone):  # repeats that are certain already: runs of neighbouring windows, a row a document
            edge = np.ones(len(gone), bool)
            edge[1:] = (starts[gone][1:] != starts[gone][:-1] + 1) | (owner[gone][1:] != owner[gone][:-1])
            b = np.flatnonzero(edge)
            count = np.diff(np.append(b, len(gone)))
            docs, at = np.unique(owner[gone[b]], return_index=True)
            s, c = np.split(pos[gone[b]], at[1:]), np.split(count, at[1:])
            salt = _longs(_salt(d[docs], k[docs]))
            yield _batch(WINDOWS, salt, salt, _longs(d[docs]), _longs(k[docs]), _ints(np.full(len(docs), -1)), _lists(s), _lists(c), pa.array(new[docs]))


def _only(prefix: str = "") -> list[Column]:
    """Where the one row of a group is; of no use for groups of more."""
    return [F.max(c).alias(f"{prefix}{c}") for c in ("d", "k", "pos")]


class FingerprintIndex:
    """Sorted, immutable runs in a workspace, in buckets of their key: ``anchors`` and first ``windows``.

    Runs of anchors: h, n (1, or 2 for more), and d, k, pos, which tell where if n is 1; of windows: w, v. A key may
    be in several runs. What was indexed is in ``texts``, d, k, text, in buckets of d and k.
    """

    def __init__(self, ws: Workspace, fanout: int = FANOUT):
        self.ws, self.fanout = ws, fanout
        self.runs: dict[str, list[tuple[str, DataFrame]]] = {"anchors": [], "windows": []}
        self.made = self.compactions = 0

    def add(self, kind: str, run: DataFrame, table: str) -> None:
        """Take in a run; ``table`` is what it reads."""
        self.runs[kind].append((table, run))
        if len(self.runs[kind]) > self.fanout:
            self.compact(kind)

    def history(self, kind: str) -> DataFrame | None:
        """All rows of the runs of a kind, in the buckets in which they lie."""
        out = None
        for _, run in self.runs[kind]:
            out = run if out is None else out.unionByName(run)
        return out

    def compact(self, kind: str) -> None:
        """Merge all runs of a kind into one, a row a key. Buckets are merged where they lie."""
        self.compactions += 1
        rows, name = self.history(kind), f"compacted-{kind}-{self.compactions}"
        if kind == "anchors":
            run = self.ws.save_bucketed(rows.groupBy("h").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), *_only()), name, "h", shuffle=False, hashes=True)
        else:
            run = self.ws.save_bucketed(rows.groupBy("w", "v").agg(F.lit(False).alias("seen")).select("w", "v"), name, "w", "v", shuffle=False, hashes=True)
        self.ws.drop(*[table for table, _ in self.runs[kind]])
        self.runs[kind] = [(name, run)]

    def repeats(self, docs: DataFrame, texts: DataFrame, last: bool = False) -> DataFrame:
        """d, k, starts, counts: a row a document, the runs of repeated windows of ``docs``.

        ``docs`` has d, k, text; ``texts`` has them and all that the index has taken in before, whose
        windows count as earlier. The index takes ``docs`` in, unless this is the ``last`` batch.
        """
        ws, name = self.ws, f"batch{self.made}"
        self.made += 1
        raw = ws.save_bucketed(docs.select("d", "k", "text").mapInArrow(_anchor_rows, ANCHORS), f"{name}-raw", "h", hashes=True)
        own = raw.where("more is null").groupBy("h").agg(F.sum("n").alias("n"), *_only())
        past = self.history("anchors")
        if past is None:
            own = own.withColumns({"before": F.lit(0), "old_d": F.lit(None).cast("long"), "old_k": F.lit(None).cast("long"), "old_pos": F.lit(None).cast("int")})
        else:
            past = past.groupBy("h").agg(F.sum("n").cast("int").alias("before"), *_only("old_"))
            own = own.join(past.hint("merge"), "h", "left").withColumn("before", F.coalesce("before", F.lit(0)))
        own = ws.save_bucketed(own.withColumn("n", F.least("n", F.lit(2)).cast("int")), f"{name}-anchors", "h", shuffle=False, hashes=True)
        met = raw.where("more is null").join(own.where("n + before > 1").select("h").hint("merge"), "h", "left_semi")
        places = raw.where("more is not null").select("d", "k", "more", F.lit(True).alias("new"))
        places = places.unionByName(met.select("d", "k", F.array("pos").alias("more"), F.lit(True).alias("new")))
        places = places.unionByName(own.where("before = 1").select(F.col("old_d").alias("d"), F.col("old_k").alias("k"), F.array("old_pos").alias("more"), F.lit(False).alias("new")))
        hits = places.groupBy("d", "k").agg(F.flatten(F.collect_list("more")).alias("hits"), F.max("new").alias("new"))
        found = texts.select("d", "k", "text").join(hits, ["d", "k"]).select("d", "k", "text", "new", "hits").mapInArrow(_window_rows, WINDOWS)
        found = ws.save_bucketed(found, f"{name}-found", "w", "v", hashes=True)
        ws.drop(f"{name}-raw")
        if not last:
            self.add("anchors", own.where("before < 2").select("h", "n", "d", "k", "pos"), f"{name}-anchors")
        first = F.struct(F.col("new").alias("new"), "d", "k", "pos")
        heads = found.where("starts is null").groupBy("w", "v").agg(F.min(first).alias("first"))
        past = self.history("windows")
        if past is None:
            heads = heads.withColumn("seen", F.lit(False))
        else:
            past = past.groupBy("w", "v").agg(F.lit(True).alias("seen"))
            heads = heads.join(past.hint("merge"), ["w", "v"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
        if not last:
            heads = ws.save_bucketed(heads, f"{name}-windows", "w", "v", shuffle=False, hashes=True)
        again = found.where("starts is null and new").join(heads.hint("merge"), ["w", "v"]).where(F.col("seen") | (first > F.col("first")))
        runs = found.where("starts is not null").select("d", "k", F.col("starts").alias("s"), F.col("counts").alias("c"))
        runs = runs.unionByName(again.select("d", "k", F.array("pos").alias("s"), F.array(F.lit(1)).alias("c")))
        runs = runs.groupBy("d", "k").agg(F.flatten(F.collect_list("s")).alias("starts"), F.flatten(F.collect_list("c")).alias("counts"))
        out = ws.save_bucketed(runs, f"{name}-repeats", "d", "k")
        ws.drop(f"{name}-found")
        if not last:
            self.add("windows", heads.where("not seen").select("w", "v"), f"{name}-windows")
        return out

    def drop(self) -> None:
        """Delete the runs."""
        for kind, runs in self.runs.items():
            self.ws.drop(*[table for table, _ in runs])
            self.runs[kind] = []


def whole_copies(rows: DataFrame, ws: Workspace) -> DataFrame:
    """d, k of the documents whose text (t, its digest) an earlier one has, in buckets of both.

    Texts that very many documents have are looked up in a broadcast table: at most COMMON texts have
    more than one in COMMON of the documents each. So their rows are never dealt by text to one task.
    """
    first = rows.where("t is not null").groupBy("t").agg(F.min(F.struct("d", "k")).alias("first"), F.count("*").alias("n"))
    first = ws.save(first.where("n > 1"), "firsts")
    limit = (rows.count() // COMMON) + 1
    hot, cold = (first.where(c).select(F.col("t").alias("tt"), F.col("first").alias(of)) for c, of in ((f"n > {limit}", "hot"), (f"n <= {limit}", "cold")))
    x = rows.where("t is not null").select("d", "k", "t").join(F.broadcast(hot), F.col("t") == F.col("tt"), "left").drop("tt")
    spread = F.when(F.col("hot").isNull(), F.col("t"))  # null keys of an outer join's left side are not dealt to one task
    x = x.withColumn("t", F.coalesce(spread, F.md5(F.concat_ws(" ", "d", "k")))).join(cold, F.col("t") == F.col("tt"), "left")
    x = x.where(F.struct("d", "k") != F.coalesce("hot", "cold")).select("d", "k").distinct()
    return ws.save_bucketed(x, "copies", "d", "k")


def deduplicate(docs: DataFrame, ws: Workspace, *, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, cut: bool = False) -> DataFrame:
    """Every input row with n_words, n_removed, kept_sha256; with ``cut`` its text loses the removed words.

    A word goes if a window that covers it has the same words as an earlier one: of a smaller id, or
    earlier in the same document. Windows are judged on the input. Documents come in ``batches`` by
    ascending id, cut at quantiles, and each is checked against the index of those before it. Whole
    copies of an earlier text are set aside first: each of their windows is a repeat. Null
    ids come first; rows of one id go by a hash of their text, and rows equal in both are one
    document, listed more than once with one result. Null and empty texts have no words; a null text
    stays null. Other columns stay, but for any named like a result. An empty table gives no rows.

    Texts are shuffled once, into a table in buckets by document, in which all later steps find them.
    """
    docs, schema = widened(docs, "n_words long, n_removed long, kept_sha256 string", doc_id, text)
    columns, p = docs.columns, unused("_dedup", *docs.columns)
    keyed = docs.withColumns({f"{p}d": F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)), f"{p}k": F.xxhash64(F.col(text)), f"{p}t": F.md5(F.col(text))})
    rows = ws.save_bucketed(keyed, "documents", f"{p}d", f"{p}k")
    key = [F.col(f"{p}{c}").alias(c) for c in "dk"]
    copies = whole_copies(rows.select(*key, F.col(f"{p}t").alias("t")), ws)
    texts = rows.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("text"))
    slim = texts.join(copies, ["d", "k"], "left_anti")
    cuts = texts.select(F.percentile_approx("d", [i / batches for i in range(1, batches)], F.lit(10_000))).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    index, gone = FingerprintIndex(ws), None
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = slim if low is None else slim.where(F.col("d") > low)
        part, upto = (part, texts) if high is None else (x.where(F.col("d") <= high) for x in (part, texts))
        r = index.repeats(part, upto, last=high is None)
        gone = r if gone is None else gone.unionByName(r)
    index.drop()  # repeats are written; the index of this table ends here
    # An id and text has repeats in one batch only, so no copy of its row meets two.
    own = [f"{p}d", f"{p}k"]
    x = rows.drop(f"{p}t").join(gone.toDF(*own, f"{p}starts", f"{p}counts"), own, "left")
    x = x.join(copies.select(F.col("d").alias(own[0]), F.col("k").alias(own[1]), F.lit(True).alias(f"{p}copy")), own, "left").drop(*own)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(parts, text):
            data, offs = text_bytes(t.column(text))
            starts, ends, w = spans(data, offs)
            level = np.zeros(len(starts) + 1, np.int64)
            for name, sign in ((f"{p}starts", 1), (f"{p}counts", -1)):
                lists = t.column(name).combine_chunks()
                lens = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if sign > 0:
                    first = flat + np.repeat(w[:-1], lens)
                    np.add.at(level, first, 1)
                else:
                    np.add.at(level, first + flat + WINDOW - 1, -1)
            gone = np.cumsum(level)[:-1] > 0
            copy = pa.compute.fill_null(t.column(f"{p}copy"), False).to_numpy(zero_copy_only=False) & (np.diff(w) >= WINDOW)
            gone |= np.repeat(copy, np.diff(w))
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w])
            digest, texts = [], []
            for i in range(t.num_rows):
                raw = data[offs[i] : offs[i + 1]].tobytes()
                kept = raw.split()
                if removed[i]:
                    mask = gone[w[i] : w[i + 1]]
                    kept = [x for x, m in zip(kept, mask.tolist()) if not m]
                    if cut:
                        edge = np.flatnonzero(np.diff(mask, prepend=True, append=True))  # runs of kept words
                        s = np.append(starts[w[i] : w[i + 1]], offs[i + 1]) - offs[i]
                        raw = b"".join(raw[s[a] : s[b]] for a, b in zip(edge[::2], edge[1::2]))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                texts.append(raw)
            out = t.select(columns)
            if cut:
                valid = t.column(text).is_valid().to_pylist()
                new = pa.array([x.decode("utf-8") if ok else None for x, ok in zip(texts, valid)], pa.string())
                out = out.set_column(columns.index(text), text, new)
            out = out.append_column("n_words", pa.array(np.diff(w))).append_column("n_removed", pa.array(removed)).append_column("kept_sha256", pa.array(digest))
            yield from out.combine_chunks().to_batches()

    return x.mapInArrow(run, schema)
