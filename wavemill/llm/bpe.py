"""Byte-level BPE by replaying merges over all distinct words of a corpus, or of a part of it, at once."""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace
from .words import chunks, widened

#: The most frequent words of a corpus that are encoded once for all of it, at most so many ...
COMMON_WORDS = 600_000
#: ... and none of more bytes, so what is sent to the executors is bounded.
COMMON_BYTES = 64
#: Bytes of further words that a worker keeps for its next texts.
KEPT_BYTES = 1 << 20
#: Bytes of words that are replayed at once while texts go through: their index then stays in a core's cache.
REPLAY_BYTES = 10 << 10
#: Bytes of text whose words are counted at once.
COUNT_BYTES = 8 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Tokens by rank, and the rank that each pair of tokens merges to, looked up once."""

    def __init__(self, ranks: Mapping[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.decimal = {r: str(r) for r in self.tokens}
        self.base = max(self.tokens, default=0) + 1
        self.single = [ranks.get(bytes([i]), -1) for i in range(256)]
        self.merges: dict[int, int] = {}

    def merge(self, pair: int) -> int:
        """Rank of the token that a pair (left * base + right) merges to; -1 if there is none."""
        r = self.merges[pair] = self.ranks.get(self.tokens[pair // self.base] + self.tokens[pair % self.base], -1)
        return r

    def replay(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Token ids of each distinct word.

        All words start as single bytes in linked lists. An inverted index leads from each pair of
        neighbours to its places, the positions in all words where it stands. Merges are applied in the
        order of their ranks, each to all its places from left to right, and only the two pairs that a
        merge touches are looked up anew. If that gives a word a pair of lower rank, its further places
        wait until the lower one is done, so every word sees exactly its own lowest pair, leftmost
        first. A word that is a token is not split.
        """
        out: dict[bytes, tuple[int, ...]] = {}
        todo: list[bytes] = []
        for w in dict.fromkeys(words):
            r = self.ranks.get(w)
            if r is not None:
                out[w] = (r,)
            elif w:
                todo.append(w)
            else:
                out[w] = ()
        # One flat array for all words: tok[i] is the token that starts at i, nxt and prv its neighbours.
        tok: list[int] = []
        for w in todo:
            tok.extend([self.single[x] for x in w])
        nxt, prv = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        index: dict[int, list[int]] = {}
        ranked: dict[int, list[int]] = {}  # the pairs in the index that merge to a rank
        merges, base, merge = self.merges, self.base, self.merge

        def place(pair: int, rank: int, i: int) -> bool:
            """Put a place into the index; whether its rank is a new one."""
            if pair in index:
                index[pair].append(i)
                return False
            index[pair] = [i]
            if rank in ranked:
                ranked[rank].append(pair)
                return False
            ranked[rank] = [pair]
            return True

        begin = 0
        begins = []
        for w in todo:
            begins.append(begin)
            end = begin + len(w)
            prv[begin], nxt[end - 1] = -1, -1
            left = tok[begin]
            for i in range(begin, end - 1):
                right = tok[i + 1]
                pair = left * base + right
                r = merges.get(pair)
                if r is None:
                    r = merge(pair)
                if r >= 0:
                    if pair in index:
                        index[pair].append(i)
                    else:
                        place(pair, r, i)
                left = right
            begin = end
        heap = list(ranked)
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            pairs = ranked.pop(rank, None)
            if pairs is None:
                continue
            places = index.pop(pairs[0])
            for p in pairs[1:]:
                places += index.pop(p)
            if len(places) > 1:
                places.sort()
            lower_until = -1  # places before this position belong to a word that has a lower pair now
            later: list[int] = []
            for i in places:
                left = tok[i]
                j = nxt[i]
                if left < 0 or j < 0 or merges.get(left * base + tok[j]) != rank:
                    continue
                if i < lower_until:
                    later.append(i)
                    continue
                tok[i] = rank
                tok[j] = -1
                k = nxt[i] = nxt[j]
                h = prv[i]
                least = rank
                if k >= 0:
                    prv[k] = i
                    pair = rank * base + tok[k]
                    r = merges.get(pair)
                    if r is None:
                        r = merge(pair)
                    if r >= 0:
                        if pair in index:
                            index[pair].append(i)
                        else:
                            index[pair] = [i]
                            if r in ranked:
                                ranked[r].append(pair)
                            else:
                                ranked[r] = [pair]
                                push(heap, r)
                        if r < least:
                            least = r
                if h >= 0:
                    pair = tok[h] * base + rank
                    r = merges.get(pair)
                    if r is None:
                        r = merge(pair)
                    if r >= 0:
                        if pair in index:
                            index[pair].append(h)
                        else:
                            index[pair] = [h]
                            if r in ranked:
                                ranked[r].append(pair)
                            else:
                                ranked[r] = [pair]
                                push(heap, r)
                        if r < least:
                            least = r
                if least < rank:
                    while k >= 0:  # to the word's end
                        lower_until, k = k + 1, nxt[k]
                    lower_until = max(lower_until, i + 1)
            for i in later:
                if place(tok[i] * base + tok[nxt[i]], rank, i):
                    push(heap, rank)
        for w, i in zip(todo, begins):
            ids = []
            while i >= 0:
                ids.append(tok[i])
                i = nxt[i]
            out[w] = tuple(ids)
        return out


def _utf8(word: str) -> bytes:
    return word.encode("utf-8", "surrogatepass")


class Codec:
    """Encodes many texts, with what is known of the corpus's common words, and keeps further words for a while."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, known: pa.Table | None = None):
        """``known`` has columns word and ids (see ``common_table``); what was learned from it stays."""
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.words: dict[str, tuple[str, bytes]] = {}  #: a word's ids in decimal, and the bytes that they decode to
        self.further: list[str] = []  #: words beside the common ones
        self.bytes = 0  #: ... and their size
        for part in known.to_batches(max_chunksize=10_000) if known is not None else []:
            raw = part.column(0).to_pylist()
            self._keep([w.decode("utf-8", "surrogatepass") for w in raw], part.column(1).to_pylist())

    def _keep(self, words: Iterable[str], encoded: Iterable[Iterable[int]]) -> None:
        token, name, kept = self.vocabulary.tokens.__getitem__, self.vocabulary.decimal.__getitem__, self.words
        for word, ids in zip(words, encoded):
            kept[word] = " ".join(map(name, ids)), b"".join(map(token, ids))

    def _learn(self, words: list[str], raw: list[bytes]) -> None:
        self._keep(words, map(self.vocabulary.replay(raw).__getitem__, raw))
        self.further += words

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids in decimal, joined by one space, and the bytes that they decode to."""
        if self.bytes > KEPT_BYTES:
            for word in self.further:
                del self.words[word]
            self.further, self.bytes = [], 0
        pieces = [self.split(t) for t in texts]
        part, raws, size = [], [], 0
        for word in set().union(*pieces).difference(self.words):
            raw = _utf8(word)
            part.append(word)
            raws.append(raw)
            size += len(raw)
            if size >= REPLAY_BYTES:
                self._learn(part, raws)
                self.bytes, part, raws, size = self.bytes + size, [], [], 0
        self._learn(part, raws)
        self.bytes += size
        for text in pieces:
            found = list(map(self.words.__getitem__, text))
            yield " ".join([d for d, _ in found]), b"".join([b for _, b in found])


#: The codec of the last broadcast vocabulary, which a worker keeps from task to task.
_last: dict[str, Codec] = {}


def codec_of(key: str, ranks: Mapping[bytes, int], pattern: str, known: pa.Table | None) -> Codec:
    if key not in _last:
        _last.clear()
        _last[key] = Codec(Vocabulary(ranks), pattern, known)
        gc.freeze()  # what stays need not be looked through for cycles again and again
    return _last[key]


def common_table(docs: DataFrame, ranks: Mapping[bytes, int], pattern: str, ws: Workspace, *, text: str = "text", most: int = COMMON_WORDS) -> pa.Table:
    """The corpus's most frequent words that are no tokens themselves, each encoded once: word, ids.

    All words of all texts are counted; the words of the highest counts, by quarters of a power of two,
    are taken as long as they are at most ``most``. One replay goes over the distinct words of a partition.
    """
    sent = docs.sparkSession.sparkContext.broadcast((dict(ranks), pattern))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = sent.value[0], regex.compile(sent.value[1]).findall
        for part in chunks(batches, text, COUNT_BYTES):
            found: Counter[str] = Counter()
            for t in part.column(text).to_pylist():
                found.update(split(t or ""))
            rows = [(w, n) for p, n in found.items() if (w := _utf8(p)) not in known and len(w) <= COMMON_BYTES]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

    words = docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = ws.save(words, "words")
    level, taken, least = F.floor(F.log2("n") * 4).cast("int").alias("level"), 0, 0
    for r in words.groupBy(level).count().orderBy(F.desc("level")).collect():  # at most 252 rows
        taken += r["count"]
        if taken > most:
            least = r["level"] + 1
            break

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [w for b in batches for w in b.column(0).to_pylist()]
        ids = Vocabulary(sent.value[0]).replay(mine)
        yield pa.RecordBatch.from_arrays([pa.array(mine, pa.binary()), pa.array([ids[w] for w in mine], pa.list_(pa.int32()))], ["word", "ids"])

    got = words.where(level >= least).select("word").mapInArrow(encoded, "word binary, ids array<int>").toArrow()
    ws.drop("words")
    return got.combine_chunks()


def common_words(docs: DataFrame, ranks: Mapping[bytes, int], pattern: str, ws: Workspace, *, text: str = "text", most: int = COMMON_WORDS) -> dict[bytes, list[int]]:
    """``common_table`` as a dictionary."""
    got = common_table(docs, ranks, pattern, ws, text=text, most=most)
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))


def encode(docs: DataFrame, ranks: Mapping[bytes, int], pattern: str, ws: Workspace | None = None, *, text: str = "text", ids: bool = True) -> DataFrame:
    """Every input row with n_tokens, ids (array of int), ids_sha256, decoded_sha256.

    ``ids`` are the text's token ids; ids_sha256 is the digest of them in decimal, joined by one space;
    decoded_sha256 that of the bytes the ids decode to. ``ids=False`` leaves the array out. Each match
    of ``pattern`` is encoded by itself, without special tokens. Null text counts as empty: no tokens.
    Repeated rows are encoded alike; other columns stay, but for any of a result's name. An empty table
    gives no rows.

    With a workspace, the corpus's common words are encoded first, once (see ``common_table``), and sent
    to the executors; the other distinct words of a part of the texts are replayed as it goes through,
    without a shuffle of texts. A part is about 2 MB of texts, or one longer text.
    """
    spark = docs.sparkSession
    known = common_table(docs, ranks, pattern, ws, text=text) if ws is not None else None
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, dict(ranks), pattern, known))
    docs, schema = widened(docs, f"n_tokens long, {'ids array<int>, ' if ids else ''}ids_sha256 string, decoded_sha256 string", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(*sent.value)
        sha = hashlib.sha256
        for part in chunks(batches, text):
            n_tokens, flat, ends, coded, decoded = [], [], [0], [], []
            texts = [t or "" for t in part.column(text).to_pylist()]
            for decimal, read_back in codec.encode(texts):
                n_tokens.append(decimal.count(" ") + 1 if decimal else 0)
                coded.append(sha(decimal.encode()).hexdigest())
                decoded.append(sha(read_back).hexdigest())
                if ids:
                    flat.append(np.array(decimal.split(), np.int32) if decimal else np.zeros(0, np.int32))
                    ends.append(ends[-1] + n_tokens[-1])
            more = [pa.array(n_tokens, pa.int64())]
            if ids:
                more.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat))))
            more += [pa.array(coded), pa.array(decoded)]
            names = part.schema.names + ["n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256"]
            yield from pa.Table.from_arrays([*part.columns, *more], names).combine_chunks().to_batches()

    return docs.mapInArrow(run, schema)
