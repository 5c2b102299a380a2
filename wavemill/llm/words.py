"""Words of whole texts and their hashes, for many documents at once, in numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Texts are taken as UTF-8 bytes. A word's
hash takes its bytes eight at a time through a mixing function, a window's hash joins those of its words
two by two through the same: neither is linear in its input, so words and windows of regular shape collide
no more often than any others. Hashes only propose; ``digests`` has what decides that words are equal.
All functions take the concatenated bytes of many texts and the offsets at which each text begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are hashed at once; working memory is about 40 times that.
CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of more bytes are hashed by BLAKE2b.
LONG_WORD = 64
_KEYS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: The first n bytes of eight, little-endian.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def widened(df: DataFrame, columns: str, *needed: str) -> tuple[DataFrame, T.StructType]:
    """``df`` without columns named like the new ``columns`` (DDL), and its schema with them.

    A result so replaces a column of its name; a column that is ``needed`` as input cannot go.
    """
    more = T.StructType.fromDDL(columns).fields
    names = {f.name.lower() for f in more}
    if clash := names & {c.lower() for c in needed}:
        raise ValueError(f"an input column is named like a result: {', '.join(sorted(clash))}")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    return df, T.StructType(df.schema.fields + more)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and len(texts)+1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Regroup record batches so that each part has about ``most`` bytes of text (a longer text alone)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lens = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(lens), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = int(np.searchsorted(ends, before + most - size, side="right")) - at
            n = max(n, 0 if held else 1)
            if n:
                part = batch.slice(at, n)
                held.append(part)
                size += int(ends[at + n - 1] - before)
                at += n
            if at < batch.num_rows or size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of words before it (len+1)."""
    n = len(data)
    gap = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first, last = ~gap, ~gap
    if n:
        first[1:] &= gap[:-1] | edge[1:n]
        last[:-1] &= gap[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    size = ends - starts
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix(size.astype(np.uint64) * _LEFT ^ _KEYS[seed])
    live = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        block = eight[starts[live] + k] & _FIRST[np.minimum(size[live] - k, 8)]
        out[live] = mix((out[live] ^ block) * _RIGHT + _KEYS[seed])
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=bytes([seed + 1])).digest(), "little")
    return out


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position on; windows may cross texts: mask them."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    both = lambda a, b: mix(a * _LEFT + (b ^ (b >> np.uint64(32))) * _RIGHT)
    out, done, power, reach = None, 0, words, 1
    while True:  # spans of 1, 2, 4, .. words; those in the binary form of the length, side by side
        if length & reach:
            part = power[done : done + n]
            out, done = part if out is None else both(out, part), done + reach
        if done == length:
            return mix(out + np.uint64(length))
        power, reach = both(power[:-reach], power[reach:]), reach * 2


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of words; equal to ``window_hashes`` of that length."""
    return window_hashes(words, len(words))[0]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and where each begins in that (and the end)."""
    at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    out = np.full(at[-1], 32, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = data[~SPACE[data]]
    return out.tobytes(), at


def digests(text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 2) int64: a 128-bit BLAKE2b digest of each span of ``text``.

    Equal digests are taken for equal words: no two different texts with one are known, and among 10**15
    the chance of any is below 10**-8.
    """
    view, make = memoryview(text), hashlib.blake2b
    return np.frombuffer(b"".join([make(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist())]), np.int64).reshape(-1, 2)
