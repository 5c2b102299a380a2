"""Document fingerprints: quartile codes of hashed byte triplets, and a bounded difference score."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import CHUNK_BYTES, chunks, text_bytes, widened

BUCKETS = 256
# The byte positions, in a window of five, of the triplets that are counted.
TRIPLETS = [(0, 1, 2), (0, 1, 3), (0, 2, 4), (0, 3, 4)]
_rng = np.random.default_rng(7)
_TABLES = _rng.integers(0, BUCKETS, (len(TRIPLETS), 3, 256)).astype(np.uint8)
#: Differences of codes, and of lengths in eighths of a doubling, at which texts count as unlike.
LIMIT = 260.0
LENGTH_WEIGHT = 2.0
LOWEST = -(2**63)


def counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How often each bucket is hit by the triplets of each text: (texts, BUCKETS)."""
    n, texts = len(data), len(offs) - 1
    total = np.zeros(texts * BUCKETS, np.int64)
    owner = np.repeat(np.arange(texts, dtype=np.int64) * BUCKETS, np.diff(offs))
    for tables, at in zip(_TABLES, TRIPLETS):
        reach = at[-1]
        if n <= reach:
            continue
        m = n - reach
        h = tables[0][data[:m]] ^ tables[1][data[at[1] : at[1] + m]] ^ tables[2][data[reach:]]
        cell = owner[:m] + h
        inside = owner[:m] == owner[reach:]
        total += np.bincount(cell if inside.all() else cell[inside], minlength=len(total))
    return total.reshape(texts, BUCKETS)


def digests(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quartile codes 0..3 (texts, BUCKETS) and length codes of each text."""
    c = counts(data, offs)
    ordered = np.sort(c, axis=1)
    codes = np.zeros(c.shape, np.uint8)
    for q in (1, 2, 3):
        codes += c > ordered[:, q * BUCKETS // 4 - 1][:, None]
    length = np.minimum(255, np.floor(8 * np.log2(np.diff(offs) + 1.0))).astype(np.uint8)
    return codes, length


def encode(codes: np.ndarray, length: np.ndarray) -> list[str]:
    """Hex: one byte of length code, then the quartile codes, four to a byte."""
    quads = codes.reshape(len(codes), BUCKETS // 4, 4)
    packed = (quads << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2).astype(np.uint8)
    return [bytes(x).hex() for x in np.concatenate([length[:, None], packed], 1)]


def decode(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), BUCKETS // 4 + 1)
    codes = (raw[:, 1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    return codes.reshape(len(raw), BUCKETS), raw[:, 0].copy()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 for equal digests down to 0 where the difference reaches LIMIT.

    A bucket counts |difference| of its codes, 0 to 3 twice that; lengths count beyond one step.
    """
    d = np.abs(a[0].astype(np.int16) - b[0])
    codes = (d + 3 * (d == 3)).sum(axis=1)
    steps = np.maximum(0, np.abs(a[1].astype(np.int16) - b[1]) - 1)
    return 1.0 - np.minimum(1.0, (codes + LENGTH_WEIGHT * steps) / LIMIT)


def fingerprints(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Every input row with its ``fingerprint``; null text counts as empty. No shuffle.

    Equal texts, repeated rows too, have equal fingerprints; other columns stay, but for one of that
    name. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            made = encode(*digests(*text_bytes(part.column(text))))
            yield from part.append_column("fingerprint", pa.array(made, pa.string())).combine_chunks().to_batches()

    rows, schema = widened(docs, "fingerprint string", text)
    return rows.mapInArrow(run, schema)


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by the first code points, as many, of ``after``."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next lower id (null ids come last, equal ids go by a hash of the
    text); after the last comes the first. Documents are dealt into ranges, one shuffle of the texts, and
    stream by in order; the first document of each range is also sent to the range before it, where
    it follows the last. Ranges come from quantiles of all ids, ``parts`` of them (default: the
    shuffle partitions), so only that many ids reach the driver; an id that fills more than a range by
    itself (null, or one that many rows share) is cut further, by the hash. Null texts are empty;
    repeated rows stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    x = x.withColumns({"_o": F.coalesce("doc_id", F.lit(LOWEST)), "_h": F.hash("text")})
    cuts = F.percentile_approx("_o", [i / parts for i in range(1, parts)], F.lit(20_000)) if parts > 1 else F.lit(None)
    bounds = x.select(cuts).first()[0]
    every = [int(b) for b in bounds or []]
    bounds = sorted(set(every), reverse=True)
    # Range i ends with the id bounds[i]; one that bounds several ranges fills them, and has as many pieces.
    pieces = [every.count(b) for b in bounds] + [1]
    first = [sum(pieces[:i]) for i in range(len(pieces))]
    longs = lambda v: F.split(F.lit(",".join(map(str, v))), ",").cast("array<long>")  # noqa: E731  one literal
    at = lambda v, i: F.element_at(longs(v), (i + 1).cast("int"))
    if bounds:  # the number of bounds that are greater than the id, found in two steps
        step = math.isqrt(len(bounds))
        over = lambda arr: F.size(F.filter(arr, lambda b: b > F.col("_o")))
        x = x.withColumn("_c", F.greatest(over(longs(bounds[::step])) - 1, F.lit(0)) * step)
        x = x.withColumn("_c", F.col("_c") + over(F.slice(longs(bounds), F.col("_c") + 1, F.lit(step))))
        piece = F.floor((F.col("_h").cast("long") + 2**31) * at(pieces, F.col("_c")) / F.lit(2.0**32)).cast("long")
        x = x.withColumn("_n", at(first, F.col("_c")) + F.when(F.col("_o") == at([*bounds, LOWEST], F.col("_c")), piece).otherwise(0)).drop("_c")
    else:
        x = x.withColumn("_n", F.lit(0).cast("long"))
    place = F.struct((-F.col("_o").cast("decimal(20,0)")).alias("o"), F.col("_h").alias("h"))
    heads = {r["_n"]: r["m"] for r in x.groupBy("_n").agg(F.min(place).alias("m")).collect()}  # one row a range
    order, ranges = sorted(heads), sum(pieces)
    before = {n: order[i - 1] for i, n in enumerate(order)}
    head = [(-int(heads[n]["o"]), heads[n]["h"]) if n in heads else (0, 0) for n in range(ranges)]
    is_head = (F.col("_o") == at([o for o, _ in head], F.col("_n"))) & (F.col("_h") == at([h for _, h in head], F.col("_n")))
    places = F.array(F.struct(F.col("_n").alias("b"), F.lit(0).alias("extra")))
    again = F.array(F.struct(at([before.get(n, 0) for n in range(ranges)], F.col("_n")).alias("b"), F.lit(1).alias("extra")))
    x = x.select("doc_id", "text", "_o", "_h", F.explode(F.when(is_head, F.concat(places, again)).otherwise(places)).alias("p"))
    x = x.select("doc_id", "text", "_o", "_h", F.col("p.b").alias("b"), F.col("p.extra").alias("extra"))
    x = x.repartition(ranges, "b").sortWithinPartitions("b", "extra", F.desc("_o"), "_h", "text").select("doc_id", "text", "b", "extra")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for part in chunks(batches, "text", CHUNK_BYTES // 2):
            part = pa.concat_tables([last, part]) if last is not None else part
            last = part.slice(part.num_rows - 1)
            b, extra = part.column("b").to_numpy(), part.column("extra").to_numpy()
            mine = np.flatnonzero((b[1:] == b[:-1]) & (extra[:-1] == 0))
            if not len(mine):
                continue
            texts = part.column("text").to_pylist()
            new = [edited(texts[i], texts[i + 1]) for i in mine]
            own, other = digests(*text_bytes(part.column("text"))), digests(*text_bytes(pa.array(new, pa.large_string())))
            pick = lambda at: (own[0][at], own[1][at])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").combine_chunks().take(pa.array(mine)),
                    pa.array([len(texts[i]) for i in mine], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in new]),
                    pa.array(encode(*pick(mine))),
                    pa.array(encode(*other)),
                    pa.array(likeness(pick(mine), other)),
                    pa.array(likeness(pick(mine), pick(mine + 1))),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return x.mapInArrow(run, schema)
