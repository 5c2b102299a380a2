"""Language ID by bit-sliced Bloom filters that map an n-gram to the mask of languages that have it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import chunks, mix, widened

#: Lengths of n-grams, in letters; any run of other characters is one boundary.
SIZES = (3, 4)
#: Documents a language that its filter is learned from, expected number at most.
SAMPLE_DOCS = 2000
#: An n-gram is of a language if it is in this share of the language's documents at least ...
MIN_SHARE = 0.005
#: ... and its share is at least this part of the highest share that any language has.
MIN_OF_HIGHEST = 0.25
SLOTS = 1 << 18
HASHES = 2
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for all else; made once a process."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams with at least one letter, the text each is of, and letters per text."""
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    lens = np.array([len(r) // 4 + 2 for r in raw], np.int64)  # a boundary before and after
    points = np.frombuffer(b"\0\0\0\0" + b"\0\0\0\0\0\0\0\0".join(raw) + b"\0\0\0\0", np.uint32) if raw else np.zeros(0, np.uint32)
    seq = letter_table()[points]
    owner = np.repeat(np.arange(len(texts)), lens)
    letters = np.bincount(owner[seq > 0], minlength=len(texts))
    keep = seq > 0
    keep[1:] |= (seq[:-1] > 0) | (owner[1:] != owner[:-1])
    if len(keep):
        keep[0] = True
    seq, owner = seq[keep].astype(np.uint64), owner[keep]
    hashes, whose = [], []
    for n in SIZES:
        if len(seq) < n:
            continue
        m = len(seq) - n + 1
        h = np.full(m, n, np.uint64)
        some = np.zeros(m, bool)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + seq[k : k + m]
            some |= seq[k : k + m] > 0
        ok = some & (owner[:m] == owner[n - 1 :])
        hashes.append(mix(h[ok]))
        whose.append(owner[:m][ok])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), letters
    return np.concatenate(hashes), np.concatenate(whose), letters


def _slots(h: np.ndarray, slots: int) -> list[np.ndarray]:
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return [((a + np.uint64(k) * (b | np.uint64(1))) % np.uint64(slots)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Model:
    """Languages, and the filter: slot x word of 64 languages. Its size doesn't depend on the corpus."""

    languages: list[str]
    bits: np.ndarray
    false_rate: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def build(cls, languages: list[str], hashes: np.ndarray, member: np.ndarray, slots: int = SLOTS) -> Model:
        """``member`` says, for each hash and language, whether the n-gram is of the language."""
        words = max(1, -(-len(languages) // 64))
        bits = np.zeros((slots, words), np.uint64)
        for lang in range(len(languages)):
            for at in _slots(hashes[member[:, lang]], slots):
                bits[at, lang // 64] |= np.uint64(1) << np.uint64(lang % 64)
        fill = np.array([((bits[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        return cls(languages, bits, fill**HASHES)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """All languages that (seem to) contain each n-gram, as bits."""
        at = _slots(hashes, len(self.bits))
        out = self.bits[at[0]]
        for a in at[1:]:
            out = out & self.bits[a]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the share of its n-grams that the language's filter has.

        Hits are corrected for the filter's rate f of false positives, (hits - f n) / (n - f n), and
        held between 0 and 1; of equal shares the first name wins. Texts without a letter are
        ``und``, score 0, and so are all if no language was learned.
        """
        hashes, whose, letters = grams(texts)
        n = np.bincount(whose, minlength=len(texts))
        masks = self.masks(hashes)
        share = np.zeros((len(texts), max(1, len(self.languages))))
        for k, f in enumerate(self.false_rate):
            hit = ((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(np.float64)
            hits = np.bincount(whose, weights=hit, minlength=len(texts))
            share[:, k] = np.clip((hits - f * n) / np.maximum(1e-9, n * (1 - f)), 0, 1)
        best = share.argmax(axis=1)
        known = (letters > 0) & bool(self.languages)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], np.where(known, share[np.arange(len(texts)), best], 0.0)


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, min_share: float = MIN_SHARE, of_highest: float = MIN_OF_HIGHEST) -> Model:
    """Learn from rows with a non-null lang and an id that is not held out (null ids are left out).

    All such rows are counted by language; of each language a sample of ``sample_docs`` expected
    documents is learned from, chosen by a hash of the id, so reruns agree. N-grams are counted by
    documents on the executors; only those in ``min_share`` of a language's sample count, whatever the
    sizes of the table and of other languages, so one document is enough to learn from. Those in half
    of that share reach the driver, at most twice the mean number of n-grams a document over ``min_share``.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("d"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((1, 1), np.uint64))
    part = F.create_map(*[v for k, n in sizes.items() for v in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])
    rows = rows.where(F.pmod(F.xxhash64("d"), F.lit(1 << 20)) < F.element_at(part, F.col("lang")) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text"):
            names = t.column("lang").to_pylist()
            hashes, whose, _ = grams(t.column("text").to_pylist())
            order = np.argsort(whose, kind="stable")
            ends = np.cumsum(np.bincount(whose, minlength=len(names)))
            sets = [np.unique(x) for x in np.split(hashes[order], ends[:-1])]
            for name in dict.fromkeys(names):
                own = [x for x, of in zip(sets, names) if of == name]
                h, df = np.unique(np.concatenate(own), return_counts=True)
                h, df = np.append(h, np.uint64(0)), np.append(df, len(own))  # 0 stands for the documents themselves
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h)), pa.array(h.view(np.int64)), pa.array(df.astype(np.int64))], ["lang", "h", "df"])

    df = rows.mapInArrow(count, "lang string, h long, df long").groupBy("lang", "h").agg(F.sum("df").alias("df"))
    expected = F.create_map(*[v for k, n in sizes.items() for v in (F.lit(k), F.lit(float(min(n, sample_docs))))])
    # By half the expected number, since the sample may be smaller; exactly below.
    df = df.where((F.col("h") == 0) | (F.col("df") >= F.element_at(expected, F.col("lang")) * min_share * 0.5))
    got = df.toPandas()
    languages = sorted(sizes)
    total = dict(zip(got[got.h == 0].lang, got[got.h == 0].df))
    got = got[got.h != 0]
    got["share"] = got.df / got.lang.map(total).astype(float)
    got = got[(got.share >= min_share)]
    wide = got.pivot(index="h", columns="lang", values="share").reindex(columns=languages).fillna(0.0)
    member = (wide.to_numpy() > 0) & (wide.to_numpy() >= of_highest * wide.to_numpy().max(axis=1, initial=0.0)[:, None])
    return Model.build(languages, wide.index.to_numpy().astype(np.int64).view(np.uint64), member)


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Every input row with lang_pred and score; only ``text`` decides. No shuffle.

    Null texts and texts without a letter are ``und``; repeated rows get equal results; other columns
    stay, but for any called lang_pred or score, which the results replace.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows, schema = widened(docs, "lang_pred string, score double", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, text):
            langs, score = sent.value.predict(t.column(text).to_pylist())
            yield from t.append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(score)).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)
