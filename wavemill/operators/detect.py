"""Splice detection: hard cuts by phase, crossfades by band power, each hit with the test behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

WINDOW_S, STEP_S, SLACK_S, SHORTEST_S = 60.0, 50.0, 5.0, 10.0
GAP_S = 1.0
HIT = "file_id string, mode string, seg_no int, coarse_t double, score double, threshold double, t double, error string"


def tiles(signals: DataFrame) -> DataFrame:
    """file_id, sr, seg_no, offset_s, samples: overlapping windows of long files, short files whole.

    Windows of 60 s every 50 s; one of under 10 s ends the tiling. Segments are rows, so one long file
    is spread over tasks.
    """
    window, step, shortest = ((F.col("sr") * s).cast("int") for s in (WINDOW_S, STEP_S, SHORTEST_S))
    n = F.size("samples")
    whole = n / F.col("sr") <= WINDOW_S + SLACK_S
    starts = F.when(whole, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), n - 1, F.greatest(step, F.lit(1))), lambda p: n - p >= shortest))
    x = signals.where(n > 0).select("file_id", "sr", "samples", whole.alias("_w"), F.posexplode(starts).alias("seg_no", "_p"))
    cut = F.when(F.col("_w"), F.col("samples")).otherwise(F.slice("samples", F.col("_p") + 1, window))
    return x.select("file_id", "sr", "seg_no", (F.col("_p") / F.col("sr")).alias("offset_s"), cut.alias("samples"))


def _loud(x: np.ndarray, sr: int, t: float, radius_s: float = 0.5, least_db: float = -35.0) -> bool:
    """Whether both sides of ``t`` are loud; false at the ends of the signal."""
    c, r = int(t * sr), int(radius_s * sr)
    for side in (x[max(0, c - r) : c], x[c : min(len(x), c + r)]):
        if len(side) < sr // 10 or 20 * np.log10(max(np.sqrt(np.mean(side**2)), 1e-10)) <= least_db:
            return False
    return True


def phase_hits(x: np.ndarray, sr: int, offset_s: float = 0.0) -> list[tuple[float, float, float, float]]:
    """coarse_t, score, threshold, t of the hard cuts of one segment, two at most."""
    hop_s = 0.010
    hop = max(1, int(sr * 10 / 1000))
    z = K.zscore(K.phase_discontinuity(K.stft(x, 1024, hop, padded=True), sr, 1024, hop))
    voiced = K.silence_mask(x, sr, 10)[: len(z)]
    z = z[: len(voiced)] * voiced
    limit = K.tail_threshold(z[voiced > 0.5], int((voiced > 0.5).sum()), alpha=2.0)
    found = [float(i) * hop_s for i in K.peaks(z, limit, int(5.0 / hop_s), 0.2 * limit)]
    # The frame of a peak is taken from its time, as the results to match do: now and then one less.
    at = lambda t: z[min(int(t / hop_s), len(z) - 1)]
    if len(found) > 2:
        found = [found[i] for i in sorted(np.argsort([at(t) for t in found], kind="stable")[-2:])]
    return [(t + offset_s, float(at(t)), limit, K.refine(x, sr, t, 0.3) + offset_s) for t in found if _loud(x, sr, t)]


def crossfade_hits(x: np.ndarray, sr: int) -> list[tuple[float, float, float, float]]:
    """coarse_t, score, threshold, t of the two strongest crossfades of a whole file."""
    hop_s, test_s, side_s = 0.020, 0.5, 5.0
    bands = K.band_powers(x, sr, 8, 0.050, hop_s)
    w, step = int(side_s / hop_s), int(test_s / hop_s)
    n = bands.shape[1]
    if n < 2 * w + 1:
        return []
    centres = np.arange(w, n - w, step)
    if not len(centres):
        return []
    rows = np.lib.stride_tricks.sliding_window_view(bands.T, w, axis=0).transpose(0, 2, 1)
    times = centres * hop_s
    scores = np.concatenate([K.hotelling(rows[c - w], rows[c]) for c in np.array_split(centres, -(-len(centres) // 256))])
    voiced = K.silence_mask(x, sr, 500)
    z = K.zscore(scores) * (np.interp(times, np.arange(len(voiced)) * 0.5, voiced) > 0.5)
    limit = max(float(np.percentile(z, 99.9)) if len(z) > 10 else 4.0, 4.0)
    p = K.peaks(z, limit, int(5.0 / test_s), 0.2 * limit)
    p = np.sort(p[np.argsort(-z[p], kind="stable")[:2]])
    return [(float(times[i]), float(z[i]), limit, K.refine(x, sr, float(times[i]), 1.0)) for i in p]


def _rows(mode: str, hits: Callable[..., list]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [c.split()[0] for c in HIT.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                seg, offset = (r.seg_no, (r.offset_s,)) if mode == "phase" else (0, ())
                try:
                    out += [(r.file_id, mode, seg, *h, None) for h in hits(np.asarray(r.samples, np.float32), int(r.sr), *offset)]
                except Exception as e:  # a file that a test cannot handle is reported, and the others go on
                    out.append((r.file_id, mode, seg, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=names)

    return run


def raw_hits(signals: DataFrame) -> DataFrame:
    """Every hit of both tests, and a row with ``error`` where one failed."""
    phase = tiles(signals).mapInPandas(_rows("phase", phase_hits), HIT)
    fade = signals.select("file_id", "sr", "samples").mapInPandas(_rows("crossfade", crossfade_hits), HIT)
    return phase.unionByName(fade)


def merged(hits: DataFrame, gap: float = GAP_S) -> DataFrame:
    """Of each file's hits in time order, those more than ``gap`` after the last one kept.

    Phase hits are thinned among themselves first, as segments overlap, then both modes together; the
    hit kept keeps its row. The fold compares with the last *kept* hit, unlike a session window. A
    file's hits are few: two a segment and two.
    """
    row = F.struct("t", "mode", "seg_no", "coarse_t", "score", "threshold")
    none = F.expr("cast(array() as array<struct<t: double, mode: string, seg_no: int, coarse_t: double, score: double, threshold: double>>)")
    last = lambda arr: F.aggregate(F.array_sort(arr), none, lambda kept, h: F.when(F.size(kept) == 0, F.array(h)).when(h["t"] - F.get(kept, F.size(kept) - 1)["t"] > gap, F.concat(kept, F.array(h))).otherwise(kept))
    by = hits.where("t is not null").groupBy("file_id").agg(F.collect_list(F.when(F.col("mode") == "phase", row)).alias("p"), F.collect_list(F.when(F.col("mode") != "phase", row)).alias("c"))
    return by.select("file_id", F.inline(last(F.concat(last(F.col("p")), F.col("c"))))).select("file_id", "mode", "seg_no", "coarse_t", "score", "threshold", "t")


def detect(signals: DataFrame) -> DataFrame:
    """The splices of each file, in the columns of ``merged``; files with an error have none."""
    hits = raw_hits(signals)
    bad = hits.where("error is not null").select("file_id").distinct()
    return merged(hits.join(bad, "file_id", "left_anti"))
