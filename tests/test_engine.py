"""Detection, sources, evaluation, logs and streaming on small fixtures."""

import json
import os

import numpy as np
import pandas as pd
import pytest

from wavemill.operators import detect, evaluate, matching
from wavemill.operators.experiments import Log
from wavemill.schemas import SCORES_LOG
from wavemill.sources import ground_truth, logs, wav

SR = 8000


def tone(seconds: float, seed: int, f: float = 440.02, phase: float = 0.0) -> np.ndarray:
    """A tone in faint noise; 12.5 s of the default end at its crest."""
    t = np.arange(int(seconds * SR)) / SR
    return 0.3 * np.sin(2 * np.pi * f * t + phase) + np.random.default_rng(seed).normal(size=len(t)) * 1e-3


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    d = tmp_path_factory.mktemp("wavs")
    cut = np.concatenate([tone(12.5, 1), tone(12.5, 2, 900.0, -np.pi / 2)])
    (d / "cut.wav").write_bytes(wav.encode(np.stack([cut, cut], 1), SR))
    (d / "short.wav").write_bytes(wav.encode(tone(0.05, 3), SR))
    cases = {"cut": {"path": "cut.wav", "spliced": True, "splice_time_sec": 12.5, "tier": 1}, "short": {"path": "short.wav", "spliced": True, "splice_time_sec": [0.02, 0.01]}, "gone": {"path": "gone.wav", "spliced": False, "splice_time_sec": 3}}
    (d / "ground_truth.json").write_text(json.dumps(cases))
    return str(d)


def test_ground_truth(spark, data, tmp_path):
    got = {r.name: r for r in ground_truth.load_ground_truth(spark, data).collect()}
    assert got["short"].gt_times == [0.01, 0.02] and got["gone"].gt_times == [] and got["cut"].tier == 1 and got["short"].tier == 0
    with pytest.raises(FileNotFoundError):
        ground_truth.load_ground_truth(spark, str(tmp_path))


def test_detect_and_evaluate(spark, data):
    signals = wav.read_wav(spark, data)
    files, total = evaluate.evaluate(ground_truth.load_ground_truth(spark, data), signals)
    got = {r.name: r for r in files.collect()}
    assert got["cut"].status == "OK" and got["gone"].status == "SKIP"
    assert got["short"].status == "ERROR" and got["short"].fn == 2
    m = total.first()
    assert (m.tp, m.fp, m.fn, m.files) == (1, 0, 2, 3) and m.precision == 1.0


def test_tiles(spark):
    s = spark.createDataFrame([("a", 10, 1640, [float(i) for i in range(1640)]), ("b", 10, 30, [0.0] * 30)], "file_id string, sr int, n_samples long, samples array<float>")
    got = sorted((r.file_id, r.seg_no, r.offset_s, len(r.samples)) for r in detect.tiles(s).collect())
    assert got == [("a", 0, 0.0, 600), ("a", 1, 50.0, 600), ("a", 2, 100.0, 600), ("a", 3, 150.0, 140), ("b", 0, 0.0, 30)]


def test_match_against_loop(spark):
    rng = np.random.default_rng(3)
    gt = [(f, round(float(t), 1)) for f in range(30) for t in rng.uniform(0, 3, rng.integers(0, 6))]
    det = [(f, round(float(t), 1)) for f in range(30) for t in rng.uniform(0, 3, rng.integers(0, 6))]
    t = matching.ranked(spark.createDataFrame(gt, "file_id long, gt double"), "file_id", "gt", "gi")
    d = matching.ranked(spark.createDataFrame(det, "file_id long, det double"), "file_id", "det", "di")
    got = {r.file_id: (r.tp, r.fp, r.fn) for r in matching.match(t, d).collect()}
    for f in range(30):
        a, b = sorted(x for k, x in gt if k == f), sorted(x for k, x in det if k == f)
        free_a, free_b, tp = set(range(len(a))), set(range(len(b))), 0
        for _, i, j in sorted((abs(x - y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(x - y) <= 0.2):
            if i in free_a and j in free_b:
                free_a.discard(i), free_b.discard(j)
                tp += 1
        assert got.get(f, (0, 0, 0)) == (tp, len(b) - tp, len(a) - tp)


def test_tsv_log(spark, tmp_path):
    p = tmp_path / "results.tsv"
    p.write_text("commit\tval_bpb\tmemory_gb\tstatus\tdescription\na\t\t\tcrash\tfirst\nb\t1.0\t4\t keep \tx\nc\tbad\t4\tKEEP\ty\nd\t0.9\t4\tkeep\tz\ne\t0.95\t4\tdiscard\tw\nf\t0.8\t4\t\tv\n")
    log = Log(logs.read_tsv(spark, str(p), SCORES_LOG), "val_bpb")
    k = log.keep_rate().first()
    assert (k.total, k.n_keep, k.n_discard, k.n_crash, k.keep_rate) == (6, 3, 1, 1, 0.75)
    assert [(r.idx, r.best) for r in log.frontier().orderBy("idx").collect()] == [(0, 1.0), (1, None), (2, 0.9)]
    s = log.summary().first()
    assert s.baseline is None and s.best == 0.9 and s.best_exp == 3
    assert [r.label for r in log.labelled().orderBy("exp_no").collect()] == ["crash", "keep", "crash", "keep", "discard", "keep"]
    assert [(r.commit, r.rank) for r in log.hits().orderBy("rank").collect()] == [("c", 1), ("d", 2)]


def test_run_log(spark, tmp_path):
    (tmp_path / "run.log").write_text("  T1 OK   cut: TP=1 FP=0 FN=0 gt=[12.5] det=[12.5]\nsplice_f1: 0.712000\nprecision: 0.80\nelapsed: 61.5s\n")
    r = logs.read_run_log(spark, str(tmp_path)).first()
    assert (r.splice_f1, r.precision, r.recall, r.elapsed) == (0.712, 0.8, None, 61.5)
    assert logs.case_lines(spark, str(tmp_path)).first().name == "cut"


def test_stream_labels_like_batch(spark, tmp_path):
    from wavemill.streaming.hillclimb import label_stream

    src = tmp_path / "in"
    src.mkdir()
    pd.DataFrame({"series": ["s"] * 4, "exp_no": [0, 1, 2, 3], "metric": [0.1, 0.3, 0.2, None]}).to_json(src / "a.json", orient="records", lines=True)
    runs = spark.readStream.schema("series string, exp_no long, metric double").json(str(src))
    q = label_stream(runs).writeStream.format("memory").queryName("labels").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.label for r in spark.sql("select * from labels order by exp_no").collect()] == ["keep", "keep", "discard", "crash"]


def test_every_query_has_a_callable():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "match_eval" in e.queries()


def test_signal_queries_over_whole_series(spark, tmp_path):
    from wavemill.functions import kernels
    from wavemill.plans import catalog, signal_queries

    q, rng = catalog.queries(), np.random.default_rng(5)
    late = {300: 5000.0, 350: 1.0}
    v = [(i, i, "a", float(late.get(i, x)), i % 2) for i, x in enumerate(rng.uniform(10, 240, 400))] + [(1000 + i, i, "b", float(x), 2 + i) for i, x in enumerate(rng.uniform(1, 9, 30))]
    spark.createDataFrame(v, "event_id long, ts long, event_type string, value double, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    rows = lambda k: sorted(tuple(r) for r in q[k](spark, str(tmp_path)).collect())
    x = np.array([r[3] for r in v if r[2] == "a"])
    tiles = [x[i : i + signal_queries.TILE] for i in range(0, len(x), signal_queries.TILE)]
    steps = [np.abs(np.diff(kernels.high_pass(t, 16000))) for t in tiles]
    got = [r for r in rows("steepest_sample") if r[0] == "a"]
    assert [(r[1], r[2]) for r in got] == [(k, k * signal_queries.TILE + int(d.argmax())) for k, d in enumerate(steps)]
    assert np.allclose([r[3] for r in got], [d.max() for d in steps], atol=1e-5)
    assert rows("percentile_threshold")[0][2] == 400
    limits = {r[0]: r[1:] for r in rows("tail_fallback")}
    assert all(limits[k][1] is None and limits[k][0] == 10 for k in (0, 1)) and all(abs(limits[2 + i][1] - 1 - v[400 + i][3]) < 1e-5 for i in range(30))
    assert {r[1] for r in rows("quiet_side_reject")} == {n for n in range(2, 399) if min((x[max(0, n - 10) : n] ** 2).mean(), (x[n : n + 10] ** 2).mean()) > 10**3.6}
    assert max(r[2] for r in rows("peak_prominence")) == 500.0 - max(min(x[:300] // 10), min(x[301:] // 10))
    z = (x - x.mean()) / x.std()
    assert abs(dict(rows("tail_threshold"))["a"] - kernels.tail_threshold(z, len(z), 2.0)) < 1e-6  # the search ends where the likelihood is flat


def test_hotelling_over_all_components(spark, tmp_path):
    from wavemill.functions import kernels
    from wavemill.plans import catalog

    rng = np.random.default_rng(2)
    e = [(i, i % 3, [float(x) for x in rng.normal(i % 3, 1, 24).astype(np.float32)]) for i in range(90)]
    spark.createDataFrame(e, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name, p in (("hotelling", 2), ("hotelling_bands", 8)):
        sides = [np.stack([np.reshape(v, (p, -1)).mean(axis=1) for _, k, v in e if k == label]) for label in range(3)]
        want = {(k, k + 1): float(kernels.hotelling(sides[k][None], sides[k + 1][None])[0]) for k in (0, 1)}
        got = {tuple(r)[:2]: r.t2 for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def two_tones(cut, sr=8000, seconds=14):
    i = np.arange(sr * seconds)
    jump = np.where(i >= cut * sr, 2.2, 0.0) if cut else 0.0
    turn = 2 * np.pi / sr
    return 0.3 * np.sin(231 * turn * i + jump) + 0.2 * np.sin(1147 * turn * i - jump)


def test_command_line_finds_and_scores_splices(spark, tmp_path, capsys):
    import json

    from wavemill.__main__ import main
    from wavemill.sources import wav

    truth = {"cut": 6.25, "plain": None, "gone": 3.0}
    for name in ("cut", "plain"):
        (tmp_path / f"{name}.wav").write_bytes(wav.encode(two_tones(truth[name]), 8000))
    (tmp_path / "ground_truth.json").write_text(json.dumps({k: {"path": f"{k}.wav", "spliced": v is not None, "splice_time_sec": v, "tier": 2} for k, v in truth.items()}))
    lines = main(["evaluate", "--data-dir", str(tmp_path)])
    assert lines[0].startswith("  T2 OK   cut: TP=1 FP=0 FN=0") and lines[1] == "  SKIP gone" and lines[2].startswith("  T2 OK   plain: TP=0 FP=0 FN=0")
    assert lines[4:9] == ["splice_f1: 1.000000", "precision: 1.00", "recall: 1.00", "fp_rate: 0.00", "  TP=1 FP=0 FN=0 files=3 errors=0"]
    assert lines[9].startswith("elapsed: ") and lines[9].endswith("s") and "splice_f1" in capsys.readouterr().out
    found = main(["detect", str(tmp_path / "cut.wav")])
    assert len(found) == 1 and abs(float(found[0].split(": ")[1].split()[0]) - 6.25) < 0.02
    broken = tmp_path / "short"
    broken.mkdir()
    (broken / "s.wav").write_bytes(wav.encode(np.zeros(40), 8000))
    (broken / "ground_truth.json").write_text(json.dumps({"s": {"path": "s.wav", "spliced": True, "splice_time_sec": [1.0, 2.0]}}))
    lines = main(["evaluate", "--data-dir", str(broken)])
    assert lines[0] == "  ERROR s" and lines[-2] == "  TP=0 FP=0 FN=2 files=1 errors=1"


def test_detection_queries(spark):
    from wavemill.plans import catalog, detection_queries

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("no test data")
    q = catalog.queries()
    cuts = {r.path: r.gt_times for r in detection_queries.cases(spark, sf).collect()}
    found = q["detect_splices"](spark, sf).collect()
    # within the window of the refinement, whose filter begins at rest: now and then its first step is the steepest
    assert len(found) >= 10 and all(cuts[r.file_id] and abs(cuts[r.file_id][0] - r.t) < 0.4 for r in found)
    hits = q["detect_hits"](spark, sf).collect()
    assert all(abs(cuts[r.file_id][0] - r.coarse_t) < 0.1 for r in hits)
    assert all(r.error is None and r.score >= r.threshold - 1e-4 and r.mode in ("phase", "crossfade") for r in hits)
    files = q["evaluate_files"](spark, sf).collect()
    near = sum(abs(cuts[r.file_id][0] - r.t) <= 0.2 for r in found)
    assert sum(r.tp for r in files) == near > 8 and sum(r.fp for r in files) == len(found) - near and all(r.status == ("OK" if not r.fp + r.fn else "MISS") for r in files)
    lines = {r.line.split(":")[0]: r.line for r in q["evaluate_metrics"](spark, sf).collect()}
    assert lines["precision"] == f"precision: {near / len(found):.2f}"


def test_reports_runs_and_sinks(spark, tmp_path):
    from wavemill.operators import report, telemetry
    from wavemill.sources import logs

    x = spark.createDataFrame([(1.23456789, -0.5, None)], "a double, b double, c double")
    got = x.select(report.fixed("a", 6), report.fixed("a", 2, signed=True), report.fixed("b", 1, signed=True), report.fixed("c", 2), report.percent("b")).first()
    assert tuple(got) == ("1.234568", "+1.23", "-0.5", "", "-50.0%")
    per = spark.createDataFrame([("f", 1, "MISS", 1, 0, 2, [1.5, 2.0], [1.5])], "name string, tier int, status string, tp long, fp long, fn long, gt array<double>, det array<double>")
    assert report.file_lines(per, times=True).first().line == "  T1 MISS f: TP=1 FP=0 FN=2 gt=[1.5, 2.0] det=[1.5]"
    steps = spark.createDataFrame([(i, 2.0) for i in range(30)], "step int, dt double")
    timed = telemetry.running_time(steps)
    made = telemetry.until_budget(timed, 10.0)
    assert made.count() == 16 and telemetry.until_budget(timed, 0.0).count() == 12  # never before the step after the tenth
    s = telemetry.run_summary(made, 100, 3.0, 1000.0).first()
    assert (s.num_steps, s.training_seconds, s.total_tokens) == (16, 10.0, 1600) and abs(s.mfu_percent - 100 * 3 * 100 * 6 / 10 / 1000) < 1e-9
    assert [r.line for r in report.summary_lines(telemetry.run_summary(made, 100, 3.0, 1000.0)).collect()][-1] == "num_steps:        16"
    assert {r.name: r.value for r in telemetry.parameters(spark, depth=4).collect()}["depth"] == 4 and telemetry.accumulation(524288, 131072) == 4
    with pytest.raises(ValueError):
        telemetry.accumulation(100, 3)
    with pytest.raises(ValueError):
        telemetry.parameters(spark, nothing=1)
    for _ in range(2):
        logs.append_tsv(spark.createDataFrame([("a", 1.5)], "name string, f1 double").coalesce(1), str(tmp_path / "log"))
    files = [p.read_text() for p in (tmp_path / "log").glob("*.csv")]
    assert files == ["name\tf1\na\t1.5\n"] * 2


def test_budget_reached_exactly(spark):
    from wavemill.operators import telemetry

    # added as doubles one after the other, 100 times 0.03 is 2.999999999999995, and 30 times 0.1 is 3.0000000000000013
    rows = [("a", i, 0.03) for i in range(11 + 110)] + [("b", i, 0.1) for i in range(11 + 40)] + [("c", i, float("nan") if i == 13 else 0.5) for i in range(20)] + [("d", i, 1e25 if i == 12 else 0.5) for i in range(20)]
    timed = telemetry.running_time(spark.createDataFrame(rows, "run string, step long, dt double"), series=["run"])
    made = telemetry.until_budget(timed, 3.0, series=["run"])
    assert {r.run: r["count"] for r in made.groupBy("run").count().collect()} == {"a": 11 + 100, "b": 11 + 30, "c": 14, "d": 13}
    last = {r.run: r.elapsed for r in made.where("step = (case run when 'a' then 110 when 'b' then 40 when 'd' then 12 end)").collect()}
    assert last == {"a": 3.0, "b": 3.0, "d": 1e25}


def test_summary_of_a_run_that_ends_on_its_budget(spark, tmp_path):
    from wavemill.plans import catalog

    rows = [(i, 7, 0.6) for i in range(11 + 2510)]  # 2500 times 0.6 added as doubles is 1499.9999999999552
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["run_summary"](spark, str(tmp_path)).collect()
    assert [tuple(r)[:4] for r in got] == [(7, 2511, 1500.0, 2511 * 524288)]


def test_suppression_of_long_series(spark, monkeypatch):
    from threading import Timer

    from wavemill.operators import curves

    rng = np.random.default_rng(8)
    rows = [(k, int(n), float(rng.integers(0, 6))) for k in "abc" for n in np.cumsum(rng.integers(1, 9, 400))]
    rows += [("up", n, float(n)) for n in range(0, 900, 3)]  # one stretch, in which each peak but the last has a higher one near
    want = set()
    for k in ("a", "b", "c", "up"):
        kept = []
        for _, n, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1])):
            if all(abs(n - m) >= 7 for m in kept):
                kept.append(n)
        want |= {(k, n) for n in kept}
    peaks = spark.createDataFrame(rows, "ch string, n int, y double").repartition(5)
    for samples in (1, 100, 1 << 18):  # of one stretch and of many
        monkeypatch.setattr(curves, "STRETCHES", samples)
        got = curves.suppressed(peaks, ["ch"], 7, x="y")
        assert got.dtypes == [("ch", "string"), ("n", "int")] and {tuple(r) for r in got.collect()} == want
    # every third of 1,200,000 peaks stays, and the first, which none is too near: far from done in this time if each is held against all that stay
    x = spark.range(1200000).selectExpr("'a' as ch", "int(id * 10) as n", "double(id % 3) as x")
    late = Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        r = curves.suppressed(x, ["ch"], 20).selectExpr("count(*) as n", "count_if(n % 30 = 20) as third", "min(n) as first").first()
    finally:
        late.cancel()
    assert tuple(r) == (400001, 400000, 0)


def test_chart_frames(spark):
    from wavemill.operators.experiments import Log

    rows = [("a", 0, 3.0, "KEEP"), ("a", 1, None, "CRASH"), ("a", 2, 2.0, "KEEP"), ("a", 3, 9.0, "DISCARD"), ("b", 0, None, "KEEP"), ("b", 1, 1.0, "DISCARD")]
    log = Log(spark.createDataFrame(rows, "series string, exp_no long, metric double, status string"), "metric", True, ["series"])
    assert [tuple(r) for r in log.best_row().collect()] == [("a", 2, 2.0, "KEEP")]
    assert sorted(tuple(r) for r in log.series_of("DISCARD").collect()) == [("a", 2, 9.0), ("b", 1, 1.0)]
    axes = {r.series: (r.low, r.high) for r in log.axes().collect()}
    assert np.allclose(axes["a"], (1.85, 3.15))
    assert log.head(2).count() == 4
