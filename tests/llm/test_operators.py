"""The operators against brute force, on small tables with nulls, ties, repeats, long and empty texts."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavemill.llm import bpe, chat_format, fingerprint, jaccard_join, language_id, license_scan, mixing, queries, substring_dedup, topk, url_filter
from wavemill.llm import words as words_module
from wavemill.llm.components import connected_components
from wavemill.llm.storage import Workspace

R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdefgé") for _ in range(R.randint(2, 6))) for _ in range(300)]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def corpus():
    base, passage = prose(120), prose(40)
    texts = [prose(R.randint(0, 80)) for _ in range(25)] + [base] * 3 + [base.replace(" ", "\n", 5)]
    for k in (1, 2, 3, 6, 12):
        w = base.split()
        for _ in range(k):
            w[R.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    texts += [f"{prose(30)} {passage}\t{prose(20)}" for _ in range(6)] + [passage, passage + " " + passage, "", None, " \n", "a b", "A  b", "one", prose(3000)]
    return list(enumerate(texts))


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(i, t, "x", "en", f"s{i % 3}" if i % 7 else None, 1) for i, t in DOCS]
    return spark.createDataFrame(extra, "doc_id long, text string, h string, lang string, source string, n long").repartition(5)


def empty(df):
    return df.where("1 = 0")


def words(t):
    return (t or "").encode().split()


def test_substring_dedup(spark, docs):
    seen, want = set(), {}
    for i, t in DOCS:
        w, gone = words(t), set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            gone |= set(range(s, s + 20)) if k in seen else set()
            seen.add(k)
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    for batches in (1, 2, 7):
        out = substring_dedup.deduplicate(docs, Workspace(spark, "t"), batches=batches, cut=True).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == want
        assert all(hashlib.sha256(b" ".join(words(r.text))).hexdigest() == r.kept_sha256 for r in out) and out[0].h == "x"
    assert substring_dedup.deduplicate(empty(docs), Workspace(spark, "t")).count() == 0
    twice = docs.where("doc_id = 25").union(docs.where("doc_id = 25")).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.n_removed for r in substring_dedup.deduplicate(twice, Workspace(spark, "t")).collect()] == [0, 0]


def regular(n, a, b):
    """The first n letters of the Thue-Morse word over a and b: polynomials modulo 2**64 collide on it and its complement."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_regular_words_and_sequences_do_not_collide(spark):
    one, two = regular(1024, "a", "b"), regular(1024, "b", "a")
    rest = prose(19)
    texts = [f"{one} {rest}", f"{two} {rest}", one, two, regular(4096, "x ", "y ").strip(), regular(4096, "y ", "x ").strip()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.deduplicate(df, Workspace(spark, "t"), batches=2).collect()}
    want, seen = {}, set()
    for i, t in enumerate(texts):
        w, gone = words(t), set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            gone |= set(range(s, s + 20)) if k in seen else set()
            seen.add(k)
        want[i] = (len(w), len(gone))
    assert got == want and got[1] == (20, 0)
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, Workspace(spark, "t")).collect()}
    shingles = [len(jaccard_join.real_set(t)) for t in texts]
    assert near == {0: (16, 0), 1: (16, 0) if 15 / 17 >= 0.75 else (16, 1), 2: (1, 2), 3: (1, 3), 4: (shingles[4], 4), 5: (shingles[5], 4)}


def test_hashes_that_all_collide_leave_the_words_to_decide(monkeypatch):
    monkeypatch.setattr(jaccard_join, "shingle_sets", lambda texts: [np.array([1, 2], np.uint64)] * len(texts))
    pairs = pa.RecordBatch.from_pydict({"a": [1, 1], "b": [2, 3], "left": ["p q r s t u"] * 2, "right": ["a b c d e f", "P q r s t U"]})
    assert [r.to_pydict() for r in jaccard_join._overlaps(iter([pairs]))] == [{"a": [1], "b": [3]}]
    monkeypatch.setattr(substring_dedup, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = [prose(50), prose(60)]
    docs = pa.RecordBatch.from_pydict({"d": [1, 2], "k": [0, 0], "text": texts, "new": [True, True], "hits": [list(range(43)), list(range(53))]})
    found = [r for b in substring_dedup._window_rows(iter([docs])) for r in b.to_pylist()]
    assert len({(r["w"], r["v"]) for r in found}) == 31 + 41 and all(r["starts"] is None for r in found)


def test_words_in_numpy():
    text = np.frombuffer(b"x  y\tzz", np.uint8)
    starts, ends, _ = words_module.spans(text, np.array([0, 7]))
    assert words_module.joined(text, starts, ends)[0] == b"x y zz "
    long = np.frombuffer(b" ".join(b"a" * n for n in (7, 8, 9, 63, 64, 65, 500)), np.uint8)
    starts, ends, _ = words_module.spans(long, np.array([0, len(long)]))
    h = words_module.word_hashes(long, starts, ends)
    assert len(np.unique(h)) == 7 and len(np.unique(words_module.window_hashes(h, 3))) == 5
    assert words_module.window_hashes(h, 5)[1] == words_module.sequence_hash(h[1:6])


def test_index_compacts_and_clashing_columns_stay(spark):
    passage = prose(25)
    own = lambda i, k: " ".join(f"{k}{i}.{j}" for j in range(10))
    rows = [(i, f"{own(i, 'a')} {passage} {own(i, 'b')}", "kept", i) for i in range(40)] + [(7, None, "kept", 0), (None, passage, "kept", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _dedup_d string, n_words int")
    ws = Workspace(spark, "t")
    keyed = df.select(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.xxhash64("text").alias("k"), "text").where("text is not null").cache()
    index, runs = substring_dedup.FingerprintIndex(ws, fanout=2), {"anchors": [], "windows": []}
    for i in range(0, 41, 6):
        index.repeats(keyed.where(f"d >= {i - 1} and d < {i + 5}"), keyed.where(f"d < {i + 5}"))
        for kind in runs:
            runs[kind].append(len(index.runs[kind]))
    assert index.compactions >= 4 and max(runs["anchors"]) <= 2 and max(runs["windows"]) <= 2
    out = substring_dedup.deduplicate(df, Workspace(spark, "t")).collect()
    assert {r.doc_id: r.n_removed for r in out if r.text} == {None: 0, **{i: 25 for i in range(40)}} and all(r._dedup_d == "kept" for r in out)
    assert not [t.name for t in spark.catalog.listTables()]


def sets():
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    for i, t in DOCS:
        w = (t or "").encode().translate(fold).split()
        yield i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def test_jaccard_join(spark, docs):
    s = dict(sets())
    link = {(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])}
    comp = {i: i for i in s}
    for _ in s:
        for a, b in link:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = jaccard_join.near_duplicates(docs, Workspace(spark, "t")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s[i]), comp[i]) for i in s}
    join = jaccard_join.JaccardJoin(docs, Workspace(spark, "t"))
    rep = {r.d: r.rep for r in join.members.collect()}
    pairs = {frozenset(r) for r in join.links().collect()}
    assert pairs == {frozenset((rep[a], rep[b])) for a, b in link if rep[a] != rep[b]}
    assert jaccard_join.near_duplicates(empty(docs), Workspace(spark, "t")).count() == 0


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "u long, v long"), Workspace(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


RANKS = {bytes([i]): i for i in range(256)} | {t: 256 + k for k, t in enumerate([b"ab", b"bc", b"abc", b"aa", b"aaa", b"aab", b"ca", b"bca", b"cab", b"abca"])}
PATTERN = r""" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def test_bpe_against_the_library(spark, docs):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    odd = ["".join(R.choice("abc") for _ in range(R.randint(0, 30))) for _ in range(300)]
    got = bpe.Vocabulary(RANKS).replay([w.encode() for w in odd])
    assert all(list(got[w.encode()]) == enc.encode_ordinary(w) for w in odd)
    for ws in (None, Workspace(spark, "t")):
        for r in bpe.encode(docs, RANKS, PATTERN, ws).collect():
            ids = enc.encode_ordinary(r.text or "")
            assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert bpe.encode(empty(docs), RANKS, PATTERN, ws).count() == 0
    few = bpe.common_words(docs, RANKS, PATTERN, Workspace(spark, "t"), most=20)
    assert 0 < len(few) <= 20 and all(list(few[w]) == enc.encode_ordinary(w.decode()) for w in few)


def test_op7_against_the_library(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    ranks, pattern = queries.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = ["".join(R.choice(["ab", "é", " ", "  ", "\n", "12", "'ll", "\u3042\u3044", "\U0001f600", "-", "\x1c", "qzx" * 9, "a" * 70]) for _ in range(R.randint(0, 60))) for _ in range(300)]
    path = "/root/testdata/sf0.01/documents.parquet"
    given = [(r.doc_id, r.text) for r in spark.read.parquet(path).select("doc_id", "text").collect()] if os.path.exists(path) else []
    texts = given + [(10**9 + i, t) for i, t in enumerate([*odd, None, "<|endoftext|>", "x" * 50_000])]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_bpe(spark, str(tmp_path)).collect()}
    assert public_tokenizers.PATTERN == pattern and len(got) == len(texts)
    for i, t in texts:
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_ranks_file(tmp_path):
    (tmp_path / "r").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in RANKS.items()))
    assert bpe.load_ranks(str(tmp_path / "r")) == RANKS


def test_chat_format(spark):
    alphabet = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "é", "x", "/", "s>"]
    text = lambda: "".join(R.choice(alphabet) for _ in range(R.randint(0, 12)))
    rows = [(c, t, R.choice(["user", "assistant", "<s>", None]), text() or None) for c in [*range(40), None] for t in range(R.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    formatted = chat_format.format_conversations(df)
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for r in formatted.collect():
        turns = [(a, b) for _, a, b in sorted(by[r.conv_id])]
        assert [(a.decode(), b.decode()) for a, b in chat_format.parse(bytes(r.formatted))] == turns
    for r in chat_format.digests(formatted).collect():
        turns = sorted(by[r.conv_id])
        loss = "".join(x for _, a, x in turns if a == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
    assert chat_format.digests(chat_format.format_conversations(empty(df))).count() == 0


def test_mixing(spark, docs):
    out = mixing.mix(docs, Workspace(spark, "t")).toPandas()
    size = {i: len(words(t)) for i, t in DOCS}
    name = {i: f"s{i % 3}" if i % 7 else None for i, _ in DOCS}
    total = collections.Counter()
    for i, s in size.items():
        total[name[i]] += s
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        target = {s: 2 * total[s] if s in full else weight[s] * rest / sum(weight[x] for x in order if x not in full) for s in order}
        if not (new := {s for s in order if target[s] > 2 * total[s]} - full):
            break
        full |= new
    taken = collections.Counter()
    for r in out.itertuples():
        assert r.size == size[r.doc_id] and r.source_size == total[name[r.doc_id]] and abs(r.target - target[name[r.doc_id]]) < 1e-6 and r.times <= 2
        taken[name[r.doc_id]] += r.times * r.size
    assert all(abs(taken[s] - target[s]) <= max(size.values()) / 2 for s in order)
    rows = mixing.curriculum(docs, Workspace(spark, "t")).collect()
    assert len(rows) == out.times.sum() and rows[0].h == "x"
    assert mixing.mix(empty(docs), Workspace(spark, "t")).count() == 0


def brute_mix(rows, targets):
    """(doc_id, epoch, position) of every taking; rows: doc_id, source, size, hash; targets: by source, with its schedule."""
    out = []
    for source, (target, (a, b)) in targets.items():
        own, base, plan = sorted((r for r in rows if r[1] == source), key=lambda r: (r[3], r[0])), 0, []
        total = sum(r[2] for r in own)
        for i, _, n, h in own:
            middle, times = base + n / 2, 0
            while n and times < 2 and middle + times * total < target:
                times += 1
            plan.append([i, n, h, middle, times])
            base += n
        miss = target - sum(x[1] * x[4] for x in plan)
        able = [x for x in plan if x[1] and (x[4] < 2 if miss > 0 else x[4]) and abs(abs(miss) - x[1]) < abs(miss)]
        if able:
            min(able, key=lambda x: (abs(abs(miss) - x[1]), x[2], x[0]))[4] += 1 if miss > 0 else -1
        grid = np.linspace(0, 1, 200_001)
        demand = target * (a * grid + (b - a) * grid**2 / 2) / ((a + b) / 2)
        out += [(x[0], e, float(np.interp(x[3] + e * total, demand, grid))) for x in plan for e in range(x[4])]
    return out


def test_takings_and_positions_against_brute_force(spark, docs, tmp_path):
    twice = docs.union(docs.where("doc_id % 5 = 0")).withColumns({"position": F.lit("p"), "epoch": F.col("doc_id"), "_row": F.monotonically_increasing_id()})
    twice.write.parquet(str(tmp_path / "documents.parquet"))
    twice = spark.read.parquet(str(tmp_path / "documents.parquet"))
    facts = twice.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("h")).collect()
    size = {i: len(words(t)) for i, t in DOCS}
    rows = [(r.doc_id, r.source, size[r.doc_id], r.h) for r in facts]
    mixed = mixing.mix(twice, Workspace(spark, "t")).collect()
    goal = {r.source: r.target for r in mixed}
    names = sorted(goal, key=lambda s: (s is None, s or ""))
    want = sorted(brute_mix(rows, {s: (goal[s], mixing.SCHEDULE[k % 3]) for k, s in enumerate(names)}))
    got = mixing.curriculum(twice, Workspace(spark, "t"), placed=True).collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and got[0].asDict().keys() == {*twice.columns}
    places = sorted((r.doc_id, r.epoch, r.position) for r in got)
    assert [p[:2] for p in places] == [w[:2] for w in want] and np.allclose([p[2] for p in places], [w[2] for w in want], atol=1e-4)
    words_of = collections.Counter()
    for i, _, _ in want:
        words_of[i] += size[i]
    out = queries.op4_mixing(spark, str(tmp_path)).collect()
    op4 = collections.Counter()
    for r in out:
        op4[r.doc_id] += r.taken
        assert (r.first_position is None) == (r.taken == 0) and r.taken in (0, r.size, 2 * r.size)
    assert len(out) == len(rows) and +op4 == +words_of
    plain = mixing.curriculum(twice, Workspace(spark, "t"))
    assert plain.columns == twice.columns and {r.position for r in plain.collect()} == {"p"}
    assert sorted(r._row for r in plain.collect()) == sorted(r._row for r in got)  # repeated rows: the same ones again


def test_op4_rows_come_from_the_training_order(spark, docs, tmp_path):
    void = spark.createDataFrame([(900, ""), (901, None)], "doc_id long, text string").withColumn("source", F.lit("void"))
    own = docs.select("doc_id", "text", "source").unionByName(void).union(docs.select("doc_id", "text", "source").where("doc_id % 9 = 0"))
    own.write.parquet(str(tmp_path / "documents.parquet"))
    own = spark.read.parquet(str(tmp_path / "documents.parquet"))
    size = collections.Counter({i: len(words(t)) for i, t in DOCS})
    rows = [(r.doc_id, r.source, size[r.doc_id], r.h) for r in own.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("h")).collect()]
    total = collections.Counter()
    for _, s, n, _ in rows:
        total[s] += n
    want = brute_mix(rows, {s: x for s, x in brute_targets(total).items() if x[0]})
    placed = mixing.placings(own, Workspace(spark, "t")).collect()
    line = sorted((r for r in placed if r.place is not None), key=lambda r: r.place)
    assert [r.place for r in line] == list(range(len(want)))
    assert line == sorted(line, key=lambda r: (r.position, r.doc_id, r.epoch)) and all(r.words == size[r.doc_id] for r in line)
    assert [(r.doc_id, r.epoch, r.position) for r in line] == [(r.doc_id, r.epoch, r.position) for r in mixing.curriculum(own, Workspace(spark, "t"), placed=True).collect()]
    assert sorted((r.doc_id, r.epoch) for r in line) == sorted(w[:2] for w in want)
    key, ends = lambda r: (r._g, r._b, r._row), collections.defaultdict(list)
    for r in line:
        ends[key(r)].append(r)
    made = sorted((x[0].doc_id, x[0].place, x[-1].place, x[0].position, x[-1].position, sum(r.words for r in x)) for x in ends.values())
    out = queries.op4_mixing(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.first_place, r.last_place, r.first_position, r.last_position, r.taken) for r in out if r.taken) == made
    rest = [r for r in out if not r.taken]
    assert len(out) == len(rows) and all(r.first_place is r.last_place is r.last_position is None for r in rest) and {900, 901} <= {r.doc_id for r in rest}
    assert all(r.size == size[r.doc_id] and r.taken == 0 for r in rest)


def test_order_of_taking_does_not_change_with_the_number_of_buckets(spark, docs):
    few, many = (mixing.mix(docs, Workspace(spark, "t"), per_bucket=n).select("doc_id", "times", "_mid").collect() for n in (10_000, 1))
    assert sorted(few) == sorted(many)


def test_license_scan(spark):
    t = license_scan.TEMPLATES
    texts = [(1, f"x\n{t['MIT'].upper()}\ny"), (2, None), (3, ""), (4, "Licensed under the Apache license version 2.0 now"), (5, t["CC-BY-NC-4.0"]), (6, "Released under no License"), (7, "Permission is hereby\ngranted, free of charge, to any person obtaining a copy of this software and associated documentation files")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("hits", F.lit(1))
    got = {r.doc_id: [(h.segment, h.licence) for h in r.hits] for r in license_scan.scan(df).collect()}
    assert got == {1: [(1, "MIT")], 2: [], 3: [], 4: [(0, "Apache-2.0")], 5: [(0, "CC-BY-NC-4.0")], 6: [], 7: [(-1, "MIT-notice"), (1, "MIT-notice")]} or got[7][0] == (-1, "MIT-notice")
    assert license_scan.scan(empty(df)).count() == 0


def test_license_windows(spark):
    t, filler = license_scan.TEMPLATES, "\n".join(f"line {i} has other words" for i in range(30))
    bsd, apache = t["BSD-3-Clause"].replace("with or without ", "with or without\n"), t["Apache-2.0"]
    inline = f"This page explains how things are. {apache} All other rights are held by those who wrote it"
    texts = [
        (1, f"{filler}\n{bsd}:\n{filler}"), (2, f"{inline} {filler}".replace("\n", " ")), (3, f"{filler}\n{inline}"), (4, f"{filler}\n{apache}\n{t['MIT']}"), (5, f"{apache} {apache} {t['MIT']} " * 3),
        (6, f"{filler}\nReleased under no licence, under the usual terms, the MIT way"), (7, f"{filler}\n{t['ISC'].upper()} {t['MIT']}\n{t['GPL-3.0'].replace(' ', chr(10))}"),
    ]
    got = {r.doc_id: [(h.segment, h.licence, round(h.dice, 9)) for h in r.hits] for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1] == [(30, "BSD-3-Clause", 1.0)] and got[2] == [(0, "Apache-2.0", 1.0)] and got[3] == [(30, "Apache-2.0", 1.0)]
    assert got[4] == [(30, "Apache-2.0", 1.0), (31, "MIT", 1.0)] and got[5] == [(0, "Apache-2.0", 1.0)] * 6 + [(0, "MIT", 1.0)] * 3 and got[6] == []
    assert [h[:2] for h in got[7]] == [(30, "ISC"), (30, "MIT"), (31, "GPL-3.0")]


def plain_digest(text):
    """Length code and quartile codes of a text, by loops."""
    data, cells = text.encode(), [0] * 256
    for tables, at in zip(fingerprint._TABLES.tolist(), [(0, 1, 2), (0, 1, 3), (0, 2, 4), (0, 3, 4)]):
        for i in range(len(data) - at[2]):
            cells[tables[0][data[i]] ^ tables[1][data[i + at[1]]] ^ tables[2][data[i + at[2]]]] += 1
    ranked = sorted(cells)
    codes = [sum(c > ranked[q] for q in (63, 127, 191)) for c in cells]
    return min(255, math.floor(8 * math.log2(len(data) + 1))), codes


def plain_likeness(a, b):
    score = sum(6 if abs(x - y) == 3 else abs(x - y) for x, y in zip(a[1], b[1])) + 2 * max(0, abs(a[0] - b[0]) - 1)
    return 1 - min(1, score / 260)


def plain_hex(d):
    return bytes([d[0]] + [d[1][i] << 6 | d[1][i + 1] << 4 | d[1][i + 2] << 2 | d[1][i + 3] for i in range(0, 256, 4)]).hex()


def test_fingerprint(spark, docs):
    order = sorted(DOCS, reverse=True)
    plain = {t: plain_digest(t) for t in {t or "" for _, t in DOCS}}
    got = {r.doc_id: r for r in fingerprint.with_next(docs, parts=6).collect()}
    alone = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs.withColumn("fingerprint", F.lit(1))).collect()}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        other = plain_digest(e)
        assert got[i].fingerprint == alone[i] == plain_hex(plain[t]) and got[i].edited_fingerprint == plain_hex(other)
        assert abs(got[i].near_edited - plain_likeness(plain[t], other)) < 1e-9 and abs(got[i].near_next - plain_likeness(plain[t], plain[n])) < 1e-9
    assert fingerprint.with_next(empty(docs)).count() == 0 and fingerprint.fingerprints(empty(docs)).count() == 0
    codes = fingerprint.decode([got[25].fingerprint, got[29].fingerprint])
    assert fingerprint.encode(*codes) == [got[25].fingerprint, got[29].fingerprint]
    one = fingerprint.with_next(docs.where("doc_id = 25")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprint_of_ids_that_many_rows_share(spark):
    rows = [(None, prose(8)) for _ in range(40)] + [(5, prose(8)) for _ in range(30)] + [(5, "same text")] * 7 + [(i, prose(6)) for i in range(10, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ties = {r.text: r.h for r in df.select("text", F.hash("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), ties[r[1]], r[1]))
    want = sorted((str(i), len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][1][: len(t) // 3]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    for parts in (1, 4, 12):
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in fingerprint.with_next(df, parts=parts).collect()) == want
    planned = fingerprint.with_next(df, parts=12).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in planned) < 40  # null ids and id 5 are in several ranges


def test_url_filter(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    page = [
        (1, "http://A.Example.com/en/1", None), (2, "http://www.example.com/en/1?x", ""), (3, "http://x.org/a", '<LINK rel="canonical" href="http://b.net/es/1">'),
        (4, "http://y.org/b", '<meta http-equiv="refresh" content="0; url=http://x.org/a#t">'), (5, "http://z.org/c", "<link href='/d' rel='canonical'>"), (6, "nothing", None), (7, None, "x"),
        (8, "http://w.org/", '<link rel=canonical href="http://q.com/"><meta http-equiv=refresh content="1;url=http://b.net/es/9">'), (4, "http://y.org/b", None), (9, "http://b.net/es/1", None), (10, "http://from.org/", None),
    ]
    df = spark.createDataFrame(page, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://from.org/", "http://y.org/b"), (None, "x")], "from_url string, to_url string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(df, Workspace(spark, "t"), rules, redirects).collect() if r.page_id not in (4,))
    assert got == [(1, "example.com/en/", "block"), (2, "www.example.com/en/", "allow"), (3, None, "block"), (5, None, "allow"), (6, None, "allow"), (7, None, "allow"), (8, None, "allow"), (9, "net/es/", "block"), (10, None, "block")]
    assert url_filter.filter_urls(empty(df), Workspace(spark, "t"), rules).count() == 0


def test_url_filter_forms_of_links(spark):
    bad = "http://b.net/es/1"
    link = lambda t: f'<link rel="canonical" href="{t}">'
    page = [
        ("http://a.org/1", link("//b.net/es/1"), "block"), ("http://b.net/fr/2", link("../es/1"), "block"), ("http://b.net/fr/x/3", link("./../../es/1?q=1"), "block"), ("http://b.net", link("es/1#t"), "block"),
        ("http://c.org/4", f"<meta content='0;url={bad}' http-equiv='refresh'>", "block"), ("http://c.org/5", link("http://d.org/") + link(bad), "block"), ("http://c.org/6", f'<META content="0; URL={bad}" HTTP-EQUIV="Refresh"/>', "block"),
        ("http://c.org/7", link("mailto:x@b.net") + link("javascript:go()"), "allow"), ("http://c.org/8", link("/es/1?u=" + bad), "allow"), ("http://c.org/9", f"<meta content='0;url={bad}' name='refresh'>", "allow"), ("http://c.org/10", link("?x=1"), "allow"), (None, link("x"), "allow"),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(page)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, Workspace(spark, "t"), [("block", "b.net", "/es/")]).collect()}
    assert got == {i: v for i, (_, _, v) in enumerate(page)}


ALIAS_RULES = [("block", "b.net", "/es/"), ("allow", "ok.org", "/"), ("block", "ok.org", "/no/"), ("block", "cdn.b.net", "/")]


def brute_verdicts(page, redirects, rules):
    """url -> verdict, with a union-find and the standard library's resolution of links."""
    from urllib.parse import urldefrag, urljoin, urlsplit

    def key(u):
        if not u or not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", u):
            return None
        scheme, _, rest = urldefrag(u)[0].partition("://")
        host = re.match("[^/?]*", rest)[0]
        return f"{scheme.lower()}://{host.lower()}{rest[len(host):]}"

    def rule(u):
        s = urlsplit(u or "")
        fits = [(len(h + p), a == "allow", a) for a, h, p in rules if (s.netloc.lower() == h or s.netloc.lower().endswith("." + h)) and s.path.startswith(p)]
        return max(fits)[2] if fits else None

    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for u, targets in page:
        for t in targets:
            if key(u) and (full := key(urljoin(u, t))):
                up[find(key(u))] = find(full)
    for u, v in redirects:
        if key(u) and key(v):
            up[find(key(u))] = find(key(v))
    said = collections.defaultdict(set)
    for x in list(up):
        said[find(x)].add(rule(x))
    out = {}
    for u, _ in page:
        k = said[find(key(u))] if key(u) and key(u) in up else set()
        out[u] = rule(u) or ("allow" if "allow" in k else "block" if "block" in k else "allow")
    return out


def test_url_aliases_against_union_find(spark, tmp_path):
    hosts = ["a.org", "B.net", "x.b.net", "cdn.b.net", "ok.org", "c.org", "d.org"]
    url = lambda: f"{R.choice(['http', 'https', 'HTTP'])}://{R.choice(hosts)}/{R.choice(['es', 'no', 'x', 'view'])}/{R.randint(0, 400)}{R.choice(['', '', f'?id={R.randint(1, 3)}', '#top'])}"
    near = lambda: R.choice(["../es/%d", "/x/%d", "./%d", "%d?id=2", "//c.org/x/%d", "?id=%d", "../../view/%d/.."]) % R.randint(0, 400)
    tags = ['<link rel="canonical" href="{}">', "<LINK HREF='{}' title=x REL='canonical'/>", '<link href={} rel=canonical>', "<meta content='0; URL={}' http-equiv=refresh>", '<meta http-equiv="Refresh" content="1;url={}">']
    page, rows = [], []
    for i, u in enumerate({url() for _ in range(1500)}):
        targets = [R.choice([url, near])() for _ in range(R.choice([0, 0, 1, 1, 2]))]
        page.append((u, targets))
        rows.append((i, u, "<p>refresh</p><link rel=alternate href=http://b.net/es/1>" + "\n".join(R.choice(tags).format(t.replace("&", "&amp;")) for t in targets)))
    redirects = [(url(), url()) for _ in range(300)] + [("/login?next=http://b.net/es/1", page[0][0]), (None, "x")]
    want = brute_verdicts(page, redirects, ALIAS_RULES)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    links = spark.createDataFrame(redirects, "from_url string, to_url string")
    many = [("block", f"n{i}.example", "/") for i in range(url_filter.LITERAL_RULES)] + ALIAS_RULES
    for rules in (ALIAS_RULES, many):  # as literals, and as a joined table
        got = {rows[r.page_id][1]: r.verdict for r in url_filter.filter_urls(pages, Workspace(spark, "t"), rules, links).collect()}
        assert got == want
    assert collections.Counter(want.values())["block"] > 100 and sum(v == "block" and "b.net" not in u.lower() for u, v in want.items()) > 20


def test_op9_against_its_sql(spark, tmp_path):
    import duckdb

    bad, link = "http://shop.net/es/1", '<link rel="canonical" href="{}">'
    rows = [(1, "http://a.org/view?id=1", link.format(bad)), (2, "http://a.org/view?id=2", ""), (3, "/login?next=" + bad, link.format("http://a.org/view?id=2")), (4, "http://a.org/x#f", "<meta content='0;url=/view?id=1' http-equiv='refresh'>"), (5, None, None), (6, "http://q.org/", link.format("//shop.net/es/1")), (7, "https://q.org/", None), (8, "http://z.com/", link.format(bad)), (9, "http://y.org/a/b", link.format("c")), (10, "http://y.org/a/c", link.format("http://w.org/")), (11, "http://w.org/", link.format(bad))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in queries.op9_url_filter(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.oracle_sql()["op9_url_filter"]).fetchall())
    assert {r[0]: r[4] for r in got} == {1: "allow", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow"}


def brute_top(vectors, k):
    q = {}
    for i, x in vectors:
        q.setdefault(i, []).append([math.floor(256 * Fraction(float(np.float32(c)))) for c in x])
    flat = [(j, x) for j, xs in q.items() for x in xs]
    score = lambda a, b: sum(s * t for s, t in zip(a, b))
    return {i: [sorted((-score(x, y), j) for j, y in flat if j != i and len(y) == len(x))[:k] for x in q[i]] for i in q if i % 50 == 0}


@pytest.mark.parametrize("group", [65_536, 4])
def test_topk(spark, group):
    rng = np.random.default_rng(4)
    v = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 256]) for i in rng.permutation(300)]
    v += [(2**63 - 1, [2.0] * 6), (2**63 - 1, [2.0] * 6), (50, [0.5] * 6), (400, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0]), (401, [-1e30, 1e30, 1.0, 0.0, 0.0, 0.0]), (402, [1e30, -1e30, 1.0, 0.0, 0.0, 0.0]), (450, [-3e38] * 6), (451, [2e9] * 6), (460, []), (1050, [1.0])]
    odd = [(1000, None), (1001, [None, 1.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [1.0] * 6)]
    df = topk.quantized(spark.createDataFrame(v + odd, "vec_id long, embedding array<float>").repartition(4))
    got = collections.defaultdict(list)
    for r in topk.top_k(df.where("vec_id % 50 = 0"), df, Workspace(spark, "t"), 5, group=group).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, -r.score, r.vec_id))
    hold = lambda s: max(-(2**63) + 1, min(2**63, s))
    want = {i: sorted((n, hold(s), j) for one in lists for n, (s, j) in enumerate(one, 1)) for i, lists in brute_top(v, 5).items()}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert [x[2] for x in got[400]][0] in (402,) and len(got[50]) == 10
    few = df.where("vec_id < 3")
    assert topk.top_k(few, few, Workspace(spark, "t"), 5, group=min(group, 2)).count() == 6 and topk.top_k(empty(df), df, Workspace(spark, "t")).count() == 0


def test_language_id(spark):
    letters = {"en": "abcdef", "de": "äöüghi", "xx": "αβγδ"}
    text = lambda k: " ".join("".join(R.choice(letters[k]) for _ in range(R.randint(2, 7))) for _ in range(30))
    rows = [(i, text(k), k) for i, k in enumerate(["en", "de", "xx"] * 60)] + [(900, None, "en"), (901, " 12 %", "de"), (902, text("en"), None), (None, text("de"), "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("kept away"))
    model = language_id.fit(df)
    out = {r.doc_id: r for r in language_id.predict(df, model).withColumn("held", language_id.held_out("doc_id")).collect()}
    assert all(out[i].lang_pred == k for i, _, k in rows[:180]) and out[900].lang_pred == out[901].lang_pred == "und" and out[902].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out.values()) and any(r.held for r in out.values())
    assert language_id.predict(df, language_id.fit(empty(df))).where("lang_pred <> 'und'").count() == 0
    shuffled = df.withColumn("lang", F.when(language_id.held_out("doc_id"), F.lit("de")).otherwise(F.col("lang")))
    assert np.array_equal(language_id.fit(shuffled).bits, model.bits)


def plain_grams(text):
    """All n-grams of a text as tuples; letters lower-cased, any run of other characters one boundary."""
    seq = [None]
    for c in text:
        low = c.lower() if c.isalpha() else None
        if low is not None:
            seq.append(low if len(low) == 1 else c)
        elif seq[-1] is not None:
            seq.append(None)
    seq += [None] if seq[-1] is not None else []
    return [g for n in language_id.SIZES for i in range(len(seq) - n + 1) if any(g := tuple(seq[i : i + n]))]


def test_language_id_against_sets(spark):
    rows = []
    for i in range(240):
        k = R.choice(["en", "fr", "de"])
        w = {"en": ["the", "Water", "house", "night", "and"], "fr": ["le", "l'eau", "Maison", "nuit", "été"], "de": ["das", "Wasser", "Haus", "Nacht", "und"]}[k]
        rows.append((i, " ".join(R.choice(w + ["hotel", "radio"]) for _ in range(R.randint(3, 12))) + R.choice(["", " 42!", "\nǅ İx"]), k))
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learned = [(set(plain_grams(t)), k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    docs_of = collections.Counter(k for _, k in learned)
    share = collections.defaultdict(dict)
    for grams, k in learned:
        for g in grams:
            share[g][k] = share[g].get(k, 0) + 1 / docs_of[k]
    member = {g: {k for k, x in s.items() if x >= language_id.MIN_SHARE and x >= language_id.MIN_OF_HIGHEST * max(s.values())} for g, s in share.items()}
    for i, t, k in rows[:60]:
        grams = plain_grams(t)
        hashes, _, letters = language_id.grams([t])
        assert len(hashes) == len(grams) and letters[0] == sum(c.isalpha() for c in t)
        (lang,), (score,) = model.predict([t])
        exact = {m: sum(m in member.get(g, ()) for g in grams) / len(grams) for m in model.languages}
        assert lang == max(model.languages, key=lambda m: (exact[m], -model.languages.index(m))) and abs(score - exact[lang]) < 0.01
    whole = sorted({g for t in rows for g in plain_grams(t[1])}, key=str)
    text = {g: "".join(c or " " for c in g) for g in whole}
    hits = collections.Counter()
    for g in whole:  # no language is missed; the bits too many are few
        h, _, _ = language_id.grams([text[g]])
        mask = int(np.bitwise_or.reduce(model.masks(h)[:, 0])) if len(h) else 0
        hits["missed"] += sum(not mask >> model.languages.index(k) & 1 for k in member.get(g, ())) if None not in g else 0
    assert hits["missed"] == 0 and model.false_rate.max() < 1e-4


def test_language_of_one_document_beside_a_large_one(spark):
    ids = [i for i in range(700) if zlib.crc32(str(i).encode()) % 3 != 1]
    greek = "η γλώσσα αυτή έχει ένα μόνο κείμενο με ετικέτα και πρέπει να μαθευτεί"
    rows = [(i, prose(30), "en") for i in ids[1:]] + [(ids[0], greek, "el")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    langs, score = model.predict([greek, rows[0][1]])
    assert model.languages == ["el", "en"] and langs == ["el", "en"] and min(score) > 0.5


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "mixing", "bpe"]
    stage = dict(p.STAGES)
    named = docs.withColumn("n_chars", F.length("text"))
    kept = stage["language_id"](spark, named, "")
    assert kept.columns == named.columns and {r.doc_id for r in kept.collect()} == {i for i, t in DOCS if any(c.isalpha() for c in t or "")}
    near = stage["jaccard_join"](spark, named, "")
    comp = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(named, Workspace(spark, "t")).collect()}
    assert sorted(r.doc_id for r in near.collect()) == sorted({*comp.values()}) and near.columns == named.columns
    cut = stage["substring_dedup"](spark, near, "")
    assert cut.columns == named.columns
    mixed = stage["mixing"](spark, cut, "")
    assert mixed.columns == named.columns and mixed.count() > 0
    for _, f in p.STAGES:
        assert f(spark, empty(named), "").count() == 0


def brute_targets(total):
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, full, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, set(), {}
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        target = {s: 2 * total[s] if s in full else weight[s] * rest / sum(weight[x] for x in order if x not in full) for s in order}
        if not (new := {s for s in order if target[s] > 2 * total[s]} - full):
            return {s: (target[s], mixing.SCHEDULE[k % 3]) for k, s in enumerate(order)}
        full |= new


def brute_cut(texts):
    """Texts by id without the words in windows of 20 that occurred before; without those that lose all."""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        found = list(re.finditer(rb"[^ \t-\r]+", t.encode()))
        w, gone = [m[0] for m in found], set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            gone |= set(range(s, s + 20)) if k in seen else set()
            seen.add(k)
        ends = [m.start() for m in found[1:]] + [len(t.encode())]
        if gone:
            t = b"".join(t.encode()[m.start() : e] for j, (m, e) in enumerate(zip(found, ends)) if j not in gone).decode()
        if not w or len(gone) < len(w):
            out[i] = t
    return out


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    import tiktoken

    import corpus_pipeline as p

    own = docs.withColumns({"position": F.lit("p"), "_row": F.lit(7), "file": F.lit(None).cast("string")})
    own.write.parquet(str(tmp_path / "documents.parquet"))
    got = p.run(spark, str(tmp_path)).orderBy("file", "row").collect()
    model = language_id.fit(docs)
    langs, score = model.predict([t for _, t in DOCS])
    kept = {i: t for (i, t), k, s in zip(DOCS, langs, score) if k != "und" and s >= p.MIN_LANGUAGE_SCORE}
    shingles, near = dict(sets()), {}
    for i in sorted(kept):  # the smallest id of what links connect
        near[i] = min([i, *(near[j] for j in near if 100 * len(shingles[i] & shingles[j]) >= 75 * len(shingles[i] | shingles[j]))])
        for j in near:
            if 100 * len(shingles[i] & shingles[j]) >= 75 * len(shingles[i] | shingles[j]):
                old = near[j]
                near = {k: near[i] if v == old else v for k, v in near.items()}
    cut = brute_cut({i: kept[i] for i in {*near.values()}})
    name = {i: f"s{i % 3}" if i % 7 else None for i in cut}
    hashes = {r.i: r.h for r in spark.createDataFrame(list(cut.items()), "i long, t string").select("i", F.xxhash64("i", "t").alias("h")).collect()}
    rows = [(i, name[i], len(words(t)), hashes[i]) for i, t in cut.items()]
    total = collections.Counter()
    for _, s, n, _ in rows:
        total[s] += n
    taken = sorted(brute_mix(rows, brute_targets(total)), key=lambda x: (round(x[2], 6), x[0], x[1]))
    ranks, pattern = queries.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert len(got) > 20 and [r.doc_id for r in got] == [i for i, _, _ in taken]  # in training order, to the end
    for r in got:
        ids = enc.encode_ordinary(cut[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(cut[r.doc_id].encode()).hexdigest()
