"""The queries of the operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, fingerprint, jaccard_join, language_id, license_scan, mixing, substring_dedup, topk, url_filter
from .storage import Workspace

#: op9's rules: (action, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(extra)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "op3"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.placings(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), Workspace(spark, "op4"))
    same = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    ends = [f(c).alias(f"{name}_{c}") for c in ("position", "place") for name, f in (("first", F.min), ("last", F.max))]
    return placed.groupBy("_g", "_b", "_row").agg(*same, F.sum("words").alias("taken"), *ends).drop("_g", "_b", "_row")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "op5"))
    return out.select("doc_id", "n_shingles", "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_min(F.transform("hits", lambda h: F.struct((-h["dice"]).alias("d"), h["licence"].alias("l"))))
    return x.select("doc_id", "n_segments", F.size("hits").alias("n_hits"), F.array_join(F.array_sort(F.array_distinct(F.col("hits.licence"))), ",").alias("licences"), best["l"].alias("best_licence"), F.round(-best["d"], 9).alias("best_dice"))


@cache
def vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, *vocabulary(), Workspace(spark, "op7"), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), Workspace(spark, "op9"), RULES)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = topk.quantized(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return topk.top_k(v.where(F.col("vec_id") % 50 == 0), v, Workspace(spark, "op10"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and "_" in k}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TIMES = "(length({0}) - length(replace({0}, '{1}', ''))) // {2}"
_ESCAPES = " + ".join(_TIMES.format("{0}", c, len(c)) for c in ("\\", "<s>", "</s>", "[INST]", "[/INST]"))


def _op2_sql() -> str:
    extra = "".join(f" UNION ALL SELECT -1, {i}, '{r}', '</s>[INST] ok [/INST]'" for i, r in enumerate(("user", "assistant")))
    size = f"20 + length(role) + length(text) + {_ESCAPES.format('role')} + {_ESCAPES.format('text')}"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations{extra}))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum({size}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


def _op3_sql() -> str:
    return f"""WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
    k AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS key, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (SELECT unnest(range(0, 20)) AS j)),
    x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    y AS (SELECT x.doc_id AS doc_id, word, x.i AS i, gone.i IS NOT NULL AS g FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i)
    SELECT d.doc_id AS doc_id, count(y.i) AS n_words, count(*) FILTER (g) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY y.i) FILTER (NOT g), '')) AS kept_sha256 FROM d LEFT JOIN y ON d.doc_id = y.doc_id GROUP BY d.doc_id"""


def _op5_sql() -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS.format(_FOLD)}, []) AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT d.doc_id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


def _op6_sql() -> str:
    sets = [(k, license_scan.bigrams_of(v)) for k, v in sorted(license_scan.TEMPLATES.items())]
    known = ", ".join(f"('{k}', {b})" for k, b in sets)
    words = "regexp_extract_all({0}, '[A-Za-z0-9]+')"
    return f"""WITH t AS (SELECT * FROM (VALUES {known}) t(name, b)), d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    s AS (SELECT doc_id, unnest(range(0, len(l))) AS no, unnest(l) AS seg FROM d UNION ALL SELECT doc_id, -1, text FROM d WHERE len(l) > 1 AND len({words.format("text")}) < 60),
    w AS (SELECT doc_id, no, {words.format("seg")} AS w FROM s), p AS (SELECT doc_id, no, len(w) - 1 AS n, list_transform(range(1, len(w)), lambda i: lower(w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) BETWEEN 2 AND 60),
    m AS (SELECT doc_id, no, name, CAST(2 * len(list_intersect(list_distinct(g), b)) AS DOUBLE) / (n + len(b)) AS dice FROM p, t),
    h AS (SELECT doc_id, no, name, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, no ORDER BY dice DESC, name) AS r FROM m WHERE dice >= 0.75) WHERE r = 1),
    a AS (SELECT doc_id, count(*) AS c, array_to_string(list_sort(list(DISTINCT name)), ',') AS names, first(name ORDER BY dice DESC, name) AS best, max(dice) AS dice FROM h GROUP BY doc_id)
    SELECT d.doc_id AS doc_id, CAST(len(l) AS INTEGER) AS n_segments, CAST(coalesce(c, 0) AS INTEGER) AS n_hits, coalesce(names, '') AS licences, best AS best_licence, round(dice, 9) AS best_dice FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


def _op9_sql() -> str:
    host = "translate(coalesce(regexp_extract({0}, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "coalesce(regexp_extract({0}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    rule = "CASE " + " ".join(f"WHEN (h = '{h}' OR h LIKE '%.{h}') AND starts_with(p, '{p}') THEN '{a} {h}{p}'" for a, h, p in order) + " END"
    key = "CASE WHEN regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(split_part({0}, '://', 1)) || '://' || " + host + " || " + path + " || regexp_extract({0}, '^[^?#]*([?][^#]*)', 1, 's') END"
    values = ['"([^"]*)"', "''([^'']*)''", "([^\\s\"''>]+)"]
    attr = lambda name: "(" + " || ".join(f"regexp_extract(g, '[\\s\"'']{name}\\s*=\\s*{v}', 1, 'si')" for v in values) + ")"
    root, own = "regexp_extract(url, '^([^/?#]*//[^/?#]*)', 1)", path.format("url")
    folder = f"CASE WHEN {own} = '' THEN '/' ELSE regexp_replace({own}, '[^/]*$', '') END"
    # '.' and '..' in relative targets are left to the tests
    full = f"CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t WHEN t LIKE '//%' THEN split_part(url, '//', 1) || t WHEN t LIKE '/%' THEN {root} || t WHEN t LIKE '?%' THEN {root} || {own} || t WHEN t LIKE '#%' THEN url ELSE {root} || {folder} || t END"
    return f"""WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(html, '<(link|meta)\\s[^>]*>', 0, 'si')) AS g FROM pages),
    x AS (SELECT url, replace(trim(CASE WHEN lower(g) LIKE '<link%' AND regexp_matches({attr("rel")}, '(^|\\s)canonical(\\s|$)', 'i') THEN {attr("href")}
        WHEN lower(g) LIKE '<meta%' AND lower(trim({attr("http-equiv")})) = 'refresh' THEN regexp_extract({attr("content")}, 'url\\s*=\\s*["'']?([^"'']*)', 1, 'si') END), '&amp;', '&') AS t FROM tags),
    y AS (SELECT url, {full} AS t FROM x WHERE t <> ''), l AS (SELECT {key.format("url")} AS u, {key.format("t")} AS v FROM y),
    e AS (SELECT u, v FROM l WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM l WHERE u IS NOT NULL AND v IS NOT NULL),
    r AS (SELECT u AS a, u AS b FROM e UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
    c AS (SELECT a, max(CASE WHEN o LIKE 'allow%' THEN 2 WHEN o LIKE 'block%' THEN 1 END) AS o FROM (SELECT a, {rule} AS o FROM (SELECT a, {host.format("b")} AS h, {path.format("b")} AS p FROM r)) GROUP BY a),
    g AS (SELECT page_id, {host.format("url")} AS h, {path.format("url")} AS p, {key.format("url")} AS k FROM pages), j AS (SELECT page_id, h, p, k, {rule} AS o FROM g)
    SELECT page_id, h AS host, p AS path, substr(j.o, 7) AS rule, CASE WHEN j.o IS NOT NULL THEN substr(j.o, 1, 5) WHEN c.o = 1 THEN 'block' ELSE 'allow' END AS verdict FROM j LEFT JOIN c ON j.k = c.a"""


def _op10_sql() -> str:
    return """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; learned filters, hashes, BPE and digests are tested by brute force."""
    made = {"op2": _op2_sql(), "op3": _op3_sql(), "op5": _op5_sql(), "op6": _op6_sql(), "op9": _op9_sql(), "op10": _op10_sql()}
    return {name: made[n] for name in queries() if (n := name.split("_")[0]) in made}
