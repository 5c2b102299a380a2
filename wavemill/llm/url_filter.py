"""URL filters whose block decisions reach the aliases of a URL. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import Workspace

#: Up to so many rules are literals of the plan; more are joined as a table, with the same result.
LITERAL_RULES = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"

Rule = tuple[str, str, str]  #: action (allow or block), host, path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What is an alias of what: the absolute url without its fragment, scheme and host lower-cased.

    Null for a null url, and for one that doesn't begin with a scheme and ``://``.
    """
    scheme = F.translate(F.regexp_extract(url, SCHEME, 1), UPPER, LOWER)
    return F.when(url.rlike(SCHEME), F.concat(scheme, F.lit("://"), host_of(url), path_of(url), F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, action) of the longest rule that fits, or null.

    A rule fits its host and all subdomains where the path starts with the rule's. Of rules of
    the same length allow wins, then the one that sorts last.
    """
    best = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(best)
    return best


def with_rules(rows: DataFrame, rules: Sequence[Rule] | DataFrame, out: str = "_r") -> DataFrame:
    """``rows`` (host, path, ..) with the struct of ``rule_for`` as ``out``.

    ``rules`` may be a table action, host, path of any size: each distinct host and path then meets, by
    the domains above its host, the rules of those; hosts and paths without any stay.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= LITERAL_RULES:
            return rows.withColumn(out, rule_for(F.col("host"), F.col("path"), rules))
        rules = rows.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
    known = rules.select("action", F.col("host").alias("_rh"), F.col("path").alias("_rp"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    x = rows.select("host", "path").distinct().withColumn("_above", F.explode(above)).join(known, F.col("_above") == F.col("_rh"))
    rule = F.concat("_rh", "_rp")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("action") == "allow").alias("a"), rule.alias("rule"), "action")).alias("_best")
    x = x.where(F.startswith("path", F.col("_rp"))).groupBy("host", "path").agg(best)
    return rows.join(x, ["host", "path"], "left").withColumn(out, F.when(F.col("_best").isNotNull(), F.struct("_best.rule", "_best.action"))).drop("_best")


def without_dots(path: Column) -> Column:
    """The path with its segments ``.`` and ``..`` carried out."""
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))
    step = lambda a, s: F.when(s == "..", up(a)).when(s == ".", a).otherwise(F.concat(a, F.array(s)))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    last = F.when(path.rlike(r"(?s)(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(?s)(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), last)).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """The absolute url of a link's target on the page ``url``; null for schemes without ``://``."""
    scheme, site, path = F.regexp_extract(url, SCHEME, 1), F.regexp_extract(url, r"(?s)^([^/?#]*//[^/?#]*)", 1), path_of(url)
    there, query = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)", 1)
    query = F.when((there == "") & (query == ""), F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)).otherwise(query)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"(?s)[^/]*$", ""))
    near = F.when(there == "", path).when(there.startswith("/"), without_dots(there)).otherwise(without_dots(F.concat(folder, there)))
    of_page = F.when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(site, near, query))
    return F.when(target.rlike(SCHEME), target).otherwise(F.when(url.rlike(SCHEME), of_page))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty if there is none."""
    found = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)])


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """u, v: keys of pages and of all canonical links and refresh targets in their html.

    Attributes may come in any order, quoted or not. Relative targets, those that begin with ``//``
    too, are resolved against the page's url; a ``<base>`` is not read, of entities only ``&amp;``.
    """
    h, tag = F.col(html), F.col("_t")
    some = pages.where(F.lower(h).contains("canonical") | F.lower(h).contains("refresh"))
    x = some.select(F.col(url).alias("_u"), F.explode(F.array_distinct(F.regexp_extract_all(h, F.lit(r"(?is)(<(?:link|meta)\s[^>]*>)"), F.lit(1)))).alias("_t"))
    canonical = F.when(attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), attribute(tag, "href"))
    content = F.regexp_extract(attribute(tag, "content"), r"""(?is)\burl\s*=\s*["']?([^"']*)""", 1)
    refresh = F.when(F.trim(F.lower(attribute(tag, "http-equiv"))) == "refresh", content)
    target = F.when(F.lower(tag).startswith("<link"), canonical).otherwise(refresh)
    x = x.select("_u", F.regexp_replace(F.regexp_replace(target, r"(?s)^\s+|\s+$", ""), "&amp;", "&").alias("_t")).where("_t <> ''")
    return x.select(key_of(F.col("_u")).alias("u"), key_of(resolved(F.col("_t"), F.col("_u"))).alias("v")).where("u is not null and v is not null")


def filter_urls(pages: DataFrame, ws: Workspace, rules: Sequence[Rule] | DataFrame, redirects: DataFrame | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict for each page.

    A page with a rule gets the rule's verdict. Others get that of their equivalence class: the
    connected component, over canonical links, refresh targets and ``redirects`` (from_url, to_url),
    of the page's url, its query included. If any member is allowed by a rule the class is allowed; else,
    if any is blocked, it is blocked; else it is allowed. Null urls, and urls that do not begin with a
    scheme, have no aliases; null html has no links. Repeated rows stay; an empty table gives an
    empty result; other columns are ignored.
    """
    edges = link_edges(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(key_of(F.col("from_url")).alias("u"), key_of(F.col("to_url")).alias("v")))
    comp = connected_components(edges, ws, "aliases")
    ruled = with_rules(comp.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    action = F.col("_r.action")
    klass = ruled.groupBy("component").agg(F.when(F.max(action == "allow"), "allow").when(F.max(action == "block"), "block").alias("_verdict"))
    known = comp.join(klass.where("_verdict is not null"), "component").select(F.col("node").alias("_key"), "_verdict")
    x = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), key_of(F.col(url)).alias("_k"))
    # Only urls without a rule look for aliases; pages of one url may be many, classes are unique.
    x = with_rules(x, rules).join(known, (F.col("_k") == F.col("_key")) & F.col("_r").isNull(), "left")
    return x.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.action", "_verdict", F.lit("allow")).alias("verdict"))
