r"""URL filters with redirect equivalence.

A page's url is an alias of where its ``<link rel="canonical">`` points and of where its
``<meta http-equiv="refresh">`` sends the reader, each such link an edge; a table of
observed redirects may add edges. Connected components over these edges are classes of
aliases. A url without a rule of its own takes the decision of its class: allow if a
member is explicitly allowed, else block if a member is blocked, else allow.

A node is a url without scheme and fragment, its host in lower case and dot segments
resolved. An empty path stays empty, as rules tell it from ``/``. Targets count as
members even if they were never fetched; links are resolved by RFC 3986.

Defined results
    null url or one without ``://``: host and path empty, no rule, allow;
    null or empty html: no edges; very long urls and html: read whole; links to the page
    itself or to what is no address (``mailto:``): no edge; repeated rows: one result for
    each; equal urls share a node; rules tied in length: the smaller string; an empty
    table: no rows; further columns, whatever their names, are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import TMP, ascii_lower, materialize
from panelwright.llm.components import connected_components

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: The markup by which a page names another address for itself.
CANONICAL = (
    r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical[\"'\s][^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)",
    r"(?is)<link\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)[^>]*\brel\s*=\s*[\"']?canonical\b",
)
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_LAST = r"(?is)<meta\b[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _resolved(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)
    step = lambda done, x: F.when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))
    whole = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), step)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(whole, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def node_of(url: Column) -> Column:
    """The node of an absolute url; null if it is none."""
    return F.when(url.contains("://"), F.concat(host_of(url), _resolved(F.regexp_extract(url, URL, 2)), F.regexp_extract(url, URL, 3)))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith(f".{rule[0]}")) & path.startswith(rule[1])


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits. The rule list is a parameter of the
    query and stands in the plan."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    pick = lambda value: F.coalesce(*[F.when(_fits(host, path, r), F.lit(value(r))) for r in ranked], F.lit(None).cast("string"))
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def _hrefs(html: Column) -> Column:
    """All that the page names as its own or next addresses, as they stand there."""
    found = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (*CANONICAL, REFRESH, REFRESH_LAST)])
    return F.array_distinct(F.transform(found, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&"))))


def _absolute(href: Column, scheme: Column, site: Column, path: Column) -> Column:
    """What a link of the page names; null for the page itself and for other schemes."""
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), r"(?s)^(.*/)", 1)
    root = F.concat(scheme, F.lit("://"), site)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(href.rlike(r"^[^:]*://"), href))
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path, href))
        .when(~href.startswith("#"), F.concat(root, folder, href))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``a, b``: the nodes of a page and of what it points to.

    The pages that name an address are written first: they are few, and their urls are
    then taken apart once.
    """
    named = pages.where(F.col("html").rlike("(?i)canonical|http-equiv")).select("url", F.explode(_hrefs(F.col("html"))).alias("href"))
    named, url = materialize(named, "named"), F.col("url")
    named = named.select(
        "href", node_of(url).alias("a"), F.regexp_extract(url, r"(?s)^(.*?)://", 1).alias("scheme"),
        F.regexp_extract(url, URL, 1).alias("site"), path_of(url).alias("path"),
    )
    to = named.select("a", _absolute(F.col("href"), F.col("scheme"), F.col("site"), F.col("path")).alias("b"))
    return materialize(to, "targets").select("a", node_of(F.col("b")).alias("b"))


def class_decisions(edges: DataFrame, rules=RULES) -> DataFrame:
    """``node, decision`` for every node whose class has an explicit decision."""
    found = connected_components(edges)
    url = F.concat(F.lit("x://"), F.col("node"))
    acts = found.select("node", "root", rule_of(host_of(url), path_of(url), rules)[1].alias("act"))
    of = acts.groupBy("root").agg(F.max(F.col("act") == "allow").alias("allow"), F.max(F.col("act") == "block").alias("block"))
    of = of.where(F.col("allow") | F.col("block")).select("root", F.when(F.col("allow"), "allow").otherwise("block").alias("decision"))
    return materialize(acts.join(of, "root").select("node", "decision"), "decisions")


def url_filter(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``keep, host, path, rule, verdict``. ``redirects``: observed (source, target) urls."""
    edges = alias_edges(pages)
    if redirects is not None:
        more = redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b"))
        edges = edges.unionByName(more)
    edges = materialize(edges.where(F.col("a") != F.col("b")).distinct(), "aliases")
    url = F.col("url")
    df = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias(f"{TMP}node"))
    rule, act = rule_of(F.col("host"), F.col("path"), rules)
    df = df.select("*", rule.alias("rule"), act.alias(f"{TMP}act"))
    if edges.isEmpty():
        verdict = F.coalesce(F.col(f"{TMP}act"), F.lit("allow"))
        return df.select(*keep, "host", "path", "rule", verdict.alias("verdict"))
    decided = class_decisions(edges, rules).select(F.col("node").alias(f"{TMP}node"), "decision")
    verdict = F.coalesce(F.col(f"{TMP}act"), F.col("decision"), F.lit("allow"))
    return df.join(decided, f"{TMP}node", "left").select(*keep, "host", "path", "rule", verdict.alias("verdict"))


def oracle(rules=RULES) -> str:
    """The query in DuckDB SQL, with the closure as a recursive union."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    case = lambda at: "case " + " ".join(f"when (host = '{r[0]}' or suffix(host, '.{r[0]}')) and prefix(path, '{r[1]}') then '{at(r)}'" for r in ranked) + " end"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    part = lambda url, k: f"coalesce(regexp_extract({url}, '^.*?://([^/?#]*)([^?#]*)([^#]*)', {k}, 's'), '')"
    host = lambda url: lower.format(part(url, 1))
    step = "case when x = '..' then regexp_replace(done, '/[^/]*$', '') when x = '.' then done else done || '/' || x end"
    resolved = lambda p: f"case when regexp_matches({p}, '/[.][.]?(/|$)') then list_reduce([''] || string_split({p}, '/')[2:], lambda done, x: {step}) || case when regexp_matches({p}, '/[.][.]?$') then '/' else '' end else {p} end"
    node = lambda url: f"case when contains({url}, '://') then {host(url)} || {resolved(part(url, 2))} || {part(url, 3)} end"
    quoted = lambda p: p[5:].replace("'", "''").replace('\\"', '"')
    tries = " || ".join(f"regexp_extract_all(html, '{quoted(p)}', 1, 'is')" for p in (*CANONICAL, REFRESH, REFRESH_LAST))
    return rf"""
with recursive p as (
  select page_id, url, html, {host("url")} as host, {part("url", 2)} as path, {node("url")} as node,
    regexp_extract(url, '^(.*?)://', 1, 's') as scheme, {part("url", 1)} as site from pages
), h as (
  select node, path, scheme || '://' || site as root, scheme, replace(unnest({tries}), '&amp;', '&') as href from p where html is not null
), t as (
  select node, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then case when regexp_matches(href, '^[^:]*://') then href end
    when prefix(href, '//') then scheme || ':' || href when prefix(href, '/') then root || href when prefix(href, '?') then root || path || href
    when not prefix(href, '#') then root || regexp_extract(case when path = '' then '/' else path end, '^(.*/)', 1, 's') || href end as target from h
), e as (
  select node as a, {node("target")} as b from t
), both_ways as (
  select a, b from e where a <> b union select b, a from e where a <> b
), reach(a, b) as (
  select a, b from both_ways union select r.a, s.b from reach r join both_ways s on r.b = s.a
), nodes as (
  select a, b, {host("'x://' || b")} as host, {part("'x://' || b", 2)} as path from reach union select a, a, {host("'x://' || a")}, {part("'x://' || a", 2)} from reach
), decided as (
  select a, case when bool_or(coalesce(act = 'allow', false)) then 'allow' when bool_or(coalesce(act = 'block', false)) then 'block' end as decision
  from (select a, {case(lambda r: r[2])} as act from nodes) group by a
)
select page_id, host, path, {case(lambda r: r[0] + r[1])} as rule, coalesce({case(lambda r: r[2])}, decision, 'allow') as verdict
from p left join decided on p.node = decided.a
"""
