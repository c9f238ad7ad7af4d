"""URL filters: host and path rules, carried over redirect and canonical-link equivalence classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, materialize, read_table

#: (verdict, host, path) of the registered query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """The document that a URL names: scheme and host in lower case, no fragment. Null without ://."""
    return F.when(F.instr(url, "://") > 0, F.concat(ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), F.lit("://"), url_host(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits as a string, and its verdict; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        name, verdict = F.when(_fits(host, path, rule), F.lit(rule[1] + rule[2])).otherwise(name), F.when(_fits(host, path, rule), F.lit(rule[0])).otherwise(verdict)
    return name, verdict


def _without_dots(path: Column) -> Column:
    """A path from the root without . and .. segments."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part))),
    )
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(closed, "/"))


def resolve_link(url: Column, to: Column) -> Column:
    """The URL that a target names on a page: whole, by scheme, from the root, from the page's folder or by query alone.

    Null for an empty target, a fragment of the page itself, a scheme without //, and a relative target on a page without ://.
    """
    root = F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit("://"), url_host(url))
    path, tail = F.regexp_extract(to, r"^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(url_path(url), r"(?s)^/(.*/)?", 1))
    relative = (
        F.when(to.startswith("?"), F.concat(root, url_path(url), to))
        .when(to.startswith("/"), F.concat(root, _without_dots(path), tail))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), tail))
    )
    return (
        F.when((to == "") | to.startswith("#"), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit(":"), to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(to.contains("://"), to))
        .when(F.instr(url, "://") > 0, relative)
    )


#: What isn't markup (comments, scripts, styles), a link or meta tag with quoted values, and an attribute with its value.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
TAG = r"""(?is)<(?:link|meta)(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""(?s)([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, in any case; null without one. &amp; is unescaped."""
    pattern = F.lit(ATTRIBUTE)
    named = F.filter(F.regexp_extract_all(tag, pattern, F.lit(0)), lambda a: F.lower(F.regexp_extract(a, ATTRIBUTE, 1)) == name)
    first = F.get(named, 0)
    value = F.concat(*[F.regexp_extract(first, ATTRIBUTE, k) for k in (2, 3, 4)])
    return F.regexp_replace(F.trim(value), "(?i)&(?:amp|#38|#x26);", "&")


def html_links(pages: DataFrame) -> DataFrame:
    """(a, b): nodes joined by <link rel=canonical> or <meta http-equiv=refresh> in html.

    Attributes may be on several lines, quoted values may hold >, and canonical may be any of the tokens of rel. Comments, scripts and
    styles hold no tags. All targets count, relative ones as resolve_link reads them; <base> is not read.
    """
    tags = F.regexp_extract_all(F.regexp_replace("html", HIDDEN, " "), F.lit(TAG), F.lit(0))
    tag = F.col("tag")
    canonical = F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh"
    target = F.when(tag.rlike("(?i)^<link"), F.when(canonical, F.trim(attribute(tag, "href")))).when(refresh, F.regexp_extract(attribute(tag, "content"), r"""(?is)\burl\s*=\s*["']?\s*([^"'\s]+)""", 1))
    # the pages' text is read once; what is left are a few short tags
    tagged = pages.where("url is not null and html is not null").select("url", F.explode(tags).alias("tag")).where(F.col("tag").rlike("(?i)canonical|refresh"))
    found = materialize(tagged, "url-tags").select("url", target.alias("to"))
    linked = materialize(found.select("url", resolve_link(F.col("url"), F.col("to")).alias("to")).where("to is not null"), "url-targets")
    return linked.select(url_node(F.col("url")).alias("a"), url_node(F.col("to")).alias("b"))


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A page's own rule decides. A page without one takes the decision of its class, the connected component of its node over canonical,
    refresh and given redirects (columns src and dst): allow if any URL of the class is explicitly allowed, else block if any is blocked.
    All others are allowed. Pages and redirects may be empty; null, empty or malformed URLs have no class; repeated pages each give a row;
    other columns are ignored.
    """
    base = pages.select("page_id", "url")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.select("page_id", url_node(F.col("url")).alias("node"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumns({"rule": name, "own": verdict})
    edges = html_links(pages.select("url", "html")) if "html" in pages.columns else None
    given = redirects.select(url_node(F.col("src")).alias("a"), url_node(F.col("dst")).alias("b")) if redirects is not None else None
    edges = reduce(DataFrame.union, [e for e in (edges, given) if e is not None]) if edges is not None or given is not None else None
    if edges is not None:
        members = connected_components(edges, "url-classes")
        own = rule_of(url_host(F.col("node")), url_path(F.col("node")), rules)[1]
        decided = members.select("node", "component", own.alias("own"))
        classes = decided.groupBy("component").agg(F.when(F.bool_or(F.col("own") == "allow"), F.lit("allow")).when(F.bool_or(F.col("own") == "block"), F.lit("block")).alias("shared")).where("shared is not null")
        aliases = decided.where("own is null").join(classes, "component").select("node", "shared")
        judged = judged.join(materialize(aliases, "url-aliases"), "node", "left")
    else:
        judged = judged.withColumn("shared", F.lit(None).cast("string"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))


_HOST = "translate(regexp_extract({r}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"


def _sql_case(host: str, path: str, pick) -> str:
    ordered = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND starts_with({path}, '{p}') THEN '{pick((v, h, p))}'" for v, h, p in ordered) + " END"


def _sql_node(url: str) -> str:
    rest = _REST.format(u=url)
    return f"CASE WHEN instr({url}, '://') > 0 THEN translate(substr({url}, 1, instr({url}, '://') - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || {_HOST.format(r=rest)} || regexp_extract({rest}, '^[^/?#]*([^#]*)', 1) END"


SQL = f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, {_sql_node('url')} AS node, coalesce({_HOST.format(r=_REST.format(u='url'))}, '') AS host,
    coalesce(regexp_extract({_REST.format(u='url')}, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
found AS (SELECT url, replace(CASE WHEN regexp_matches(tag, '(?i)<link\\b.*\\brel\\s*=\\s*["'']?\\s*canonical\\b') THEN regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b') THEN regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) END, '&amp;', '&') AS dst FROM tags),
whole AS (SELECT url, CASE WHEN starts_with(dst, '//') THEN substr(url, 1, instr(url, '://')) || dst
  WHEN starts_with(dst, '/') THEN substr(url, 1, instr(url, '://') + 2) || {_HOST.format(r=_REST.format(u='url'))} || dst
  WHEN contains(dst, '://') THEN dst END AS dst FROM found),
e AS (SELECT DISTINCT * FROM (SELECT {_sql_node('url')} AS a, {_sql_node('dst')} AS b FROM whole) WHERE a <> b),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
judged AS (SELECT a, b, {_HOST.format(r=_REST.format(u='b'))} AS h, regexp_extract({_REST.format(u='b')}, '^[^/?#]*([^?#]*)', 1) AS q FROM reach),
shared AS (SELECT a, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v
  FROM (SELECT a, {_sql_case('h', 'q', lambda r: r[0])} AS v FROM judged) GROUP BY a)
SELECT page_id, host, path, {_sql_case('host', 'path', lambda r: r[1] + r[2])} AS rule,
  coalesce({_sql_case('host', 'path', lambda r: r[0])}, shared.v, 'allow') AS verdict
FROM p LEFT JOIN shared ON p.node = shared.a
"""
