"""URL rules with redirect equivalence.

A rule decides the URLs it fits. Other URLs take the decision of their aliases: redirect and
canonical-link edges form components, found by distributed rounds, and a block spreads to
all aliases without a rule of their own. An explicit allow comes first: a URL that a rule
allows stays allowed, and so do the unruled aliases of one. Built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausediff.llm.common import components, stored

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Patterns of links, the same for Spark and SQL: a tag, what tells that it names an alias, and the target.
LINK = (r"(?is)<link\b[^>]*>", r"""(?is)\srel\s*=\s*["']?\s*canonical["'\s/>]""", r"""(?is)\shref\s*=\s*["']?\s*([^\s"'>]+)""")
META = (
    r"(?is)<meta\b[^>]*>", r"""(?is)\shttp-equiv\s*=\s*["']?\s*refresh["'\s/>]""",
    r"""(?is)\scontent\s*=\s*["']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?\s*([^\s"'>]+)""",
)


def _target(html: Column, patterns: tuple[str, str, str]) -> Column:
    """The target of the first such tag; '' without one."""
    tag, alias, target = patterns
    first = F.get(F.filter(F.regexp_extract_all(html, F.lit(tag), 0), lambda x: x.rlike(alias)), 0)
    return F.coalesce(F.regexp_extract(first, target, 1), F.lit(""))


def host_of(url: Column) -> Column:
    """A-Z alone are lower-cased; '' for null or without '://'."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and decision (null where none fits) to a table with host and path. The
    rules are a short list of literals; the longest that fits wins."""
    cases = []
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        cases.append((fits, host + path, verdict))
    pick = lambda i: reduce(lambda rest, c: F.when(c[0], F.lit(c[i])).otherwise(rest), reversed(cases), F.lit(None).cast("string"))
    return df.withColumn("rule", pick(1)).withColumn("decision", pick(2))


def alias_edges(pages: DataFrame) -> DataFrame:
    """a (the page's URL) and b (the canonical link's or meta refresh's target), without
    fragments; relative targets are resolved against the page."""
    bare = lambda c: F.regexp_replace(c, r"(?s)#.*$", "")
    found = pages.select("url", F.explode(F.array(_target(F.col("html"), LINK), _target(F.col("html"), META))).alias("to"))
    found = found.where("to <> '' and url is not null")
    site = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract("url", r"(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(F.regexp_replace("url", r"(?s)[?#].*$", ""), r"(?s)^(.*?://[^/]*(?:/.*/)?)", 1)
    to = (
        F.when(F.col("to").contains("://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, "to"))
        .when(F.col("to").startswith("/"), F.concat(site, "to"))
        .otherwise(F.concat(F.regexp_replace(folder, r"(?<=[^/:])$", "/"), "to"))
    )
    return found.select(bare(F.col("url")).alias("a"), bare(to).alias("b")).where("a <> b")


def judged(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url, and html
    where edges aren't given; edges: a, b, two URLs that lead to the same page).

    A null URL or one without '://' has an empty host and path, fits no rule and has no
    aliases. Repeated rows get the same answer each."""
    edges = stored(alias_edges(pages) if edges is None else edges.select("a", "b"), "edges")
    comp = components(edges)
    urls = edges.select(F.col("a").alias("u")).union(edges.select("b")).distinct()
    named = urls.join(comp.withColumnRenamed("node", "u"), "u", "left").select("u", F.coalesce("component", "u").alias("component"))
    known = ruled(named.withColumn("host", host_of(F.col("u"))).withColumn("path", path_of(F.col("u"))), rules)
    known = stored(known.select("u", "component", "decision"), "aliases")
    spread = known.groupBy("component").agg(F.min("decision").alias("spread"))  # allow before block
    spread = known.join(spread, "component").where("spread is not null").select("u", "spread")
    out = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = ruled(out, rules).withColumn("u", F.regexp_replace("url", r"(?s)#.*$", ""))
    out = out.join(spread, "u", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("decision", "spread", F.lit("allow")).alias("verdict"))


def _sql_target(patterns: tuple[str, str, str]) -> str:
    tag, alias, target = (p.replace("'", "''") for p in patterns)
    return f"coalesce(regexp_extract(list_filter(regexp_extract_all(html, '{tag}'), lambda x: regexp_matches(x, '{alias}'))[1], '{target}', 1), '')"


ORACLE = rf"""
with recursive p as (
  select page_id, url, html, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) as h0,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
rules(verdict, rhost, rpath) as (values {", ".join(f"('{v}','{h}','{x}')" for v, h, x in RULES)}),
t as (select url, unnest([{_sql_target(LINK)}, {_sql_target(META)}]) as t from pages where url is not null),
e as (select distinct regexp_replace(url, '(?s)#.*$', '') as a, regexp_replace(case when contains(t, '://') then t when starts_with(t, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || t
    when starts_with(t, '/') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t
    else regexp_replace(regexp_extract(regexp_replace(url, '(?s)[?#].*$', ''), '(?s)^(.*?://[^/]*(?:/.*/)?)', 1), '([^/:])$', '/') || t end, '(?s)#.*$', '') as b from t where t <> ''),
both_ways as (select a, b from e where a <> b union select b, a from e where a <> b),
reach(a, b) as (select a, a from both_ways union select r.a, w.b from reach r join both_ways w on r.b = w.a),
u as (select distinct b as url, regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1) as h0, regexp_extract(b, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from reach),
ud as (select url, arg_max(verdict, length(rhost || rpath)) as decision from u join rules
       on (translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = rhost or translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%.' || rhost)
       and starts_with(path, rpath) group by url),
s as (select r.a as url, min(decision) as spread from reach r join ud on ud.url = r.b group by r.a),
q as (select page_id, url, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p),
m as (select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as decision
      from q join rules on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath) group by page_id)
select q.page_id, host, path, rule, coalesce(decision, spread, 'allow') as verdict
from q left join m using (page_id) left join s on s.url = regexp_replace(q.url, '(?s)#.*$', '')
"""
