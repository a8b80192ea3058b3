"""URL filters that follow redirects: a block holds for every alias of a blocked url.

Redirect and canonical-link edges join urls; connected components are found by min-label hooking with
pointer jumping over (node, label) tables, written to the shared folder each round, so nothing of the
graph reaches the driver and no neighbour list is gathered.  A url under a rule gets the rule's verdict
(an explicit allow is never overridden); any other url is blocked if its component holds a blocked url.

Rules: a rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the
rule's path; the longest rule string wins, then the longer host, then allow.  Up to INLINE_RULES rules are
matched inside the row; more are matched by an equi-join on the host's suffixes.

Targets of links are resolved against the page's url (``//host/x``, ``/x``, ``x``, ``../x``, ``?x``; dot segments go), entities of
HTML in them are decoded, an empty path is ``/``; a fragment of the same page, and schemes without ``://`` (mailto and
the like), are no links.

Edge cases: a null url or one without ``://`` has an empty host and path and fits no rule; repeated urls
are judged alike and all rows are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persisted
from .components import components

INLINE_RULES = 64
Rule = tuple[str, str, str]
#: The rules of the registered query (host, path, verdict).
RULES: tuple[Rule, ...] = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What counts as the same url: host, path (empty: /) and query; not scheme and fragment."""
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.concat(host_of(url), F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))))


def _decoded(text: Column) -> Column:
    """Entities that stand in urls; the ampersand last, so that nothing is decoded twice."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("#x27", "'"), ("#x2F", "/"), ("#47", "/"), ("#38", "&"), ("#x26", "&"), ("amp", "&")):
        text = F.regexp_replace(text, f"(?i)&{name};", F.lit(char))
    return text


def resolved(target: Column, base: Column) -> Column:
    """A link's target as a whole url; null if it leads nowhere else."""
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.substring(target, F.length(path) + 1, F.length(target))
    own = path_of(base)
    whole = F.when(path.startswith("/"), path).when(path == "", own).otherwise(F.concat(F.regexp_extract(own, r"(?s)^(.*/)", 1), path))
    parts = F.split(F.regexp_replace(whole, "^/", ""), "/")
    # the last part stays as what stands behind the last slash, empty if it is a dot segment
    last = F.element_at(parts, -1)
    dots = last.isin(".", "..")
    walked = F.aggregate(
        F.concat(F.slice(parts, 1, F.size(parts) - 1), F.when(dots, F.array(last)).otherwise(F.array().cast("array<string>"))),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    clean = F.concat(F.lit("/"), F.array_join(F.concat(walked, F.array(F.when(dots, F.lit("")).otherwise(last))), "/"))
    return (
        F.when(target.contains("://") & target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.coalesce(F.instr(base, "://"), F.lit(0)) > 0, F.concat(F.lit("http://"), host_of(base), clean, rest))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of canonical links and meta refreshes found in `html`."""
    tag = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b([^>]*)>"), F.lit(1)))
    tags = pages.where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh")).select("url", tag.alias("tag"))
    link = F.when(F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    hop = F.when(F.col("tag").rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    to = tags.select("url", _decoded(F.coalesce(link, hop)).alias("to")).where(F.length("to") > 0)
    return to.select(node_of(F.col("url")).alias("src"), node_of(resolved(F.col("to"), F.col("url"))).alias("dst")).dropna()


def match_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds `rule` and `rule_verdict` (null where no rule fits) to rows with host and path."""
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    if len(rules) <= INLINE_RULES:
        fits = [
            F.when(
                ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p),
                F.struct(F.lit(len(h + p)).alias("n"), F.lit(len(h)).alias("nh"), F.lit(int(v == "allow")).alias("a"), F.lit(h + p).alias("rule"), F.lit(v).alias("v")),
            )
            for h, p, v in rules
        ]
        best = F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))
        return urls.withColumn("best", best).withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.v")}).drop("best")
    table = urls.sparkSession.createDataFrame(list(rules), "rhost string, rpath string, v string")
    pairs = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = pairs.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("rhost"))
    hit = suffixes.join(table, "rhost").where(F.expr("startswith(path, rpath)"))
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("rhost", "rpath")).alias("n"), F.length("rhost").alias("nh"), F.col("v") == "allow", F.concat("rhost", "rpath").alias("rule"), "v")).alias("b"))
    return urls.join(best, ["host", "path"], "left").withColumns({"rule": F.col("b.rule"), "rule_verdict": F.col("b.v")}).drop("b")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row; redirects: further (src, dst) urls."""
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = match_rules(urls, rules)
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).dropna())
    edges = persisted(edges, "redirects")
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    label = components(edges)
    # a node may be an alias that no page has: rules judge it too
    full = F.concat(F.lit("http://"), "node")
    members = match_rules(label.select("node", "component", host_of(full).alias("host"), path_of(full).alias("path")), rules)
    bad = members.where("rule_verdict = 'block'").select("component").distinct()
    blocked = label.join(bad, "component", "left_semi").select("node", F.lit(True).alias("via_alias"))
    out = judged.withColumn("node", node_of(F.col("url"))).join(blocked, "node", "left")
    method = F.when(F.col("via_alias"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rhost, rpath, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, v,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
