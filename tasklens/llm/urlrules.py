"""URL decisions: longest host and path rule, then redirect equivalence.

Pages that redirect to or name a canonical form of each other are one class (connected components over those edges).
Targets are resolved by RFC 3986 against the page's url; a node is host, path (/ if empty) and query. A
page whose own url meets a rule takes that rule's decision. Any other page takes its class's: an explicit allow of any
member goes before a block of any member, and a class without either is allowed. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklens.llm.common import table
from tasklens.llm.graph import connected_components

#: (decision, host and path), fixed values.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical["'\s/>][^>]*>?"""
CANONICAL_TAGS = r"""(?i)(<link\b[^>]*>)"""
REFRESH_TAGS = r"""(?i)(<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url and for one without ://."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its decision, or nulls. A rule fits its host and all subdomains of it."""
    name, decision = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, decision = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(decision)
    return name, decision


def _node(url: Column) -> Column:
    """Host, path and query of a whole url; null without a host. An empty path is /, and the fragment is left out."""
    host, path = url_parts(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(_without_dots(path)), query))


def _without_dots(path: Column) -> Column:
    """A path that starts with / with its . and .. segments resolved (RFC 3986, 5.2.4)."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.element_at(parts, -1)
    whole = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), whole).otherwise(path)


def resolved(to: Column, url: Column) -> Column:
    """The whole url that a reference means on the page url; null for schemes without ://."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*://)", 1)
    authority = F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    base = F.concat(scheme, authority)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), to))
        .when(to.startswith("/"), F.concat(base, to))
        .when(to.startswith("?"), F.concat(base, path, to))
        .when((to == "") | to.startswith("#"), F.concat(base, path, query))
        .otherwise(F.concat(base, F.regexp_replace(path, r"[^/]*$", ""), to))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of the canonical links and refresh redirects of pages (url, html); src and dst are nodes."""
    links = F.filter(F.regexp_extract_all("html", F.lit(CANONICAL_TAGS), F.lit(1)), lambda t: t.rlike(CANONICAL))
    moves = F.regexp_extract_all("html", F.lit(REFRESH_TAGS), F.lit(1))
    hrefs = F.transform(links, lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    targets = F.transform(moves, lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    near = pages.where(F.lower(F.col("html")).contains("canonical") | F.lower(F.col("html")).contains("http-equiv"))
    found = near.select("url", F.explode(F.concat(hrefs, targets)).alias("to")).where("to <> ''")
    # a reference's &amp; is an & of its url
    ends = found.select("url", F.regexp_replace("to", "(?i)&amp;", "&").alias("to"))
    return ends.select(_node(F.col("url")).alias("src"), _node(resolved(F.col("to"), F.col("url"))).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def judge_urls(pages: DataFrame, edges: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url, html).

    edges (src, dst: host, path and query of urls, joined) adds redirects that a crawler has logged; an empty path is
    taken as / there too. Null urls have empty parts and are allowed; repeated rows are judged alike; no pages give no rows.
    """
    links = alias_edges(pages)
    if edges is not None:
        logged = [_node(F.concat(F.lit("x://"), c)).alias(c) for c in ("src", "dst")]
        links = links.unionByName(edges.select(*logged).where("src IS NOT NULL AND dst IS NOT NULL")).distinct()
    links = table(links, "aliases")
    host, path = url_parts(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), _node(F.col("url")).alias("node"))
    name, decision = rule_of(F.col("host"), F.col("path"), rules)
    judged = own.withColumn("rule", name).withColumn("own", decision)
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    parts = table(connected_components(links, "src", "dst"), "alias_parts")
    h, p = url_parts(F.concat(F.lit("x://"), "node"))
    member = parts.select("node", "component", h.alias("h"), p.alias("p"))
    decided = member.withColumn("d", rule_of(F.col("h"), F.col("p"), rules)[1])
    classes = decided.groupBy("component").agg(F.min("d").alias("class"))  # allow < block: an allow goes first
    by_node = table(parts.join(classes, "component").where("class IS NOT NULL").select("node", "class"), "alias_class")
    joined = judged.join(by_node, "node", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("own", "class", F.lit("allow")).alias("verdict"))
