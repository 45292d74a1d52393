"""Filters on addresses: the longest rule of a host and path, and block decisions that redirects and canonical links carry on.

A rule (verdict, host, path) fits the addresses of its host and all subdomains whose path starts with the rule's; the
longest decides, and of equally long ones the one that allows. Up to FEW rules are a CASE over each row; more are a table
that meets the distinct addresses by their hosts' suffixes, in equi-joins.

Pages also name other addresses of the same content: `<link rel=canonical>` and `<meta http-equiv=refresh>`, resolved
against the page (or its base element), and redirects that a crawler noted, given as a table. Addresses in their plain form
without scheme are nodes, such links are edges, and connected components are found by rounds of joins on DataFrames. If a
rule blocks any address of a component, on a page or only linked to, then all of it is blocked, but for addresses that a
rule allows: an explicit decision on an address itself always comes first, and is not carried on if it allows.

Nothing is collected but the number of links and of blocked nodes; pages are read once for their links (only pages that
can have one are taken apart) and once for their addresses. A page's row is never multiplied. A target that a third of all
pages name is the centre of a star, whose minimum is aggregated before it is shuffled.

Defined results: an address that is null or has no "://" has an empty host and path, fits no rule, and is allowed; equal
rows get equal verdicts; addresses of any length are read whole; a null html has no links; other columns, whatever their
names, are ignored; an empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.addresses import attribute, plain_form, resolved, suffixes, tags
from lectern.llm.common import SMALL_ROWS, written
from lectern.llm.components import components

#: Rules that are compared one by one with every row.
FEW = 64


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the production query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: from there up to "?" or "#"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _ordered(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "allow", r))


def fitting(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows (with host and path) with `rule` and `decided`, the longest fitting rule and its verdict; null if none fits."""
    ordered = _ordered(rules)
    if len(ordered) <= FEW:
        rule = decided = F.when(F.lit(False), "")
        for r in ordered:
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            rule, decided = rule.when(fits, r.host + r.path), decided.when(fits, r.verdict)
        return rows.withColumn("rule", rule).withColumn("decided", decided)
    table = rows.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(ordered)], "rank long, decided string, r_host string, r_path string")
    table = F.broadcast(table) if len(ordered) <= SMALL_ROWS else table
    most = max(r.host.count(".") + 1 for r in ordered)
    # The whole host beyond the longest rule's labels can fit no rule, nor can an empty one.
    asked = rows.select("host", "path").where("host != ''").distinct().withColumn("r_host", F.explode(suffixes(F.col("host"), most)))
    met = asked.join(table, "r_host").where(F.col("path").startswith(F.col("r_path")))
    best = met.groupBy("host", "path").agg(F.min_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "decided"), "rank").alias("best"))
    best = written(best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best.*"), "judged")
    best = F.broadcast(best) if best.count() <= SMALL_ROWS else best
    return rows.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").drop("_host", "_path")


def node(url: Column) -> Column:
    """The name of an address among those with the same content: 128 bits of its plain form without scheme."""
    return F.md5(F.regexp_replace(plain_form(url), "^[a-z][a-z0-9+.-]*:", ""))


def page_links(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(source, target): for each page, the address that its first canonical link and its first refresh name, resolved."""
    html = F.col("html")
    some = pages.select(F.col(f"`{url}`").alias("source"), F.col(f"`{page}`").alias("html")).where(F.col("source").contains("://") & html.rlike("(?i)canonical|http-equiv"))
    some = some.withColumn("tags", tags(html, "link|meta|base")).drop("html")
    having = lambda name, k, v: F.filter("tags", lambda x: x.rlike(rf"(?i)^<{name}[\s/]") & F.array_contains(F.split(F.lower(F.coalesce(attribute(x, k), F.lit(""))), r"\s+"), v))
    base = F.get(F.filter("tags", lambda x: x.rlike(r"(?i)^<base[\s/]") & attribute(x, "href").isNotNull()), 0)
    some = some.withColumn("base", F.coalesce(resolved(F.col("source"), F.trim(attribute(base, "href"))), F.col("source")))
    canonical = F.trim(attribute(F.get(having("link", "rel", "canonical"), 0), "href"))
    refresh = F.regexp_extract(attribute(F.get(having("meta", "http-equiv", "refresh"), 0), "content"), r"""(?i)^[\s0-9.]*[;,]\s*(?:url\s*=)?\s*["']?([^"']*)""", 1)
    named = some.select("source", "base", F.explode(F.array(canonical, F.trim(refresh))).alias("ref")).where("ref != ''")
    return named.select("source", resolved(F.col("base"), F.col("ref")).alias("target")).where(F.col("target").contains("://"))


def blocked_nodes(links: DataFrame, rules: Sequence[Rule]) -> DataFrame | None:
    """Nodes of components of which a rule blocks an address, as a table; None if there are no links."""
    links = written(links.withColumns({"a": node(F.col("source")), "b": node(F.col("target"))}).where("a != b").distinct(), "links")
    if links.isEmpty():
        return None
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("source").alias("url")), F.struct(F.col("b").alias("node"), F.col("target").alias("url")))).alias("end")).select("end.*")
    host, path = host_and_path(F.col("url"))
    ends = ends.groupBy("node").agg(F.min("url").alias("url")).withColumns({"host": host, "path": path})
    bad = fitting(ends, rules).where("decided = 'block'").select("node")
    of = written(components(links.select("a", "b")), "aliases")
    hit = of.join(bad, "node").select("component").distinct()
    return written(of.join(hit, "component", "left_semi").select(F.col("node").alias("_blocked")).distinct(), "blocked")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", page: str | None = "html") -> DataFrame:
    """(key, host, path, rule, verdict, via): verdict is allow or block; via says who decided: rule, alias or default.
    `redirects` (source, target) are links beside those of the pages; without `page` they are the only ones."""
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url")).withColumns({"host": host, "path": path})
    out = fitting(own, rules)
    links = [page_links(pages, url, page)] if page else []
    if redirects is not None:
        links.append(redirects.select("source", "target").where(F.col("source").contains("://") & F.col("target").contains("://")))
    bad = None
    if links:
        bad = blocked_nodes(links[0] if len(links) == 1 else links[0].union(links[1]), rules)
    if bad is None:
        out = out.withColumn("via", F.when(F.col("rule").isNotNull(), "rule").otherwise("default"))
    else:
        bad = F.broadcast(bad) if bad.count() <= SMALL_ROWS else bad
        # Only rows that wait for a decision have a node; the others are not dealt out by it.
        open_ = F.when(F.col("rule").isNull() & (F.col("host") != ""), node(F.col("url")))
        out = out.withColumn("_node", open_).join(bad, F.col("_node") == F.col("_blocked"), "left")
        out = out.withColumn("via", F.when(F.col("rule").isNotNull(), "rule").when(F.col("_blocked").isNotNull(), "alias").otherwise("default"))
    verdict = F.coalesce("decided", F.when(F.col("via") == "alias", "block").otherwise("allow"))
    return out.select(F.col("id").alias(key), "host", "path", "rule", verdict.alias("verdict"), "via")
