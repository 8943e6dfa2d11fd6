"""URL filter: rules on host and path, and link-graph propagation for what no rule decides.

Rules fit a host with its subdomains and a path prefix; the longest wins. Hosts of which
rules allow most pages are trusted seeds, hosts of which they block most pages are blocked
seeds, each by its share of the seeds' pages. Trust flows along the links between hosts as a
personalised PageRank; distrust flows against them, from a blocked host to those that link
to it. A host whose distrust exceeds ``RATIO`` times its trust is blocked.

Links are counted per pair of hosts before anything is joined, so a host with a third of
the pages is a few rows of the graph. Ranks are stored after every step. DataFrame
functions alone; the driver sees one number per step.

Nulls: a null url, or one without ``://``, has empty host and path, fits no rule and is
allowed; null html has no links. Links inside a host say nothing. Repeated rows count as
pages. Ties of trust and distrust allow. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from greenlattice.llm.common import keep, query, small, table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
DAMPING = 0.85
STEPS = 200
TOLERANCE = 1e-8
RATIO = 1.0
LINK = r"""(?i)\shref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the last one looked at wins
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` with host, path and ``_by`` (rule and verdict)."""
    located = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return located.withColumn("_by", by_rule(F.col("host"), F.col("path"), rules))


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, n): links between different hosts, from url and html, stored."""
    urls = F.when(F.contains("html", F.lit("//")), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    # a hash per page first: pairs are counted where the pages are read
    links = pages.select(host_of(F.col("url")).alias("source"), F.explode(urls).alias("_url"))
    full = F.when(F.col("_url").startswith("//"), F.concat(F.lit("http:"), "_url")).otherwise(F.col("_url"))
    named = links.select("source", host_of(full).alias("target")).where("source <> '' and target <> '' and source <> target")
    return keep(named.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")))


def propagated(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(flow, host, rank) stored: trust along the links, distrust against them, from ``seeds`` of the same form."""
    ways = links.select(F.lit("trust").alias("flow"), F.col("source").alias("host"), F.col("target").alias("to"), "n").unionByName(
        links.select(F.lit("distrust").alias("flow"), F.col("target").alias("host"), F.col("source").alias("to"), "n"))
    total = ways.groupBy("flow", "host").agg(F.sum("n").alias("total"))
    ways = keep(ways.join(total, ["flow", "host"]).select("flow", "host", "to", (F.col("n") / F.col("total")).alias("share")))
    start = keep(seeds.select("flow", "host", ((1 - DAMPING) * F.col("rank")).alias("rank")))
    ranks = start
    if ways.isEmpty():
        return ranks
    for _ in range(STEPS):
        flowing = ways.join(ranks, ["flow", "host"]).select("flow", F.col("to").alias("host"), (DAMPING * F.col("share") * F.col("rank")).alias("rank"))
        new = keep(start.unionByName(flowing).groupBy("flow", "host").agg(F.sum("rank").alias("rank")))
        change = (new.unionByName(ranks.withColumn("rank", -F.col("rank"))).groupBy("flow", "host").agg(F.sum("rank").alias("d"))
                  .agg(F.coalesce(F.sum(F.abs("d")), F.lit(0.0))).first()[0])
        ranks = new
        if change < TOLERANCE:
            break
    return ranks


def blocked_hosts(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_host, trust, distrust) of the hosts that the link graph blocks, stored."""
    verdict = F.col("_by.verdict")
    by_host = keep(judged(pages, rules).where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count(F.when(verdict == "allow", 1)).alias("trust"), F.count(F.when(verdict == "block", 1)).alias("distrust")))
    found = by_host.select("host", "pages", F.explode(F.map_from_arrays(
        F.array(F.lit("trust"), F.lit("distrust")), F.array("trust", "distrust"))).alias("flow", "n")).where("2 * n > pages")
    totals = found.groupBy("flow").agg(F.sum("n").alias("total"))  # two rows
    seeds = found.join(F.broadcast(totals), "flow").select("flow", "host", (F.col("n") / F.col("total")).alias("rank"))
    ranks = propagated(seeds, host_links(pages))
    both = ranks.groupBy(F.col("host").alias("_host")).agg(
        F.sum(F.when(F.col("flow") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("flow") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    return keep(both.where(F.col("distrust") > RATIO * F.col("trust")))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust (of blocked hosts)."""
    blocked = blocked_hosts(pages.select("url", "html"), rules)
    found = judged(pages, rules).join(small(blocked), F.col("host") == F.col("_host"), "left")
    verdict = F.coalesce("_by.verdict", F.when(F.col("_host").isNotNull(), "block").otherwise("allow"))
    return found.withColumn("rule", F.col("_by.rule")).withColumn("verdict", verdict).drop("_by", "_host")


@query("op5_url_filter")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
