"""URL filters: prefix rules, and trust carried over the link graph. DataFrame operations only.

A rule decides the pages it fits. The other pages take their host's verdict: trust starts at hosts whose pages the
allow rules let through, distrust at hosts whose pages are mostly blocked; trust follows links (personalised
PageRank), distrust follows them backwards, to the hosts that link to distrusted ones; a host whose distrust
outweighs its trust is blocked. Edges are summed for each pair of hosts before anything moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialise, table

#: verdict, host and its subdomains, start of the path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rules_of(hosts: DataFrame, rules) -> DataFrame:
    """host, n, rules: for each host the rules of the domains it belongs to."""
    row = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("domain"), F.lit(p).alias("prefix")) for v, h, p in rules]
    known = hosts.sparkSession.range(1).select(F.inline(F.array(*row))) if rules else None
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if known is None:
        return hosts.withColumn("rules", F.expr("array()").cast("array<struct<size:int,rule:string,prefix:string,verdict:string>>"))
    found = hosts.select("host", F.explode(domains).alias("domain")).join(known, "domain")
    found = found.groupBy("host").agg(F.collect_set(F.struct(  # as many as fit one host
        F.length(F.concat("domain", "prefix")).alias("size"), F.concat("domain", "prefix").alias("rule"), "prefix", "verdict")).alias("rules"))
    return hosts.join(found, "host", "left")


def _attach(pages: DataFrame, hosts: DataFrame, total: int) -> DataFrame:
    """pages with the columns of their host. Hosts with over a thousandth of the pages, of which there are fewer than
    a thousand, are broadcast, so that no host's pages meet in one task; the others are joined by a shuffle."""
    hot = F.broadcast(hosts.where(F.col("n") * 1000 > total).drop("n"))
    cold = hosts.where(F.col("n") * 1000 <= total).drop("n")
    return pages.join(hot, "host").unionByName(pages.join(hot.select("host"), "host", "left_anti").join(cold, "host"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, close: float = 1e-9) -> DataFrame:
    """host, trust, distrust. edges: src, dst, w, one row per pair; seeds: host, trust, distrust, each summing to one
    (or to zero). Mass of hosts without links goes back to the seeds. Ends when a round moves less than ``close``,
    or after ``rounds`` if given. A round moves at most ``damping`` times what the one before moved, the first at most 4,
    so the number of rounds that close takes is known; it is an error if they don't suffice. Shares are summed within
    partitions before they move; a hub's edges are a skewed join, which Spark splits as it runs."""
    out = edges.groupBy("src").agg(F.sum("w").alias("out_w"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("in_w"))
    edges = materialise(edges.join(out, "src").join(into, "dst"), "edges")
    has = materialise(
        seeds.join(out, seeds["host"] == out["src"], "left").join(into, seeds["host"] == into["dst"], "left")
        .select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"), F.col("out_w").isNull().alias("no_out"), F.col("in_w").isNull().alias("no_in")),
        "hosts")
    ranks = has.withColumns({"trust": F.col("t0"), "distrust": F.col("d0")})
    def lost(t, d):  # mass of hosts without links
        return F.sum(F.when(F.col("no_out"), F.col(t))), F.sum(F.when(F.col("no_in"), F.col(d)))

    before, (lost_t, lost_d) = None, (x or 0.0 for x in ranks.agg(*lost("trust", "distrust")).first())
    most = rounds if rounds is not None else math.ceil(math.log(close / 4) / math.log(damping)) + 2
    for _ in range(most):
        ahead = edges.join(ranks.select(F.col("host").alias("src"), "trust"), "src").select(
            F.col("dst").alias("host"), (F.col("trust") * F.col("w") / F.col("out_w")).alias("t"), F.lit(0.0).alias("d"))
        back = edges.join(ranks.select(F.col("host").alias("dst"), "distrust"), "dst").select(
            F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("w") / F.col("in_w")).alias("d"))
        got = ahead.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        new = lambda got, back, seed: damping * (F.coalesce(F.col(got), F.lit(0.0)) + F.lit(back) * F.col(seed)) + (1 - damping) * F.col(seed)
        after = ranks.join(got, "host", "left").withColumns({"t1": new("t", lost_t, "t0"), "d1": new("d", lost_d, "d0")})
        after = materialise(after.withColumn("moved", F.abs(F.col("t1") - F.col("trust")) + F.abs(F.col("d1") - F.col("distrust"))), "ranks")
        if before is not None:
            forget(before)
        before = after
        lost_t, lost_d, moved = (x or 0.0 for x in after.agg(*lost("t1", "d1"), F.sum("moved")).first())
        ranks = after.select("host", "t0", "d0", "no_out", "no_in", F.col("t1").alias("trust"), F.col("d1").alias("distrust"))
        if moved < close:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks still move by {moved} after {most} rounds")
    return ranks.select("host", "trust", "distrust")


def url_filter(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               spam_mass: float = 0.5, least_share: float = 0.1) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    The longest rule that fits decides (ties: the one that sorts last). Without one, a host is blocked if distrust
    makes up more than ``spam_mass`` of its trust and distrust, and is at least ``least_share`` of an even share; a
    host without links or seeds, or no host at all, is allowed. A null url, or one without ://, has an empty host and
    path; a null page has no links. Ids are passed through; other columns are not read.
    """
    url = F.col(url_col)
    p = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = materialise(p.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host-counts")
    total = hosts.agg(F.sum("n")).first()[0] or 0
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"]))
    p = _attach(p, _rules_of(hosts, rules), total).withColumn("r", F.array_max(fits))
    p = materialise(p.select("id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled")), "ruled")

    counts = p.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked"), F.count_if(F.col("ruled") == "allow").alias("allowed"))
    links = pages.where(F.col(html_col).isNotNull()).select(host_of(url).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(html_col, F.lit(_LINK), 1))).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src <> '' AND dst <> '' AND src <> dst")
    edges = materialise(links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")), "links")
    nodes = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct().join(counts, "host", "full")
    trusted = F.when((F.col("allowed") > 0) & (F.col("blocked") == 0), F.col("allowed") / F.col("n")).otherwise(0.0)
    blocked = F.when(2 * F.col("blocked") > F.col("n"), F.col("blocked") / F.col("n")).otherwise(0.0)
    nodes = materialise(nodes.select("host", F.coalesce("n", F.lit(0)).alias("n"), trusted.alias("trust"), blocked.alias("distrust")), "nodes")
    sums = nodes.agg(F.sum("trust"), F.sum("distrust"), F.count(F.lit(1))).first()
    even = 1.0 / max(1, sums[2])
    seeds = nodes.select("host", (F.col("trust") / (sums[0] or 1.0)).alias("trust"), (F.col("distrust") / (sums[1] or 1.0)).alias("distrust"))
    ranks = propagate(edges, seeds, close=max(1e-12, 1e-3 * least_share * even))  # what is still to come moves no host by 1 % of the least share
    bad = (F.col("distrust") >= least_share * even) & (F.col("distrust") > spam_mass * (F.col("trust") + F.col("distrust"))) & (F.col("host") != "")
    verdicts = nodes.select("host", "n").join(ranks.select("host", F.when(bad, "block").otherwise("allow").alias("of_host")), "host")
    return _attach(p, verdicts, total).select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "of_host").alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
