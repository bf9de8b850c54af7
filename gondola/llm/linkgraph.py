"""URL filters by link-graph propagation: personalised PageRank of trust along host edges and of distrust against them.

DataFrame functions only. Defined results:
- null url, or one without `://`: host and path are empty; such pages share the host "";
- null or empty html has no links; links without a host of their own stay on their host and pass nothing on;
- html of any length is read whole; equal trust and distrust are allowed;
- repeated rows each get a row and each count; an empty table gives no rows; extra input columns are ignored;
- a host that neither trust nor distrust reaches, over any number of links, is allowed; a score too small for a double
  is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import saved, scratch

#: (verdict, host and path) of each rule: the host reaches to the first slash, the path begins with it.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DAMPING = 0.85
#: Rounds before it is first asked whether the ranks have settled. It is no limit.
ROUNDS = 12
#: The ranks have settled when no host's score grows by more than this share of itself in a round.
TOLERANCE = 1e-6
#: A host is blocked if distrust is more than this share of what reached it.
THRESHOLD = 0.5
HREF_RE = r"""(?i)<a\b[^>]*?\shref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, by code point among equals, else null. The rules are a short list in the query's text."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits.append(F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}"), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts, summed before the shuffle."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(HREF_RE), 1)).alias("href"))
    links = links.select("src", host_of(F.concat(F.lit("x:"), F.regexp_replace("href", r"^[^/]*:(?=//)", ""))).alias("dst"))
    return links.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score): personalised PageRank of kind 'trust' along the edges and of kind 'distrust' against them.

    seeds: (kind, host, seed). Each round is a join with the edges and a sum before the shuffle; its ranks are written
    to the shared folder. Scores only grow, and the largest growth of a host as a
    share of its own score never rises from round to round: after the first rounds, it stops as soon as that is within
    tolerance for every host. A host just reached has grown by all of its score, so each that a seed leads to is met.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    out = both.groupBy("kind", "src").agg(F.sum("links").alias("all_links"))
    flow = saved(both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("links") / F.col("all_links") * damping).alias("part")), "link-flow")
    start = saved(seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"), F.lit(0.0).alias("before")), "link-seeds")
    ranks, done, grown = start, 0, 1.0
    while grown > tolerance:
        sent = flow.join(ranks, ["kind", "host"]).groupBy("kind", "dst").agg(F.sum(F.col("part") * F.col("score")).alias("score"))
        parts = start.unionByName(sent.select("kind", F.col("dst").alias("host"), "score", F.lit(0.0).alias("before")))
        parts = parts.unionByName(ranks.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("before")))
        ranks, done = saved(parts.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")), "link-ranks"), done + 1
        if done >= rounds:
            grown = ranks.where("score > 0").agg(F.max((F.col("score") - F.col("before")) / F.col("score"))).first()[0] or 0.0
    return ranks.drop("before")


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row of pages (page_id, url, html).

    The rules seed the graph: a host is trusted for each of its pages that an allowing rule fits and distrusted for each
    that a blocking rule fits. Pages that no rule fits get their host's verdict.
    """
    verdict_of = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)])
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    ruled = pages.select("page_id", host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("rule"))
    seeds = ruled.where("rule is not null").groupBy(F.when(verdict_of[F.col("rule")] == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").cast("double").alias("seed"))
    with scratch(pages.sparkSession):
        ranks = propagate(saved(host_edges(pages), "link-edges"), seeds)
        hosts = ranks.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))
        hosts = saved(hosts, "link-hosts", keep=True)
    every = ruled.join(hosts, "host", "left").fillna(0.0, ["trust", "distrust"])
    by_host = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return every.select("page_id", "host", "path", "rule", F.coalesce(verdict_of[F.col("rule")], by_host).alias("verdict"), "trust", "distrust")
