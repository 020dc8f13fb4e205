"""URL filters by link-graph propagation.

Rules name a host and a path; the longest rule that fits a url decides. What no rule decides is
judged by its host's place in the link graph:

* Hosts with pages that an allow rule fits are trusted seeds, weighted by how many; hosts that
  lie wholly under a block rule (one with the path ``/``) are blocked seeds.
* Trust is a personalised PageRank that flows from trusted seeds along links. Distrust flows from
  blocked seeds against the links: who links to blocked hosts inherits from them.
* A host is blocked if its distrust is at least ``ratio`` times its trust and above a floor.

All of it is DataFrame functions. Links are read from the whole ``html`` of every page, counted
once per page and pair of hosts, and combined before the shuffle, so the graph has at most one
row per pair of hosts. A step sends every host's mass over its edges; both flows share one join
and one aggregate. Mass of hosts without outgoing edges returns to the seeds. Lineage is cut by
writing the scores to the shared folder every few steps.

A url that is null or has no ``://`` has an empty host and path and matches no rule; it is
allowed. Pages that repeat a url count as often as they occur. Null html has no links.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.session import staged

STEPS = 12
DAMPING = 0.85
RATIO = 1.0
FLOOR = 1e-6
CUT = 4
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits a host, all of its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    """Whether a rule fits."""
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Struct (name, verdict) of the longest fitting rule; null where none fits."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        out = F.when(fits(r, host, path), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): on how many pages of a host a link to another host stands."""
    linked = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))
    return (
        pages.where("host <> '' AND html LIKE '%//%'").select(F.col("host").alias("src"), F.explode(linked).alias("dst"))
        .where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(flow, host, score) after ``steps`` steps, from seeds (flow, host, mass).

    ``edges`` has (flow, src, dst, n). Every flow's masses sum to 1.
    """
    total = edges.groupBy("flow", "src").agg(F.sum("n").alias("all"))
    shares = staged(edges.join(total, ["flow", "src"]).select("flow", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "shares")
    # One row per flow.
    mass = F.broadcast(seeds.groupBy("flow").agg(F.sum("mass").alias("m")))
    start = staged(seeds.join(mass, "flow").select("flow", "host", (F.col("mass") / F.col("m")).alias("seed")), "seeds")
    score = start.withColumnRenamed("seed", "score")
    for step in range(steps):
        moved = (
            score.withColumnRenamed("host", "src").join(shares, ["flow", "src"])
            .select("flow", F.col("dst").alias("host"), (F.lit(damping) * F.col("score") * F.col("share")).alias("score"))
        )
        kept = moved.groupBy("flow").agg(F.sum("score").alias("sent"))
        back = start.join(F.broadcast(kept), "flow", "left").select(
            "flow", "host", (F.col("seed") * (F.lit(1.0) - F.coalesce("sent", F.lit(0.0)))).alias("score")
        )
        score = moved.unionAll(back).groupBy("flow", "host").agg(F.sum("score").alias("score"))
        if step % CUT == CUT - 1 or step == steps - 1:
            score = staged(score, "score")
    return score


def judge_pages(
    pages: DataFrame, rules: Sequence[Rule] = RULES, steps: int = STEPS, damping: float = DAMPING,
    ratio: float = RATIO, floor: float = FLOOR,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust, distrust."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "html", host.alias("host"), path.alias("path")).withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    edges = staged(host_edges(judged), "edges")
    both = edges.select(F.lit("trust").alias("flow"), "src", "dst", "n").unionAll(
        edges.select(F.lit("distrust").alias("flow"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    whole = longest_rule(F.col("host"), F.lit("/"), [r for r in rules if r.path == "/"])
    per_host = judged.groupBy("host").agg(F.count_if(F.col("fit.verdict") == "allow").alias("allowed"), F.count(F.lit(1)).alias("n"))
    blocked = F.coalesce(whole["verdict"] == "block", F.lit(False))
    seeds = per_host.where("host <> ''").select(
        F.when(blocked, "distrust").otherwise("trust").alias("flow"), "host",
        F.when(blocked, F.col("n")).otherwise(F.col("allowed")).cast("double").alias("mass"),
    ).where("mass > 0")
    score = propagate(both, seeds, steps, damping)
    of_host = score.groupBy("host").agg(
        F.sum(F.when(F.col("flow") == "trust", F.col("score"))).alias("trust"),
        F.sum(F.when(F.col("flow") == "distrust", F.col("score"))).alias("distrust"),
    )
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when((distrust > floor) & (distrust >= F.lit(ratio) * trust), "block").otherwise("allow")
    return judged.drop("html").join(of_host, "host", "left").select(
        "page_id", "host", "path", F.col("fit.name").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
