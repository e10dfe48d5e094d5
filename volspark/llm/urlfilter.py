"""URL filters: path rules first, then trust and distrust spread over the host link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import HEAVY, ascii_lower, join_skewed, shared

#: (verdict, host, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""


def _tail(url: Column) -> Column:
    """What follows the first ://, null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_tail(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_tail(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits; null where none does.

    The list is a parameter of a few entries, so it becomes one CASE expression of the scan.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for ok, (v, h, p) in list(zip(fits, ordered, strict=True))[::-1]:
        name, verdict = F.when(ok, F.lit(h + p)).otherwise(name), F.when(ok, F.lit(v)).otherwise(verdict)
    return name, verdict


#: A link with a host of its own; // further on is part of a path or query.
ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts; relative links stay on their host and drop out."""
    links = pages.select(
        F.col("host").alias("src"),
        F.explode(F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), 1)), lambda u: u.rlike(ABSOLUTE))).alias("u"),
    )
    url = F.when(F.col("u").startswith("//"), F.concat(F.lit("http:"), F.col("u"))).otherwise(F.col("u"))
    edges = links.select("src", host_of(url).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """Personalised PageRank: (host, mass, whole) that reaches hosts along edges (src, dst, share) from seeds (host, mass, whole).

    Both columns walk together and end together, so mass / whole is a share whatever the number of links. The seeds' own
    mass is not counted; mass that reaches a host without outgoing edges leaves the walk. A small join a round; the lineage
    is cut each round, and the walk ends when a round moves less than the share `tolerance` of the seeds. As each round
    moves at most `damping` of the one before, that takes log(tolerance) / log(damping) rounds; fewer `rounds` are an error.
    """
    start = seeds.agg(F.sum("whole")).first()[0] or 0.0
    zero = F.lit(0.0)
    state = seeds.select("host", "mass", "whole", zero.alias("got_mass"), zero.alias("got_whole"))
    for _ in range(rounds):
        step = state.where("whole > 0").join(edges, state["host"] == edges["src"]).groupBy(F.col("dst").alias("host"))
        step = step.agg(*((damping * F.sum(F.col(c) * F.col("share"))).alias(c) for c in ("mass", "whole")))
        both = step.select("host", "mass", "whole", F.col("mass").alias("got_mass"), F.col("whole").alias("got_whole"))
        both = both.union(state.select("host", zero, zero, "got_mass", "got_whole"))
        state = shared(both.groupBy("host").agg(*(F.sum(c).alias(c) for c in state.columns[1:])))
        if not (state.agg(F.sum("whole")).first()[0] or 0.0) > tolerance * start:
            return state.select("host", F.col("got_mass").alias("mass"), F.col("got_whole").alias("whole"))
    raise RuntimeError("the walk did not settle")


def host_verdicts(pages: DataFrame, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-4, distrust_share: float = 0.8, least_distrust: float = 0.5) -> DataFrame:
    """(host, n, trust, distrust, blocked) from pages (host, html, verdict of the rules); n is its number of pages.

    Every host seeds both walks, with the share of its pages that the rules allow (trust) or block (distrust), beside a whole
    mass of 1; hosts that are only linked to have the whole mass alone. Trust walks along links, distrust against them:
    who links to blocked hosts shares their distrust. Of what reaches a host, mass / whole is the allowed (blocked) share of
    the hosts behind it, however many others the mass is split over. A host's trust (distrust) is the share of its pages
    allowed (blocked), and for its pages without a rule `damping` times the share that its links bring. It is blocked if
    its distrust is at least `least_distrust` and makes up at least `distrust_share` of trust and distrust together.
    """
    votes = pages.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"),
        (F.sum(F.when(F.col("verdict") == "allow", 1).otherwise(0)) / F.count("*")).alias("good"),
        (F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)) / F.count("*")).alias("bad"),
    )
    votes = shared(votes)
    edges = shared(host_edges(pages))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    nodes = shared(votes.join(ends, "host", "full").select("host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad")))

    def walk(seed: str, back: bool, name: str) -> DataFrame:
        a, b = ("dst", "src") if back else ("src", "dst")
        out = edges.groupBy(a).agg(F.sum("n").alias("total"))
        shares = shared(edges.join(out, a).select(F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("n") / F.col("total")).alias("share")))
        seeds = nodes.select("host", F.col(seed).alias("mass"), F.lit(1.0).alias("whole"))
        return spread(seeds, shares, damping, rounds, tolerance).where("whole > 0").select("host", (F.col("mass") / F.col("whole")).alias(name))

    both = votes.join(walk("good", False, "near_good"), "host", "left").join(walk("bad", True, "near_bad"), "host", "left")
    free = damping * (1 - F.col("good") - F.col("bad"))
    both = both.select("host", "n", *((F.col(own) + free * F.coalesce(near, F.lit(0.0))).alias(name) for own, near, name in (("good", "near_good", "trust"), ("bad", "near_bad", "distrust"))))
    return both.withColumn("blocked", (F.col("distrust") >= least_distrust) & (F.col("distrust") >= distrust_share * (F.col("trust") + F.col("distrust"))))


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, html, host, path, rule, verdict) of every page; rule and verdict are null where none fits."""
    url, host, path = F.col("url").cast("string"), F.col("host"), F.col("path")
    name, verdict = rule_of(host, path, rules)
    return pages.select("page_id", "html", host_of(url).alias("host"), path_of(url).alias("path")).withColumns({"rule": name, "verdict": verdict})


def judge(pages: DataFrame, rules=RULES, **graph) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_trust, host_distrust) of every row of pages (page_id, url, html).

    A rule's verdict stands; other pages get their host's; trust and distrust are shares from 0 to 1. Null or odd urls have an empty host and path and
    are allowed, null html has no links, null ids and repeated rows stay, other columns are ignored. Of rules of one length
    that fit, the first by its text counts. Pages meet their host's verdict in a shuffle, but for hosts of very many pages.
    """
    judged = parsed(pages, rules)
    hosts = shared(host_verdicts(judged.select("host", "html", "verdict"), **graph))
    total = hosts.agg(F.sum("n")).first()[0] or 0
    hot = hosts.where(F.col("n") > total // HEAVY + 1).select("host").union(hosts.sparkSession.createDataFrame([("",)], "host string"))
    out = join_skewed(judged.drop("html"), hosts, ["host"], hot, "left")
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("host_trust"), F.coalesce("distrust", F.lit(0.0)).alias("host_distrust"))
