"""URL verdicts: explicit rules, and for all other urls trust and distrust propagated over the host graph.

Hosts are nodes. An edge is a link from a page of one host to another host (absolute ``href`` values in the page), or
joins a host with the host that is left without its first label, if the table has pages of both (``site_edges``).
Trust is personalised PageRank from the hosts with allowed urls; distrust is the same over reversed edges from the hosts
with blocked urls. A host is blocked if its distrust exceeds ``ratio`` times its trust, with both at a sum of 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, settle

#: (verdict, host, path): fits the host and all its subdomains where the url's path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/\"'?#>\s]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Host of a url, A-Z lower-cased; empty if it is null or has no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, null if none does."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def host_edges(pages: DataFrame, hosts: DataFrame, site_edges: bool = True) -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    if site_edges:
        up = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"\A[^.]+\.(.+)", 1).alias("dst"))
        up = up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")
        links = links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, most: int = 400) -> DataFrame:
    """(host, trust, distrust), each summing to 1 if it has seeds. seeds: (host, n_allow, n_block).

    Both walks run in one join and one pre-aggregated sum a step: each edge carries trust forward and distrust back.
    Every fourth state is written out; the walk ends when a step moves less than ``tolerance`` in all. A step moves at
    most ``damping`` times what the one before moved, so 64 steps are enough for the defaults; not to be there after
    ``most`` is an error. Spark splits the edges of a host with very many.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    back = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    forward = edges.join(out, "src").select(F.col("src").alias("of"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("wt"), F.lit(0.0).alias("wd"))
    reverse = edges.join(back, "dst").select(F.col("dst").alias("of"), F.col("src").alias("to"), F.lit(0.0).alias("wt"), (F.col("n") / F.col("total")).alias("wd"))
    moves = settle(forward.unionByName(reverse), "trust-moves")
    sums = seeds.agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b")).first()
    nodes = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("host")).distinct()
    start = nodes.join(seeds, "host", "left").select(
        "host", (F.coalesce("n_allow", F.lit(0)) / float(sums["a"] or 1)).alias("st"), (F.coalesce("n_block", F.lit(0)) / float(sums["b"] or 1)).alias("sd")
    )
    state = settle(start.withColumn("trust", F.col("st")).withColumn("distrust", F.col("sd")), "trust-state")
    for _ in range(0, most, 4):
        step = state
        for _ in range(4):
            came = moves.join(step.select(F.col("host").alias("of"), "trust", "distrust"), "of").groupBy("to").agg(F.sum(F.col("trust") * F.col("wt")).alias("t"), F.sum(F.col("distrust") * F.col("wd")).alias("d"))
            step = step.join(came, F.col("host") == F.col("to"), "left").select(
                "host", "st", "sd", F.col("trust").alias("t0"), F.col("distrust").alias("d0"),
                ((1 - damping) * F.col("st") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
                ((1 - damping) * F.col("sd") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
            )
        step, old = settle(step, "trust-state"), state
        moved = step.agg(F.sum(F.abs(F.col("trust") - F.col("t0")) + F.abs(F.col("distrust") - F.col("d0"))).alias("m")).first()["m"] or 0.0
        state = step.select("host", "st", "sd", "trust", "distrust")
        discard(old)
        if moved < tolerance:
            break
    else:
        raise RuntimeError(f"after {most} steps a step still moves {moved}; allow more steps or a larger tolerance")
    total = state.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    return state.select("host", (F.col("trust") / (total["t"] or 1.0)).alias("trust"), (F.col("distrust") / (total["d"] or 1.0)).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, ratio: float = 1.0, site_edges: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page row.

    Urls that are null or lack ``://`` have empty host and path, fit no rule and are allowed, as is every host without
    distrust. Null html has no links. Extra columns are ignored; repeated rows count as so many pages.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = named.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    verdict = F.col("best.verdict")
    seeds = named.where("host <> ''").groupBy("host").agg(F.sum((verdict == "allow").cast("long")).alias("n_allow"), F.sum((verdict == "block").cast("long")).alias("n_block"))
    seeds = settle(seeds.na.fill(0), "trust-hosts")
    edges = settle(host_edges(pages, seeds, site_edges), "trust-edges")
    found = propagate(edges, seeds).toDF("h", "trust", "distrust")
    blocked = F.coalesce((F.col("distrust") > 0) & (F.col("distrust") > ratio * F.col("trust")), F.lit(False))
    return named.join(found, named.host == F.col("h"), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
