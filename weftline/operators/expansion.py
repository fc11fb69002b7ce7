"""Seed expansion by tiers of evidence, for all seeds at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import top_per_group


@dataclass(frozen=True)
class Tiers:
    co_negative: float = 0.2
    tag: float = 0.9
    trigger: float = 0.5
    co_target: float = 0.3
    min_links: int = 2
    max_members: int = 100


def both_ways(pairs: DataFrame, weight: str, a: str = "a", b: str = "b") -> DataFrame:
    """(me, other, w): the strongest weight of each unordered pair, seen from both ends."""
    p = pairs.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(weight).alias("w")).where(F.col("a") != F.col("b"))
    return p.select(F.col("a").alias("me"), F.col("b").alias("other"), "w").unionByName(p.select(F.col("b").alias("me"), F.col("a").alias("other"), "w"))


def neighbours(pairs: DataFrame, seeds: DataFrame, weight: str, top_n: int) -> DataFrame:
    """(seed, neighbour, weight, place): each seed's strongest partners in an undirected layer."""
    j = both_ways(pairs, weight).join(seeds.select(F.col("seed").alias("me")), "me")
    return top_per_group(j.toDF("seed", "neighbour", "weight"), ["seed"], [F.desc("weight"), F.asc("neighbour")], top_n, "place")


def directed_neighbours(edges: DataFrame, seeds: DataFrame, weight: str, top_n: int, a: str = "a", b: str = "b") -> DataFrame:
    """(seed, direction, neighbour, weight, place) of a directed layer."""
    out = edges.select(F.col(a).alias("seed"), F.lit("out").alias("direction"), F.col(b).alias("neighbour"), F.col(weight).alias("weight"))
    into = edges.select(F.col(b).alias("seed"), F.lit("in").alias("direction"), F.col(a).alias("neighbour"), F.col(weight).alias("weight"))
    j = out.unionByName(into).join(seeds.select("seed"), "seed", "left_semi")
    return top_per_group(j, ["seed", "direction"], [F.desc("weight"), F.asc("neighbour")], top_n, "place")


def tier(cfg: Tiers) -> tuple[Column, Column]:
    """Tier and reason from the four weights of a seed and a direct neighbour; 99 is not included."""
    neg, tag, trig, co = (F.col(c) for c in ("co_negative", "tag", "trigger", "co_target"))
    cases = [
        (neg >= cfg.co_negative, 1, "co_negative"),
        ((tag >= cfg.tag) & ((neg > 0) | (co >= cfg.co_target) | (trig >= cfg.trigger)), 2, "tag_with_structure"),
        ((trig >= cfg.trigger) & ((neg > 0) | (tag >= cfg.tag)), 3, "trigger_with_co_negative_or_tag"),
        (co >= cfg.co_target, 99, "support_only_co_target"),
        (tag >= cfg.tag, 99, "support_only_tag"),
        (trig >= cfg.trigger, 99, "support_only_trigger"),
    ]
    number, reason = F.lit(99), F.lit("not_included")
    for when, n, why in reversed(cases):
        number, reason = F.when(when, n).otherwise(number), F.when(when, F.lit(why)).otherwise(reason)
    return number, reason


def expand(seeds: DataFrame, layers: dict[str, DataFrame], cfg: Tiers) -> DataFrame:
    """(seed, candidate, tier, reason, the four weights, links, their first 12 names): direct candidates of tiers 1 to 3,
    two-hop candidates of tier 4 with enough links to accepted accounts, and the seed itself.

    ``layers`` maps co_negative, co_target, tag and trigger to (me, other, w) frames of both_ways.
    One pass of joins serves every seed; nothing is rescanned per seed.
    """
    s = seeds.select("seed").distinct()
    names = ("co_negative", "tag", "trigger", "co_target")

    def weights(pairs: DataFrame) -> DataFrame:
        """Weights of all layers for (seed, candidate) pairs."""
        for n in names:
            pairs = pairs.join(layers[n].select(F.col("me").alias("seed"), F.col("other").alias("candidate"), F.col("w").alias(n)), ["seed", "candidate"], "left")
        return pairs.na.fill(0.0, list(names))

    near = None
    for n in names:
        d = layers[n].join(s, F.col("me") == F.col("seed")).select("seed", F.col("other").alias("candidate"))
        near = d if near is None else near.unionByName(d)
    number, reason = tier(cfg)
    direct = weights(near.distinct()).withColumns({"tier": number, "reason": reason, "links": F.lit(0).cast("long"), "connectors": F.lit("")})
    own = s.select("seed", F.col("seed").alias("candidate"), *[F.lit(0.0).alias(n) for n in names], F.lit(0).alias("tier"), F.lit("seed").alias("reason"), F.lit(0).cast("long").alias("links"), F.lit("").alias("connectors"))
    accepted = direct.where(F.col("tier") < 99).unionByName(own)
    hop = accepted.select("seed", F.col("candidate").alias("me")).join(layers["co_negative"].where(F.col("w") >= cfg.co_negative), "me")
    hop = hop.where(F.col("other") != F.col("me")).select("seed", F.col("other").alias("candidate"), "me").distinct()
    named = top_per_group(hop, ["seed", "candidate"], [F.asc("me")], 12).groupBy("seed", "candidate").agg(F.array_join(F.array_sort(F.collect_list("me")), ", ").alias("connectors"))
    hop = hop.groupBy("seed", "candidate").agg(F.count("*").alias("links")).where(F.col("links") >= cfg.min_links).join(named, ["seed", "candidate"])
    hop = hop.join(accepted.select("seed", "candidate"), ["seed", "candidate"], "left_anti")
    second = weights(hop).withColumns({"tier": F.lit(4), "reason": F.lit("two_hop")})
    rows = accepted.unionByName(second)
    order = [F.asc("tier"), *[F.desc(n) for n in names], F.asc("candidate")]
    return top_per_group(rows, ["seed"], order, cfg.max_members).select("seed", "candidate", "tier", "reason", *names, "links", "connectors")


def induced(pairs: DataFrame, members: DataFrame, weight: str) -> DataFrame:
    """Pairs with both ends among a seed's members: (seed, a, b, weight)."""
    m = members.select("seed", "candidate")
    j = pairs.select("a", "b", F.col(weight).alias("weight")).join(m.toDF("seed", "a"), "a").join(m.toDF("seed", "b"), ["seed", "b"])
    return j.select("seed", "a", "b", "weight")


def shared_with_seed(members: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """(seed, candidate, shared, weight_sum): targets a member shares with its seed; 0 where none."""
    e = edges.select("source", "target", F.col(weight).alias("w"))
    m = members.where(F.col("seed") != F.col("candidate")).select("seed", "candidate").distinct()
    theirs = m.join(e, F.col("candidate") == F.col("source")).select("seed", "candidate", "target", "w")
    seeds = e.select(F.col("source").alias("seed"), "target").join(m.select("seed").distinct(), "seed", "left_semi").distinct()
    both = theirs.join(seeds, ["seed", "target"]).groupBy("seed", "candidate").agg(F.countDistinct("target").alias("shared"), F.sum("w").alias("weight_sum"))
    return m.join(both, ["seed", "candidate"], "left").select("seed", "candidate", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("weight_sum", F.lit(0.0)).alias("weight_sum"))
