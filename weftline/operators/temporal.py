"""Temporal synchrony of account pairs: same posts, events within minutes of each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import top_per_group
from weftline.plans.lineage import cut, shuffle_partitions

TIMING = ("same_posts", "within_strong", "within_moderate", "median_delay", "min_delay", "label", "confidence")


@dataclass(frozen=True)
class Windows:
    strong: float = 5.0  # minutes, inclusive
    moderate: float = 30.0
    latest: int = 100  # comments per account; 0 for all


def group_pairs(members: DataFrame, group: str, account: str, block: int = 2048) -> DataFrame:
    """(group, a, b) with a < b: all pairs within each group, however large.

    The members of a group are cut into blocks of about ``block``; each two blocks meet in their own
    task, so the pairs of one large group are made in many places. A member is sent once for each
    block of its group: at most one row for about ``block`` / 2 pairs.
    """
    n = shuffle_partitions(members.sparkSession)
    m = members.select(F.col(group).alias("grp"), F.col(account).alias("x")).distinct()
    m = m.join(m.groupBy("grp").agg(F.ceil(F.count("*") / block).alias("blocks")), "grp")
    m = m.select("grp", "x", F.pmod(F.xxhash64("x"), F.col("blocks")).alias("own"), (F.col("blocks") - 1).alias("last"))
    left = m.select("grp", F.col("own").alias("i"), F.explode(F.sequence("own", "last")).alias("j"), F.col("x").alias("a")).repartition(n, "grp", "i", "j")
    right = m.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("i"), F.col("own").alias("j"), F.col("x").alias("b")).repartition(n, "grp", "i", "j")
    met = left.join(right, ["grp", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    return met.select("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def group_timing(members: DataFrame, group: str, account: str, comments: DataFrame, cfg: Windows) -> DataFrame:
    """(group, a, b, timing, label, confidence) of all pairs within each group; a pair in several groups is timed once."""
    pairs = cut(group_pairs(members, group, account).withColumnRenamed("grp", group))
    return pairs.join(labelled(pair_timing(pairs, comments, cfg)), ["a", "b"]).select(group, "a", "b", *TIMING)


def pair_timing(pairs: DataFrame, comments: DataFrame, cfg: Windows) -> DataFrame:
    """(a, b, same_posts, within_strong, within_moderate, median_delay, min_delay) for distinct pairs.

    All event pairs on shared posts count; the delays are over shared posts, of each the smallest
    distance. Only wanted accounts are read, and each with its ``latest`` comments, so a pair of
    accounts joins at most latest^2 events however busy the post.
    """
    c = comments.where(F.col("post_id").isNotNull() & F.col("ts").isNotNull()).select(F.col("source").alias("account"), "post_id", "ts", "comment_id")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("account")).distinct()
    c = c.join(wanted, "account", "left_semi")
    if cfg.latest:
        c = top_per_group(c, ["account"], [F.desc("ts"), F.asc("comment_id")], cfg.latest)
    p = pairs.select("a", "b").distinct()
    left, right = c.select(F.col("account").alias("a"), "post_id", F.col("ts").alias("ta")), c.select(F.col("account").alias("b"), "post_id", F.col("ts").alias("tb"))
    d = F.abs(F.col("ta") - F.col("tb")) / 60
    met = p.join(left, "a").join(right, ["b", "post_id"]).groupBy("a", "b", "post_id").agg(F.min(d).alias("d"), F.count_if(d <= cfg.strong).alias("s"), F.count_if(d <= cfg.moderate).alias("m"))
    got = met.groupBy("a", "b").agg(F.count("*").alias("same_posts"), F.sum("s").alias("within_strong"), F.sum("m").alias("within_moderate"), F.percentile("d", F.lit(0.5)).alias("median_delay"), F.min("d").alias("min_delay"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return p.join(got, ["a", "b"], "left").select("a", "b", zero("same_posts"), zero("within_strong"), zero("within_moderate"), "median_delay", "min_delay")


def sync_label(same: Column, strong: Column, moderate: Column) -> Column:
    return (
        F.when(strong > 0, "strong_temporal_sync").when((moderate >= 2) | ((same >= 3) & (moderate > 0)), "moderate_temporal_sync").when(same > 0, "weak_temporal_overlap").otherwise("no_temporal_sync")
    )


def confidence(same: Column, strong: Column, moderate: Column, median: Column) -> Column:
    some = (strong > 0) | (moderate > 0)
    return (
        F.when(same == 0, "none")
        .when((strong >= 2) | ((same >= 3) & (moderate >= 2) & (median <= 90)), "robust")
        .when((same == 1) & (strong == 1) & (moderate == 1), "fragile_single_event")
        .when((median > 120) & some, "fragile_long_median")
        .when(some, "moderate_review")
        .otherwise("weak_context")
    )


def labelled(timing: DataFrame) -> DataFrame:
    args = [F.col(c) for c in ("same_posts", "within_strong", "within_moderate")]
    return timing.withColumns({"label": sync_label(*args), "confidence": confidence(*args, F.col("median_delay"))})


def group_counts(evidence: DataFrame, group: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """One row per group: pairs in all and by label (a pivot over a fixed domain)."""
    return evidence.groupBy(group).agg(F.count("*").alias("pairs"), *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def account_rollup(evidence: DataFrame, column: str, ranks: dict[str, int], delay: str) -> DataFrame:
    """Both sides of each pair: (account, pairs, best label, labelled pairs, smallest delay)."""
    rank = F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in ranks.items()], F.lit(-1))
    e = evidence.withColumn("rank", rank)
    sides = e.select(F.explode(F.array("a", "b")).alias("account"), "rank", F.col(column).alias("label"), F.col(delay).alias("delay"))
    return sides.groupBy("account").agg(F.count("*").alias("pairs"), F.max("rank").alias("best_rank"), F.max(F.struct("rank", "label"))["label"].alias("best_label"), F.count_if(F.col("rank") >= 2).alias("strong_pairs"), F.min("delay").alias("min_delay"))
