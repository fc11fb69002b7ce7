"""Summaries of pairs, tiers and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import ratio_or_zero
from weftline.operators.ranking import top_per_group


def pair_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pairs, accounts, shares of pairs on a same post and within the windows, sums and mean delay."""
    n = F.count("*")
    rate = lambda c: ratio_or_zero(F.count_if(F.col(c) > 0), n)
    one = pairs.groupBy(*by).agg(n.alias("pairs"), rate("same_posts").alias("same_post_rate"), rate("within_strong").alias("strong_rate"), rate("within_moderate").alias("moderate_rate"), F.sum("same_posts").alias("same_posts"), F.sum("within_strong").alias("strong_events"), F.avg("median_delay").alias("mean_median_delay"))
    ends = pairs.select(*by, F.explode(F.array("a", "b")).alias("x")).groupBy(*by).agg(F.countDistinct("x").alias("accounts"))
    return one.join(ends, by) if by else one.crossJoin(F.broadcast(ends))  # one row each


def tier_counts(members: DataFrame) -> DataFrame:
    """(tier, rows, seeds, candidates, included) of expansion members."""
    return members.groupBy("tier").agg(F.count("*").alias("rows"), F.countDistinct("seed").alias("seeds"), F.countDistinct("candidate").alias("candidates"), F.count_if("include").alias("included"))


def first_names(members: DataFrame, group: str, name: str, order: list[Column], n: int = 12) -> DataFrame:
    """(group, names): the first n names in order, joined by commas."""
    t = top_per_group(members, [group], order, n, "_p")
    return t.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.col(name).alias("v")))), lambda x: x["v"]), ", ").alias("names"))


def coverage(cohorts: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(cohort, accounts, <c>_share, <c>_mean): how many of each cohort have a positive value."""
    j = cohorts.join(values.select(key, *columns), key, "left").na.fill(0.0, columns)
    return j.groupBy("cohort").agg(F.count("*").alias("accounts"), *[F.avg((F.col(c) > 0).cast("int")).alias(f"{c}_share") for c in columns], *[F.avg(c).alias(f"{c}_mean") for c in columns])


def matched(candidates: DataFrame, pool: DataFrame, key: str, bin_: str, seed: int) -> DataFrame:
    """(key, match): for each candidate an account of the pool with the same activity bin, not itself a
    candidate, picked by hash order; candidates of a bin beyond its pool get none."""
    from pyspark.sql import Window

    spare = pool.join(candidates.select(key), key, "left_anti")
    place = lambda d: d.withColumn("_p", F.row_number().over(Window.partitionBy(bin_).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")), key)))
    most = candidates.groupBy(bin_).agg(F.count("*").alias("_most"))
    few = place(spare).join(most, bin_).where(F.col("_p") <= F.col("_most"))
    return place(candidates).select(key, bin_, "_p").join(few.select(F.col(key).alias("match"), bin_, "_p"), [bin_, "_p"], "left").select(key, "match", bin_)
