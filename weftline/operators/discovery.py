"""Groups in full: overview with member features, ranking, synchrony by group, tiers of pair ends, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.evaluation import activity_bin
from weftline.operators.ranking import global_index, top_per_group, top_rows

# What a member contributes; missing values and missing members count as 0.
MEANS = {"rhetoric": "mean_rhetoric", "nonneutral": "mean_nonneutral", "opposed": "mean_opposed", "anomaly_score": "mean_anomaly_score"}
TOTALS = {"comments": "total_comments", "posts": "total_posts"}


def member_features(members: DataFrame, features: DataFrame, group: str, account: str) -> DataFrame:
    """Per group: members, means and totals of their features, share of anomalous members. ``features``
    is keyed by user_id and has the columns of MEANS and TOTALS and anomaly_label."""
    j = members.select(group, F.col(account).alias("user_id")).join(features, "user_id", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    odd = F.count_if(F.col("anomaly_label") == -1) / F.count("*")
    return j.groupBy(group).agg(F.count("*").alias("members"), *[F.avg(zero(c)).alias(o) for c, o in MEANS.items()], odd.alias("anomaly_share"), *[F.sum(zero(c)).alias(o) for c, o in TOTALS.items()])


def group_overview(pairs: DataFrame, members: DataFrame, shared: DataFrame, features: DataFrame, weight: str, layer: str, threshold: float, top: int = 50) -> DataFrame:
    """The ``top`` groups by inner weight, number of shared targets and size, all descending (ties: the
    smallest account first), numbered layer_tNNN_iii, with density, weights, shared targets and
    member features. ``shared`` is graph.shared_targets of the groups."""
    ends = members.select(F.col("account").alias("a"), "group_id", "size")
    inner = pairs.join(ends, "a").groupBy("group_id", "size").agg(F.count("*").alias("edges"), F.round(F.sum(weight), 9).alias("weight_sum"), F.avg(weight).alias("weight_mean"), F.max(weight).alias("weight_max"))
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "target")))), lambda x: x["target"])
    targets = shared.groupBy("group_id").agg(F.count("*").alias("shared_targets"), F.array_join(named, "; ").alias("top_targets"))
    g = inner.join(targets, "group_id", "left").withColumns({"shared_targets": F.coalesce("shared_targets", F.lit(0)), "top_targets": F.coalesce("top_targets", F.lit("")), "density": 2 * F.col("edges") / (F.col("size") * (F.col("size") - 1))})
    g = top_rows(g, [F.desc("weight_sum"), F.desc("shared_targets"), F.desc("size"), F.asc("group_id")], top, "place")
    name = F.concat(F.lit(f"{layer}_t{int(threshold * 100):03d}_"), F.lpad(F.col("place").cast("string"), 3, "0"))
    few = members.join(g.select("group_id"), "group_id", "left_semi")
    return g.join(member_features(few, features, "group_id", "account").drop("members"), "group_id").select(name.alias("name"), *g.columns, *MEANS.values(), "anomaly_share", *TOTALS.values())


def group_sync(timing: DataFrame, group: str, labels: tuple[str, ...]) -> DataFrame:
    """Per group: pairs by label, and robust, moderate_review and fragile pairs, from computed timing."""
    here = lambda c, *v: F.count_if(F.col(c).isin(*v))
    return timing.groupBy(group).agg(
        F.count("*").alias("pairs"), *[here("label", x).alias(f"n_{x}") for x in labels], here("confidence", "robust").alias("robust_pairs"), here("confidence", "moderate_review").alias("moderate_review_pairs"),
        here("confidence", "fragile_single_event", "fragile_long_median").alias("fragile_pairs"), F.sum("within_strong").alias("strong_events"), F.sum("within_moderate").alias("moderate_events"),
    )


def ranked_groups(groups: DataFrame, keys: list[str], last: str) -> DataFrame:
    """Adds ``group_rank`` from 1 by the keys, all descending, ties by ``last``; no one-task window."""
    down = {f"_k{i}": -F.coalesce(F.col(k).cast("double"), F.lit(0.0)) for i, k in enumerate(keys)}
    return global_index(groups.withColumns(down), [*down, last], "group_rank", 1).drop(*down)


def with_tiers(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Adds tier_a, tier_b (null where the account is no member of the seed) and ``has_tier4``."""
    t = members.groupBy("seed", "candidate").agg(F.min("tier").alias("tier"))
    j = pairs.join(t.toDF("seed", "a", "tier_a"), ["seed", "a"], "left").join(t.toDF("seed", "b", "tier_b"), ["seed", "b"], "left")
    return j.withColumn("has_tier4", F.coalesce(F.col("tier_a") == 4, F.lit(False)) | F.coalesce(F.col("tier_b") == 4, F.lit(False)))


def tier_ablation(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(setting, memberships, accounts, pairs, strong, moderate, robust) with tier 4, without it, and of it
    alone. ``pairs`` has has_tier4, label and confidence."""
    settings = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("setting")) for i, s in enumerate(("with_tier4", "without_tier4", "tier4_only"))])
    in_it = lambda four: (F.col("i") == 0) | ((F.col("i") == 1) & ~four) | ((F.col("i") == 2) & four)
    m = members.select("*", F.inline(settings)).where(in_it(F.coalesce(F.col("tier") == 4, F.lit(False)))).groupBy("setting").agg(F.count("*").alias("memberships"), F.countDistinct("candidate").alias("accounts"))
    p = pairs.select("*", F.inline(settings)).where(in_it(F.col("has_tier4"))).groupBy("setting").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("label") == "strong_temporal_sync").alias("strong"), F.count_if(F.col("label") == "moderate_temporal_sync").alias("moderate"), F.count_if(F.col("confidence") == "robust").alias("robust")
    )
    return m.join(p, "setting", "full").na.fill(0)


def drawn(seed: int, what: str, number: Column, size: Column) -> Column:
    """A number in [0, size) by md5 of the seed, the purpose and a running number: the same in any engine."""
    h = F.md5(F.concat(F.lit(f"{seed}:{what}:"), number.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("long"), size)


def random_pairs(accounts: DataFrame, key: str, n: int = 5000, seed: int = 42) -> DataFrame:
    """(a, b): ``n`` distinct pairs of different accounts by hash draws (fewer where there are not so
    many). The draws are numbered; the accounts are reached by their positions."""
    spark = accounts.sparkSession
    at = global_index(accounts.select(F.col(key).alias("x")).distinct(), ["x"], "at")
    size = at.agg(F.count("*").alias("size"))
    d = spark.range(2 * n).crossJoin(F.broadcast(size)).where(F.col("size") > 1)  # size is one row
    d = d.select("id", drawn(seed, "a", F.col("id"), F.col("size")).alias("i"), drawn(seed, "b", F.col("id"), F.col("size")).alias("j")).where(F.col("i") != F.col("j"))
    d = d.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min("id").alias("id")).orderBy("id").limit(n)
    return d.join(at.toDF("a", "i"), "i").join(at.toDF("b", "j"), "j").select("a", "b")


def matched_pairs(pairs: DataFrame, counts: DataFrame, pool: DataFrame, seed: int = 42) -> DataFrame:
    """(a, b): for each pair two accounts of the pool whose activity lies in the bins of its ends, by hash
    draws from the bin, or from the whole pool where the bin has none; equal draws and repeated pairs
    fall away. ``counts`` and ``pool`` have (account, n)."""
    binned = lambda d: d.withColumn("bin", activity_bin("n"))
    ends = binned(counts).select(F.col("account"), "bin")
    p = pairs.select("a", "b").distinct()
    for x in "ab":
        p = p.join(ends.toDF(x, f"bin_{x}"), x, "left").withColumn(f"bin_{x}", F.coalesce(f"bin_{x}", F.lit(0)))
    at = global_index(binned(pool).select("account", "bin"), ["bin", "account"], "at")
    bins = at.groupBy("bin").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    total = at.agg(F.count("*").alias("all"))
    name = F.concat_ws("|", "a", "b")
    for x in "ab":
        # bins has one row for each of the nine bins, total is one row
        p = p.join(F.broadcast(bins.toDF(f"bin_{x}", f"first_{x}", f"size_{x}")), f"bin_{x}", "left").crossJoin(F.broadcast(total.toDF(f"all_{x}")))
        p = p.withColumn(f"at_{x}", F.coalesce(f"first_{x}", F.lit(0)) + drawn(seed, f"match-{x}", name, F.coalesce(f"size_{x}", f"all_{x}")))
    q = p.where(F.col("at_a") != F.col("at_b")).select(F.least("at_a", "at_b").alias("i"), F.greatest("at_a", "at_b").alias("j")).distinct()
    return q.join(at.select(F.col("at").alias("i"), F.col("account").alias("x")), "i").join(at.select(F.col("at").alias("j"), F.col("account").alias("y")), "j").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def suspicion(means: DataFrame) -> DataFrame:
    """Adds ``suspicion_score`` of clusters from their mean features, and their rank by it and size."""
    w = {"mean_rhetoric_score": 0.55, "mean_high_manipulation": 25.0, "mean_tag_call_to_action": 12.0, "mean_tag_urgency": 10.0, "mean_tag_overconfidence": 9.0, "mean_tag_fear": 8.0, "mean_ratio_oppositional": 10.0, "mean_controversy": 8.0}  # fixed values
    score = F.round(sum((F.lit(v) * F.col(c) for c, v in w.items()), F.lit(0.0)), 3)
    return ranked_groups(means.withColumn("suspicion_score", score), ["suspicion_score", "posts"], "cluster").withColumnRenamed("group_rank", "suspicion_rank")


def first_titles(posts: DataFrame, group: str, title: str, order: list[Column], n: int = 3) -> DataFrame:
    t = top_per_group(posts, [group], order, n, "_p")
    return t.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce(F.col(title), F.lit("")).alias("t")))), lambda x: x["t"]), " || ").alias("titles"))
