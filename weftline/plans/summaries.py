"""Queries that summarise pairs, tiers, groups and cohorts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.accounts import sql_name, sql_valid, valid_name
from weftline.operators import evaluation, rollup, text_features
from weftline.plans import accounts, pipeline
from weftline.plans.accounts import _EV, _S, _TIMING, SIGNALS, TIERS, sql_expand
from weftline.plans.interactions import C0, TR, WHOLE_NEGATIVE, WHOLE_T, C, E, P, comments, interactions, posts, sql_projection
from weftline.plans.lineage import cut
from weftline.plans.rounding import rounded, sql_rounded
from weftline.sources.tables import table


def members(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "expansion_members").select(valid_name("seed").alias("seed"), valid_name("candidate").alias("candidate"), "tier", "include")
    return m.where(F.col("seed").isNotNull() & F.col("candidate").isNotNull())


def group_names(spark: SparkSession, d: str) -> DataFrame:
    """Each seed's first 12 members by score, with the number of its members."""
    m = members(spark, d).select("seed", "candidate").distinct()
    s = accounts.scores(spark, d).select(F.col("user_id").alias("candidate"), "mca_score_primary")
    j = cut(m.join(s, "candidate", "left").withColumn("s", F.coalesce("mca_score_primary", F.lit(0.0))))
    names = rollup.first_names(j, "seed", "candidate", [F.desc("s"), F.asc("candidate")])
    return j.groupBy("seed").agg(F.count("*").alias("members"), F.avg("s").alias("mean_score"), F.max("s").alias("max_score"), F.count_if(F.col("s") >= 0.5).alias("high")).join(names, "seed")


def cohort_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = cut(accounts.scores(spark, d))
    m = members(spark, d)
    all_ = s.select("user_id", F.lit("all").alias("cohort"))
    seeds = m.select(F.col("seed").alias("user_id")).distinct().withColumn("cohort", F.lit("seeds"))
    cand = m.where(F.col("include")).select(F.col("candidate").alias("user_id")).distinct().withColumn("cohort", F.lit("members"))
    return rollup.coverage(all_.unionByName(seeds).unionByName(cand), s, "user_id", list(SIGNALS))


def matched_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of equal comment activity for the members of groups."""
    n = comments(spark, d).where(F.col("source").isNotNull()).groupBy(F.col("source").alias("account")).agg(F.count("*").alias("n")).withColumn("bin", evaluation.activity_bin("n"))
    n = cut(n)
    cand = members(spark, d).where(F.col("include")).select(F.col("candidate").alias("account")).distinct()
    return rollup.matched(n.join(cand, "account", "left_semi"), n, "account", "bin", 42)


def post_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Comment feedback of each cleaned post (inner join)."""
    f = text_features.comment_feedback(interactions(spark, d))
    return f.join(posts(spark, d).select("post_id", "author", "num_comments"), "post_id")


QUERIES = {
    "pair_summary": lambda s, d: rounded(rollup.pair_summary(accounts.pair_timing(s, d), ["label"])),
    "tier_counts": lambda s, d: rollup.tier_counts(members(s, d)),
    "group_names": lambda s, d: rounded(group_names(s, d)),
    "cohort_coverage": lambda s, d: rounded(cohort_coverage(s, d)),
    "matched_accounts": matched_accounts,
    "post_feedback": lambda s, d: rounded(post_feedback(s, d)),
    "expansion_sweep": pipeline.threshold_sweep,
}

_M = f"m as (select {sql_name('seed')} as seed, {sql_name('candidate')} as candidate, tier, include from expansion_members where {sql_valid('seed')} and {sql_valid('candidate')})"
_LABEL = "case when within_strong > 0 then 'strong_temporal_sync' when within_moderate >= 2 or (same_posts >= 3 and within_moderate > 0) then 'moderate_temporal_sync' when same_posts > 0 then 'weak_temporal_overlap' else 'no_temporal_sync' end"


def oracle_sql() -> dict[str, str]:
    from weftline.operators.cleaning import LABELS

    sweep = " union all ".join(
        f"select * from (with {E}, {P}, {WHOLE_T}, {sql_projection('con', 'w_opposed', replace(WHOLE_NEGATIVE, threshold=t))}, {TR}, {sql_expand(replace(TIERS, co_negative=t))} select tier, count(*) as members, count(distinct candidate) as accounts, {t}::double as threshold from ex group by 1)"
        for t in pipeline.SWEEP
    )
    bins = "case when n <= 0 then 0 when n <= 1 then 1 when n <= 3 then 2 when n <= 5 then 3 when n <= 10 then 4 when n <= 20 then 5 when n <= 50 then 6 when n <= 100 then 7 else 8 end"
    labels = ", ".join(f"count(*) filter (label = '{x}') as n_{x}, count(*) filter (label = '{x}') / count(*) as ratio_{x}" for x in LABELS)
    return {
        "pair_summary": sql_rounded(
            f"""with {C}, {_EV}, {_TIMING}, pl as (select *, {_LABEL} as label from pt), ac as (select label, count(distinct x) as accounts from (select label, a as x from pl union all select label, b from pl) group by 1)
            \nSELECT label, any_value(accounts) as accounts, count(*) as pairs, avg((same_posts > 0)::int) as same_post_rate, avg((within_strong > 0)::int) as strong_rate, avg((within_moderate > 0)::int) as moderate_rate, sum(same_posts)::bigint as same_posts, sum(within_strong)::bigint as strong_events, avg(median_delay) as mean_median_delay from pl join ac using (label) group by 1""",
            "same_post_rate strong_rate moderate_rate mean_median_delay",
        ),
        "tier_counts": f"with {_M} select tier, count(*) as rows, count(distinct seed) as seeds, count(distinct candidate) as candidates, count(*) filter (include) as included from m group by 1",
        "group_names": sql_rounded(
            f"with {_S}, {_M}, j as (select seed, candidate, coalesce(mca_score_primary, 0) as s from (select distinct seed, candidate from m) left join s on s.user_id = candidate), r as (select *, row_number() over (partition by seed order by s desc, candidate) as p from j)\nSELECT seed, count(*) as members, avg(s) as mean_score, max(s) as max_score, count(*) filter (s >= 0.5) as high, string_agg(candidate, ', ' order by p) filter (p <= 12) as names from r group by 1",
            "mean_score max_score",
        ),
        "cohort_coverage": sql_rounded(
            f"with {_S}, {_M}, c as (select user_id, 'all' as cohort from s union all select distinct seed, 'seeds' from m union all select distinct candidate, 'members' from m where include)\nSELECT cohort, count(*) as accounts, " + ", ".join(f"avg((coalesce({x}, 0) > 0)::int) as {x}_share, avg(coalesce({x}, 0)) as {x}_mean" for x in SIGNALS) + " from c left join s using (user_id) group by 1",
            " ".join(f"{x}_share {x}_mean" for x in SIGNALS),
        ),
        "expansion_sweep": sweep,
        "matched_accounts": f"""with {C0}, {_M}, n as (select account, {bins} as bin from (select source as account, count(*) as n from c0 where source is not null group by 1)), cm as (select distinct candidate from m where include),
            x as (select account, bin, row_number() over (partition by bin order by md5('42:' || account), account) as p from n where account in (select candidate from cm)),
            y as (select account as match, bin, row_number() over (partition by bin order by md5('42:' || account), account) as p from n where account not in (select candidate from cm))
            select account, match, bin::int as bin from x left join y using (bin, p)""",
        "post_feedback": sql_rounded(f"with {C}, {P}\nSELECT post_id, count(*) as comments, avg(score) as mean_score, min(score) as min_score, max(score) as max_score, {labels}, any_value(p.author) as author, any_value(p.num_comments) as num_comments from c join p using (post_id) group by 1", "mean_score min_score max_score " + " ".join(f"ratio_{x}" for x in LABELS)),
    }
