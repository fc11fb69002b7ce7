"""Queries on skewed keys (p6) and on per-account activity (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.accounts import sql_name, sql_valid, valid, valid_name
from weftline.operators import heavy_keys
from weftline.operators.entity_features import Events, feature_table
from weftline.sources.tables import table

# The stance labels and the parent types of a comment.
LABELS = ("supportive", "oppositional", "neutral", "mixed", "unclear")
PARENTS = ("post", "comment")
HEAVY_SHARE = 0.02
SHARES = {"score_p25": 0.25, "score_p50": 0.5, "score_p75": 0.75, "score_p90": 0.9}


def label(col: str = "feedback_label"):
    x = F.lower(F.trim(F.col(col), F.lit(" \t\r\n")))
    return F.when(x.isin(*LABELS), x).otherwise(F.lit("unclear"))


def distinct_comments(spark: SparkSession, folder: str) -> DataFrame:
    """One row per comment_id. Repeated ids agree in all fields but the padding of names."""
    c = table(spark, folder, "analyzed_comments").where(F.col("comment_id").isNotNull())
    return c.groupBy("comment_id").agg(
        F.max(valid_name("source_author")).alias("source"), F.max(valid_name("target_author")).alias("target"),
        F.min(label()).alias("label"), F.min("feedback_score").alias("score"),
    )


def sided(spark: SparkSession, folder: str) -> DataFrame:
    c = distinct_comments(spark, folder)
    sides = F.array(
        F.struct(F.lit("source").alias("side"), F.col("source").alias("account"), F.col("target").alias("other")),
        F.struct(F.lit("target").alias("side"), F.col("target").alias("account"), F.col("source").alias("other")),
    )
    return c.select(F.inline(sides), "label", "score").where(F.col("account").isNotNull())


ATTRIBUTES = ("other", "label", "score")


def weighted(spark: SparkSession, folder: str, *attributes: str) -> DataFrame:
    return heavy_keys.compress(sided(spark, folder), ["side", "account"], {a: F.col(a) for a in attributes})


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts with a large share of the comments of a side, from their weighted partners."""
    return heavy_keys.heavy(weighted(spark, folder, "other"), ["side"], "account", HEAVY_SHARE, "other").select("side", "account")


def p6_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Each account of each side: comments, distinct partners, modes and score percentiles."""
    w = weighted(spark, folder, *ATTRIBUTES)
    return heavy_keys.profiles(w, ["side", "account"], ["other", "label", "score"]).join(heavy_keys.percentiles(w, ["side", "account"], "score", SHARES), ["side", "account"], "left")


def account_events() -> Events:
    t = F.col("created_utc")
    return Events(
        entity=F.when((t >= 1e9) & (t < 2e9), valid_name("source_author")), time=t, event=F.col("comment_id"),
        kind=F.concat_ws("_", label(), F.coalesce("parent_type", F.lit("none"))), amount=F.col("feedback_score"),
        types=tuple(f"{a}_{b}" for a in LABELS for b in PARENTS),
    )


def p7_features(spark: SparkSession, folder: str) -> DataFrame:
    return feature_table(table(spark, folder, "analyzed_comments"), account_events()).withColumnRenamed("entity", "user_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    f = p7_features(spark, folder)
    return f.where(
        (F.col("event_count") >= 10) & (F.col("events_per_day") >= 6) & (F.col("mean_interval_seconds") <= 10800) & (F.col("burst_ratio") >= 2) & (F.col("night_activity_ratio") >= 0.5)
    ).select("user_id")


QUERIES = {"p6_found": p6_found, "p6_profiles": p6_profiles, "p7_found": p7_found, "p7_features": p7_features}

_LABEL = "case when lower(trim(feedback_label, ' ' || chr(9) || chr(10) || chr(13))) in (" + ", ".join(f"'{x}'" for x in LABELS) + ") then lower(trim(feedback_label, ' ' || chr(9) || chr(10) || chr(13))) else 'unclear' end"
_SIDED = f"""
c as (select comment_id, max(case when {sql_valid("source_author")} then {sql_name("source_author")} end) as s,
        max(case when {sql_valid("target_author")} then {sql_name("target_author")} end) as t, min({_LABEL}) as label, min(feedback_score) as score
      from analyzed_comments where comment_id is not null group by comment_id),
sided as (select 'source' as side, s as account, t as other, label, score from c where s is not null
          union all select 'target', t, s, label, score from c where t is not null)"""
_MODE = "(select {x} as v, count(*) as n, side, account from sided where {x} is not null group by side, account, {x})"


def _mode(x: str) -> str:
    return f"""m_{x} as (select side, account, v as {x}_mode, n as {x}_mode_rows from (select *, row_number() over (partition by side, account order by n desc, v::varchar) as r from {_MODE.format(x=x)}) where r = 1)"""


_EVENTS = f"""
e as (select {sql_name("source_author")} as user_id, comment_id, min(created_utc) as t, min({_LABEL}) || '_' || coalesce(min(parent_type), 'none') as kind, min(feedback_score) as amount
      from analyzed_comments where {sql_valid("source_author")} and comment_id is not null and created_utc >= 1e9 and created_utc < 2e9 group by 1, 2),
h as (select user_id, floor(t / 3600) as hour, count(*) as k from e group by 1, 2),
hh as (select user_id, count(*) as hours, max(k) as top, sum(case when hour::bigint % 24 < 6 then k else 0 end) as night, sum(case when (hour::bigint // 24 + 3) % 7 >= 5 then k else 0 end) as weekend from h group by 1),
a as (select user_id, count(*) as k, min(t) as t0, max(t) as t1, count(amount) as amount_n, coalesce(sum(amount), 0)::double as amount_s, min(amount)::double as amount_lo, max(amount)::double as amount_hi
      {{typed}} from e group by 1),
f as (select user_id, k as event_count, t0 as first_time, t1 as last_time, (floor((t1 - t0) / 86400) + 1)::bigint as active_days, k / (floor((t1 - t0) / 86400) + 1) as events_per_day,
        case when k > 1 then (t1 - t0) / (k - 1) else 0 end as mean_interval_seconds, hours as active_hours, top::bigint as max_events_per_hour, top / (k / hours + 1e-6) as burst_ratio,
        night / k as night_activity_ratio, weekend / k as weekend_activity_ratio, amount_n as amount_count, amount_s as amount_total, amount_lo as amount_min, amount_hi as amount_max {{names}}
      from a join hh using (user_id))"""


def _typed() -> tuple[str, str]:
    kinds = account_events_types()
    made = "".join(f", count(*) filter (kind = '{k}') as n_{k}, coalesce(sum(amount) filter (kind = '{k}'), 0)::double as total_{k}, max(t) filter (kind = '{k}') as last_{k}" for k in kinds)
    return made, "".join(f", n_{k}, total_{k}, last_{k}" for k in kinds)


def account_events_types() -> list[str]:
    return [f"{a}_{b}" for a in LABELS for b in PARENTS]


def oracle_sql() -> dict[str, str]:
    made, names = _typed()
    per = ", ".join(f"quantile_disc(score, {p})::double as {c}" for c, p in SHARES.items())
    return {
        "p6_found": f"with {_SIDED} select side, account from sided group by side, account having count(*) >= {HEAVY_SHARE} * (select count(*) from sided x where x.side = sided.side)",
        "p6_profiles": f"""with {_SIDED}, {_mode("other")}, {_mode("label")}, {_mode("score")},
            g as (select side, account, count(*) as rows, count(distinct other) as other_distinct, count(distinct label) as label_distinct, count(distinct score) as score_distinct, {per} from sided group by 1, 2)
            select g.*, other_mode, coalesce(other_mode_rows, 0) as other_mode_rows, label_mode, coalesce(label_mode_rows, 0) as label_mode_rows, score_mode::varchar as score_mode, coalesce(score_mode_rows, 0) as score_mode_rows
            from g left join m_other using (side, account) left join m_label using (side, account) left join m_score using (side, account)""",
        "p7_features": f"with {_EVENTS.format(typed=made, names=names)} select * from f",
        "p7_found": f"with {_EVENTS.format(typed='', names='')} select user_id from f where event_count >= 10 and events_per_day >= 6 and mean_interval_seconds <= 10800 and burst_ratio >= 2 and night_activity_ratio >= 0.5",
    }
