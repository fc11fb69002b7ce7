"""Queries on account tables: p1 (alike target sets), p2 (linked groups), p4 (top candidates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.accounts import finite, name, sql_finite, sql_name, sql_valid, valid, valid_name
from weftline.llm.groups import connected_groups
from weftline.llm.set_pairs import SetJoin, record_classes, set_pairs
from weftline.llm.top_items import top_items
from weftline.sources.tables import table

MIN_WEIGHT = 0.3
TOP_N = 10


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "analyzed_comments").where(valid("source_author") & valid("target_author") & (name("source_author") != name("target_author")))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each source account with at least three targets: its class of equal target sets and its links."""
    return record_classes(_targets(spark, folder), name("source_author"), name("target_author"), SetJoin(0.6, 3)).withColumnRenamed("record", "account")


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of source accounts with largely the same targets, and how many they share."""
    p = set_pairs(_targets(spark, folder), name("source_author"), name("target_author"), SetJoin(0.6, 3))
    return p.select(
        F.col("record_lo").alias("account_lo"), F.col("record_hi").alias("account_hi"), F.col("shared").alias("shared_target_count"),
        (F.col("shared") / (F.col("size_lo") + F.col("size_hi") - F.col("shared"))).alias("overlap"),
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pairs(spark, folder).select("account_lo", "account_hi")


def _links(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "pair_evidence").where(finite("co_negative_weight") >= MIN_WEIGHT)
    e = e.select(valid_name("account_a").alias("a"), valid_name("account_b").alias("b"), finite("co_negative_weight").alias("w"))
    return e.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return connected_groups(_links(spark, folder), "a", "b").select(F.col("vertex").alias("account"), "group_id")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each group with its members, distinct links and highest weight."""
    links = _links(spark, folder)
    label = p2_found(spark, folder)
    e = links.groupBy(F.least("a", "b").alias("account"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"))
    per = e.join(label, "account").groupBy("group_id").agg(F.count("*").alias("links"), F.max("w").alias("max_weight"))
    return label.groupBy("group_id").agg(F.count("*").alias("accounts")).join(per, "group_id")


def p4_top(spark: SparkSession, folder: str) -> DataFrame:
    """For each seed its best-scored candidates."""
    m = table(spark, folder, "expansion_members").select(valid_name("seed").alias("seed"), valid_name("candidate").alias("candidate"))
    m = m.where(F.col("seed").isNotNull() & F.col("candidate").isNotNull() & (F.col("seed") != F.col("candidate")))
    s = table(spark, folder, "mca_scores").select(valid_name("user_id").alias("candidate"), finite("mca_score_primary").alias("score"))
    s = s.where(F.col("candidate").isNotNull() & F.col("score").isNotNull()).groupBy("candidate").agg(F.max("score").alias("score"))
    return top_items(m.join(s, "candidate"), "seed", "candidate", "score", TOP_N)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_top(spark, folder).select("seed", "candidate")


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p1_classes": p1_classes, "p2_found": p2_found, "p2_groups": p2_groups, "p4_found": p4_found, "p4_top": p4_top}

_P1 = f"""st as (select distinct {sql_name("source_author")} as s, {sql_name("target_author")} as t from analyzed_comments
        where {sql_valid("source_author")} and {sql_valid("target_author")} and {sql_name("source_author")} <> {sql_name("target_author")}),
    sz as (select s, count(*) as n from st group by 1),
    x as (select a.s as lo, b.s as hi, count(*) as c from st a join st b on a.t = b.t and a.s < b.s group by 1, 2),
    p as (select lo as account_lo, hi as account_hi, c as shared_target_count, c / (za.n + zb.n - c) as overlap from x join sz za on za.s = lo join sz zb on zb.s = hi
        where c >= 3 and c >= 0.6 * (za.n + zb.n - c) - 1e-9)"""
_P2 = f"""l0 as (select {sql_name("account_a")} as a, {sql_name("account_b")} as b, co_negative_weight as w from pair_evidence
        where {sql_valid("account_a")} and {sql_valid("account_b")} and {sql_finite("co_negative_weight")} >= {MIN_WEIGHT}),
    l1 as (select least(a, b) as a, greatest(a, b) as b, max(w) as w from l0 where a <> b group by 1, 2),
    e as (select a, b from l1 union all select b, a from l1),
    r(v, u) as (select a, a from e union select r.v, e.b from r join e on e.a = r.u),
    g as (select v as account, min(u) as group_id from r group by 1)"""
_P4 = f"""m as (select distinct {sql_name("seed")} as seed, {sql_name("candidate")} as candidate from expansion_members
        where {sql_valid("seed")} and {sql_valid("candidate")} and {sql_name("seed")} <> {sql_name("candidate")}),
    s as (select {sql_name("user_id")} as candidate, max(mca_score_primary) as score from mca_scores where {sql_finite("mca_score_primary")} is not null group by 1),
    t as (select *, row_number() over (partition by seed order by score desc, candidate) as r from m join s using (candidate))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_P1} select account_lo, account_hi from p",
        "p1_pairs": f"with {_P1} select * from p",
        "p1_classes": f"""with {_P1}, ls as (select s as account, list_sort(list(t)) as l from st group by 1 having count(*) >= 3), k as (select *, min(account) over (partition by l) as class_id, count(*) over (partition by l) as copies from ls),
            n as (select account, count(distinct class_id) as links from (select p.account_lo as account, k.class_id from p join k on k.account = p.account_hi union all select p.account_hi, k.class_id from p join k on k.account = p.account_lo) x join (select account, class_id as own from k) o using (account) where class_id <> own group by 1)
            select account, class_id, copies, coalesce(links, 0) as links from k left join n using (account)""",
        "p2_found": f"with recursive {_P2} select * from g",
        "p2_groups": f"with recursive {_P2} select group_id, count(*) as accounts, any_value(links) as links, any_value(w) as max_weight from g join (select group_id, count(*) as links, max(w) as w from l1 join g on g.account = a group by 1) using (group_id) group by 1",
        "p4_found": f"with {_P4} select seed, candidate from t where r <= {TOP_N}",
        "p4_top": f"with {_P4} select seed, candidate, score from t where r <= {TOP_N}",
    }
