"""Queries on posts: p5 (near-duplicate texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.near_duplicates import NearDuplicates, near_duplicate_groups, near_duplicate_pairs
from weftline.sources.tables import table

POSTS = NearDuplicates(threshold=0.6, width=3, min_words=20)


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of posts with nearly the same text, and their similarity."""
    p = near_duplicate_pairs(table(spark, folder, "posts"), F.col("post_id"), F.col("analysis_text"), POSTS)
    return p.select(F.col("id_lo").alias("post_id_a"), F.col("id_hi").alias("post_id_b"), (F.col("shared") / (F.col("n_lo") + F.col("n_hi") - F.col("shared"))).alias("similarity"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pairs(spark, folder).select("post_id_a", "post_id_b")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    g = near_duplicate_groups(table(spark, folder, "posts"), F.col("post_id"), F.col("analysis_text"), POSTS)
    return g.withColumnRenamed("id", "post_id")


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs, "p5_groups": p5_groups}

_P5 = """t as (select post_id, any_value(analysis_text) as x from posts where post_id is not null and analysis_text is not null group by 1),
    w as (select post_id, regexp_extract_all(lower(x), '[a-z0-9]+') as w from t),
    s as (select post_id, list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) as s from w where len(w) >= 20),
    f as (select post_id, len(s) as n, unnest(s) as v from s),
    k as (select v from f group by 1 having count(*) > 1),
    g as (select f.* from f semi join k using (v)),
    c as (select a.post_id as post_id_a, b.post_id as post_id_b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as o from g a join g b on a.v = b.v and a.post_id < b.post_id group by 1, 2),
    p as (select post_id_a, post_id_b, o / (na + nb - o) as similarity from c where o >= 0.6 * (na + nb - o) - 1e-9)"""


def oracle_sql() -> dict[str, str]:
    groups = """u as (select post_id, list_sort(s) as s from s where len(w) >= 20),
    c1 as (select post_id, min(post_id) over (partition by s) as class_id, count(*) over (partition by s) as copies from u),
    q as (select distinct x.class_id as a, y.class_id as b from p join c1 x on x.post_id = post_id_a join c1 y on y.post_id = post_id_b where x.class_id <> y.class_id),
    d as (select a, b from q union select b, a from q),
    r(v, u) as (select class_id, class_id from c1 union select r.v, d.b from r join d on d.a = r.u),
    m as (select v, min(u) as group_id from r group by 1), n as (select a, count(*) as links from d group by 1)
    select post_id, class_id, copies, coalesce(links, 0) as links, group_id from c1 join m on m.v = class_id left join n on n.a = class_id"""
    return {"p5_groups": f"with recursive {_P5.replace(' as s from w where', ' as s, w from w where')}, {groups}", "p5_found": f"with {_P5} select post_id_a, post_id_b from p", "p5_pairs": f"with {_P5} select * from p"}
