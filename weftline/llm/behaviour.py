"""Queries on account features: p3 (clusters of alike behaviour)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.accounts import finite, name, sql_finite, sql_name
from weftline.llm.clusters import Density, all_alike, density_clusters
from weftline.llm.top_items import top_items
from weftline.plans.lineage import cut
from weftline.sources.tables import table

ALIKE = Density(epsilon=1.5)
LOGGED = ("comments_per_day", "posts_per_day", "mean_comment_interval_seconds", "burst_ratio")
EXEMPLARS = 5


def coordinates() -> list[Column]:
    log = lambda c: F.log1p(finite(c))
    return [*[log(c) for c in LOGGED], 5 * finite("night_activity_ratio"), 5 * finite("weekend_activity_ratio"), log("comment_post_ratio")]


def _members(spark: SparkSession, folder: str) -> DataFrame:
    """(id, pid, x, cluster, persistence)"""
    f = table(spark, folder, "account_features")
    got, tree = density_clusters(f, F.when(F.length(name("user_id")) > 0, name("user_id")), coordinates(), ALIKE)
    return cut(all_alike(got, tree, 7, ALIKE.epsilon, ALIKE.min_size))


def _named(m: DataFrame) -> DataFrame:
    least = m.groupBy("cluster").agg(F.min("id").alias("cluster_id"))
    return m.join(least, "cluster").drop("cluster")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _named(_members(spark, folder)).select(F.col("id").alias("user_id"), "cluster_id")


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster: size, most persistent members, main cluster_kmeans and its share, anomaly scores."""
    m = _named(_members(spark, folder))
    f = table(spark, folder, "account_features").select(name("user_id").alias("id"), "cluster_kmeans", finite("anomaly_score").alias("anomaly_score"))
    f = f.groupBy("id").agg(F.min("cluster_kmeans").alias("cluster_kmeans"), F.min("anomaly_score").alias("anomaly_score"))
    j = m.select("id", "cluster_id", "persistence").join(f, "id")
    base = j.groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg("persistence").alias("mean_persistence"), F.avg("anomaly_score").alias("mean_anomaly_score"), F.min("anomaly_score").alias("min_anomaly_score"))
    kinds = j.where(F.col("cluster_kmeans").isNotNull()).groupBy("cluster_id", "cluster_kmeans").agg(F.count("*").alias("n"))
    main = kinds.groupBy("cluster_id").agg(F.max(F.struct("n", (-F.col("cluster_kmeans")).alias("k"))).alias("m"), F.sum("n").alias("known"))
    typical = top_items(m, "cluster_id", "id", "persistence", EXEMPLARS).groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("exemplars"))
    return base.join(main, "cluster_id", "left").join(typical, "cluster_id").select(
        "cluster_id", "size", "exemplars", "mean_persistence", (-F.col("m.k")).alias("main_kmeans"), (F.col("m.n") / F.col("known")).alias("main_kmeans_share"), "mean_anomaly_score", "min_anomaly_score"
    )


QUERIES = {"p3_found": p3_found, "p3_clusters": p3_clusters}


def _coordinates_sql() -> list[str]:
    log = lambda c: f"ln(1 + {sql_finite(c)})"
    return [*[log(c) for c in LOGGED], f"5 * {sql_finite('night_activity_ratio')}", f"5 * {sql_finite('weekend_activity_ratio')}", log("comment_post_ratio")]


def oracle_sql() -> dict[str, str]:
    """All pairs by brute force: as clusters are sets of accounts all alike and no account is in two,
    an account's cluster is what lies within epsilon of it."""
    xs = _coordinates_sql()
    square = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(len(xs)))
    there = " and ".join(f"x{i} is not null" for i in range(len(xs)))
    return {
        "p3_found": f"""with f as (select distinct {sql_name("user_id")} as user_id, {", ".join(f"{x} as x{i}" for i, x in enumerate(xs))} from account_features where length({sql_name("user_id")}) > 0), p as (select * from f where {there})
            select a.user_id, min(b.user_id) as cluster_id from p a join p b on {square} <= {ALIKE.epsilon**2} group by 1 having count(*) >= {ALIKE.min_size}""",
    }
