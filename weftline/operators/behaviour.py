"""Account behaviour: stance features, post activity, outer merge, anomaly score, k-means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import exact_mean, ratio_or_zero
from weftline.operators.cleaning import LABELS
from weftline.operators.ranking import quantiles


def stance_features(comments: DataFrame) -> DataFrame:
    """Score statistics (population deviation), breadth and label ratios of each source account."""
    return comments.groupBy(F.col("source").alias("user_id")).agg(
        F.count("*").alias("comments"), exact_mean("score", 6).alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"),
        exact_mean("weight", 9).alias("mean_weight"), F.avg("chars").alias("mean_chars"), F.countDistinct("target").alias("targets"), F.countDistinct("post_id").alias("posts"),
        *[(F.count_if(F.col("label") == x) / F.count("*")).alias(f"ratio_{x}") for x in LABELS],
    )


def span_days(first: Column, last: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((last - first) / 86400) + 1)


def activity(events: DataFrame, entity: str, ts: str) -> DataFrame:
    """Volume, span, rate, interval and clock features of an event table that is one row per event.

    Gaps are taken inside each (account, clock hour) and between its hours, so that no task sorts
    all events of a busy account: what is sorted per account is one row per active hour."""
    e = events.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).select(F.col(entity).alias("user_id"), F.col(ts).alias("ts"), F.floor(F.col(ts) / 3600).alias("hour"))
    e = e.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id", "hour").orderBy("ts")))
    hours = e.groupBy("user_id", "hour").agg(F.count("*").alias("k"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.sum("gap").alias("g"), F.sum(F.col("gap") * F.col("gap")).alias("g2"), F.count("gap").alias("gn"), F.min("gap").alias("gmin"))
    hours = hours.withColumn("link", F.col("t0") - F.lag("t1").over(Window.partitionBy("user_id").orderBy("hour")))
    link = F.coalesce("link", F.lit(0.0))
    hours = hours.withColumns({"g": F.coalesce("g", F.lit(0.0)) + link, "g2": F.coalesce("g2", F.lit(0.0)) + link * link, "gn": F.col("gn") + F.col("link").isNotNull().cast("int"), "gmin": F.least("gmin", "link")})
    day = F.pmod(F.floor(F.col("hour") / 24) + 3, F.lit(7))
    a = hours.groupBy("user_id").agg(
        F.sum("k").alias("events"), F.min("t0").alias("first"), F.max("t1").alias("last"), F.sum("g").alias("g"), F.sum("g2").alias("g2"), F.sum("gn").alias("gn"), F.min("gmin").alias("min_interval"),
        F.max("k").alias("max_per_hour"), F.avg("k").alias("mean_per_hour"), F.sum(F.when(F.pmod("hour", F.lit(24)) < 6, F.col("k")).otherwise(0)).alias("night"), F.sum(F.when(day >= 5, F.col("k")).otherwise(0)).alias("weekend"),
    )
    mean = F.try_divide("g", "gn")
    days = span_days(F.col("first"), F.col("last"))
    return a.select(
        "user_id", "events", "first", "last", days.cast("long").alias("active_days"), (F.col("events") / days).alias("per_day"), mean.alias("mean_interval"),
        F.when(F.col("gn") > 0, F.sqrt(F.greatest(F.lit(0.0), F.try_divide("g2", "gn") - mean * mean))).alias("std_interval"), "min_interval", "max_per_hour",
        (F.col("max_per_hour") / (F.col("mean_per_hour") + F.lit(1e-6))).alias("burst_ratio"), (F.col("night") / F.col("events")).alias("night_ratio"), (F.col("weekend") / F.col("events")).alias("weekend_ratio"),
    )


def merge_activity(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Full outer merge of comment and post activity; counts and rates absent on one side are 0."""
    c = comments.select("user_id", F.col("events").alias("comment_count"), F.col("active_days").alias("comment_days"), F.col("per_day").alias("comments_per_day"), "burst_ratio", "night_ratio")
    p = posts.select("user_id", F.col("events").alias("post_count"), F.col("active_days").alias("post_days"), F.col("per_day").alias("posts_per_day"))
    j = c.join(p, "user_id", "full").na.fill(0)
    return j.withColumns({"total": F.col("comment_count") + F.col("post_count"), "active_days": F.greatest("comment_days", "post_days"), "comment_post_ratio": F.col("comment_count") / (F.col("post_count") + F.lit(1e-6))})


def anomaly(features: DataFrame, columns: list[str], contamination: float = 0.05) -> DataFrame:
    """Distance from the mean in population standard deviations (missing values count as 0):
    anomaly_score = cutoff - distance, label -1 at or beyond the cutoff, extreme in the lowest
    1 % of scores. Statistics are three one-row aggregates over all accounts."""
    f = features.withColumns({c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)) for c in columns})
    stats = f.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    square = sum((F.pow((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"s_{c}")), F.lit(2.0)) for c in columns), F.lit(0.0))
    d = f.crossJoin(F.broadcast(stats)).select("user_id", F.sqrt(square).alias("distance"))
    cut = quantiles(d, [], "distance", {"cutoff": 1 - contamination, "far": 0.99})
    s = d.crossJoin(F.broadcast(cut))
    return s.select("user_id", "distance", F.when(F.col("distance") >= F.col("cutoff"), -1).otherwise(1).alias("anomaly_label"), (F.col("cutoff") - F.col("distance")).alias("anomaly_score"), (F.col("distance") >= F.col("far")).alias("is_extreme_outlier"))


def kmeans(features: DataFrame, columns: list[str], k: int = 8, iterations: int = 40, seed: int = 42, plain: list[str] | None = None) -> DataFrame:
    """(user_id, cluster): Lloyd's k-means on standardised columns, and on ``plain`` ones as they are. Labels depend on the seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    f = features.na.fill(0.0, [*columns, *(plain or [])])
    v = VectorAssembler(inputCols=columns, outputCol="raw").transform(f)
    v = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(v).transform(v)
    v = VectorAssembler(inputCols=["scaled", *(plain or [])], outputCol="all").transform(v)
    model = KMeans(k=k, initMode="random", maxIter=iterations, seed=seed, featuresCol="all", predictionCol="cluster").fit(v)
    return model.transform(v).select("user_id", "cluster")


def coverage(a: DataFrame, flag: Column) -> DataFrame:
    """Share and number of rows where a condition holds."""
    return a.agg(F.count("*").alias("rows"), F.count_if(flag).alias("hits"), ratio_or_zero(F.count_if(flag), F.count("*")).alias("share"))
