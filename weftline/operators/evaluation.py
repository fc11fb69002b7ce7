"""Stability and coverage checks of rankings and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import quantiles, top_rows, weighted_ranks


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (rows, rho): Pearson correlation of average ranks, over rows with both values."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    rx, ry = weighted_ranks(d, "x").select("x", F.col("avg_rank").alias("rx")), weighted_ranks(d, "y").select("y", F.col("avg_rank").alias("ry"))
    return d.join(rx, "x").join(ry, "y").agg(F.count("*").alias("rows"), F.round(F.corr("rx", "ry"), 9).alias("rho"))


def top_overlap(df: DataFrame, key: str, x: str, y: str, sizes: tuple[int, ...]) -> DataFrame:
    """(n, overlap, jaccard) of the first n by two scores, ties by key."""
    most = max(sizes)
    a = top_rows(df.where(F.col(x).isNotNull()), [F.desc(x), F.asc(key)], most, "px").select(key, "px")
    b = top_rows(df.where(F.col(y).isNotNull()), [F.desc(y), F.asc(key)], most, "py").select(key, "py")
    j = a.join(b, key, "full")
    n = df.sparkSession.createDataFrame([(s,) for s in sizes], "n int")
    ina, inb = F.coalesce(F.col("px") <= F.col("n"), F.lit(False)), F.coalesce(F.col("py") <= F.col("n"), F.lit(False))
    c = j.crossJoin(F.broadcast(n)).groupBy("n").agg(F.count_if(ina & inb).alias("overlap"), F.count_if(ina | inb).alias("either"))  # n has len(sizes) rows
    return c.select("n", "overlap", (F.col("overlap") / F.col("either")).alias("jaccard"))


def sparsity(df: DataFrame, columns: list[str]) -> DataFrame:
    """(signal, rows, positive, positive_share, mean, p90, p95) per column; missing counts as 0."""
    each = F.array(*[F.struct(F.lit(c).alias("signal"), F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)).alias("v")) for c in columns])
    long = df.select(F.inline(each))
    g = long.groupBy("signal").agg(F.count("*").alias("rows"), F.count_if(F.col("v") > 0).alias("positive"), F.avg("v").alias("mean"))
    q = quantiles(long, ["signal"], "v", {"p90": 0.9, "p95": 0.95})
    return g.join(q, "signal").select("signal", "rows", "positive", (F.col("positive") / F.col("rows")).alias("positive_share"), "mean", "p90", "p95")


def sweep(pairs: DataFrame, weight: str, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, pairs, accounts, mean_weight) of an undirected layer at several thresholds, in one job."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    p = pairs.select("a", "b", F.col(weight).alias("w"), t).where(F.col("w") >= F.col("threshold"))
    one = p.groupBy("threshold").agg(F.count("*").alias("pairs"), F.avg("w").alias("mean_weight"))
    ends = p.select("threshold", F.explode(F.array("a", "b")).alias("x")).groupBy("threshold").agg(F.countDistinct("x").alias("accounts"))
    return one.join(ends, "threshold").select("threshold", "pairs", "accounts", "mean_weight")


def activity_bin(col: str, edges: tuple[int, ...] = (0, 1, 3, 5, 10, 20, 50, 100)):
    """Number of the right-closed bin (edges[i - 1], edges[i]] of a count; above all: len(edges)."""
    x = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        x = F.when(F.col(col) <= edges[i], i).otherwise(x)
    return F.when(F.col(col).isNotNull(), x)
