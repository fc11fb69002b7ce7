"""Global positions, ranks and top-N without one-task windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import cut


def global_index(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Dense positions 0, 1, ... in the order of the columns ``order`` (nulls first).

    Range partitions are sorted and numbered on their own, then shifted by the rows of the
    partitions before; only one count per partition is ranked in a single task. Rows that tie in
    ``order`` get different, arbitrary positions: give a unique order where that matters.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    first = placed.groupBy("_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    before = first.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = placed.join(F.broadcast(before.select("_part", "_first", "_before")), "_part")
    return out.withColumn(name, (F.col("_seq") - F.col("_first") + F.col("_before") + F.lit(start)).cast("long")).select(*df.columns, name)


def cumulative(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``upto`` (rows of the key at or below the value) and ``all`` (rows of the key) to frames
    with one row per (keys, value) and its number of rows ``n``.

    Rows are range-partitioned by key and value, so that the values of one key spread over as many
    tasks as they need; only totals per key and partition are summed up in one place.
    """
    placed = cut(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part").orderBy(value)
    total = placed.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    by = Window.partitionBy(*keys)
    before = total.withColumns({"_before": F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("_n").over(by)}).drop("_n")
    here = placed.withColumn("_upto", F.sum("n").over(inside))
    joined = here.join(before, [*keys, "_part"]) if keys else here.join(F.broadcast(before), "_part")  # without keys: a row per partition
    return joined.select(*keys, value, "n", (F.col("_before") + F.col("_upto")).alias("upto"), "all")


def weighted_ranks(df: DataFrame, value: str) -> DataFrame:
    """Average rank of each distinct non-null value among all rows: columns value, n, avg_rank.

    Equal values are counted before they are ranked, so what is ranked is one row per distinct value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return cumulative(counts, [], value).select(value, "n", (F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias("avg_rank"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per key with exact, linearly interpolated quantiles of the non-null values; without
    keys one row in all (no row of an empty table)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    c = cumulative(counts, keys, value)
    at = lambda q: (F.col("all") - 1) * F.lit(q)
    reach = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    ends = []
    for name, q in shares.items():
        ends += [reach(F.floor(at(q))).alias(f"_lo_{name}"), reach(F.ceil(at(q))).alias(f"_hi_{name}"), F.max(at(q) - F.floor(at(q))).alias(f"_part_{name}")]
    g = c.groupBy(*keys).agg(*ends)
    out = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in shares]
    return g.select(*keys, *out) if keys else g.where(F.col(f"_lo_{next(iter(shares))}").isNotNull()).select(*out)


def positive_percentiles(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """For each ``raw -> out``: average rank over the number of positives, for positive values; 0 for
    all others (null, NaN, zero and below). Ties share their mean rank.

    All columns are ranked in one pass over their positive values in long form; zeros never move.
    """
    each = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])
    long = df.select(key, F.inline(each)).where((F.col("_v") > 0) & ~F.isnan("_v"))
    ranks = cumulative(long.groupBy("_c", "_v").agg(F.count("*").alias("n")), ["_c"], "_v")
    ranks = ranks.select("_c", "_v", ((F.col("upto") - (F.col("n") - 1) / F.lit(2.0)) / F.col("all")).alias("_p"))
    wide = long.join(ranks, ["_c", "_v"]).groupBy(key).agg(*[F.max(F.when(F.col("_c") == c, F.col("_p"))).alias(out) for c, out in columns.items()])
    return df.join(wide, key, "left").na.fill(0.0, list(columns.values()))


def positive_percentile(df: DataFrame, column: str, out: str, key: str = "user_id") -> DataFrame:
    """positive_percentiles of one column. ``key`` is unique."""
    return positive_percentiles(df, key, {column: out})


def descending_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the rank from 1 by value descending; ties share the smallest rank, missing values get none."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    c = cumulative(df.select(v.alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").agg(F.count("*").alias("n")), [], "_v")
    return df.join(c.select("_v", (F.col("all") - F.col("upto") + 1).alias(out)), F.col(value) == F.col("_v"), "left").drop("_v")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; Spark prunes to n per group before the shuffle.
    ``order`` should end with a unique key, as ties are else broken arbitrarily."""
    kept = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= n)
    return kept.withColumnRenamed("_rn", rank) if rank else kept.drop("_rn")


def top_ranks(df: DataFrame, group: list[str], order: Column, n: int) -> DataFrame:
    """The rows of rank up to ``n`` in each group, with all ties of the last."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(*group).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def top_rows(df: DataFrame, order: list[Column], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows overall with their position from 1 (take-ordered, no full sort)."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)))
