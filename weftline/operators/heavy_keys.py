"""Results per key when a few keys hold most of the rows.

Value-frequency compression: rows are first counted by (key, attribute, value), which map-side
combining turns into at most one row per distinct value and task, whatever the number of rows of
a key. Distinct counts, modes and exact percentiles of a key then follow from its weighted
values. No key's rows ever meet in one task: the first shuffle spreads a heavy key over its
values, the second moves one weighted row per distinct value, and sums combine before it.

Nulls: a null key makes no result; a null value is a weighted row of its own, which counts for the
number of rows but not for distinct counts, modes and percentiles. Ties of the mode go to the
smallest value. An empty table gives an empty result. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import cumulative


def compress(df: DataFrame, keys: list[str], attributes: dict[str, Column]) -> DataFrame:
    """One row for each (keys, attribute, value) with its number of rows ``n``, null values included.
    Values are strings; numbers are cast when used."""
    items = [F.struct(F.lit(a).alias("attribute"), c.cast("string").alias("value")) for a, c in attributes.items()]
    long = df.select(*keys, F.inline(F.array(*items)))
    for k in keys:
        long = long.where(F.col(k).isNotNull())
    return long.groupBy(*keys, "attribute", "value").agg(F.count("*").alias("n"))


def profiles(weighted: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """One row per key: ``rows``, and for each attribute ``<a>_distinct``, ``<a>_mode`` and
    ``<a>_mode_rows``, all exact and all from the weighted values."""
    there = F.col("value").isNotNull()
    per = weighted.groupBy(*keys, "attribute").agg(
        F.sum("n").alias("total"), F.count("value").alias("kinds"), F.min(F.when(there, F.struct((-F.col("n")).alias("m"), F.col("value").alias("value")))).alias("top")
    )
    out = [F.max(F.when(F.col("attribute") == attributes[0], F.col("total"))).alias("rows")]
    for a in attributes:
        here = F.col("attribute") == a
        out += [
            F.coalesce(F.max(F.when(here, F.col("kinds"))), F.lit(0)).cast("long").alias(f"{a}_distinct"),
            F.max(F.when(here, F.col("top.value"))).alias(f"{a}_mode"),
            F.coalesce(F.max(F.when(here, -F.col("top.m"))), F.lit(0)).cast("long").alias(f"{a}_mode_rows"),
        ]
    return per.groupBy(*keys).agg(*out)


def percentiles(weighted: DataFrame, keys: list[str], attribute: str, shares: dict[str, float]) -> DataFrame:
    """Exact lower percentiles of a numeric attribute: the smallest value that has at least the
    share of the key's non-null rows at or below it. Weighted values are ranked in ranges of
    (key, value), so even a key with as many values as rows is spread over tasks."""
    values = weighted.where((F.col("attribute") == attribute) & F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("v"), "n")
    ranked = cumulative(values.groupBy(*keys, "v").agg(F.sum("n").alias("n")), keys, "v")
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("all")), F.col("v"))).alias(c) for c, p in shares.items()])


def heavy(weighted: DataFrame, side: list[str], key: str, share: float, attribute: str) -> DataFrame:
    """Keys that hold at least ``share`` of the rows of their side (bounded: at most 1/share per side).
    A key's rows are the weights of its values of one attribute, the null value among them."""
    rows = weighted.where(F.col("attribute") == attribute).groupBy(*side, key).agg(F.sum("n").alias("rows"))
    total = rows.groupBy(*side).agg(F.sum("rows").alias("all_rows"))
    # total has one row per side, a fixed number given by the caller's query
    return rows.join(F.broadcast(total), side).where(F.col("rows") >= F.lit(share) * F.col("all_rows"))
