"""Mixing sources to target shares of the total size.

Sizes are summed per source. With targets renormalised over the sources that have any size, the
largest total that all sources can give without using a document more than its ``max_repeats``
times is M = min(max_repeats * size / share); a source's rate is then share * M / size. Each
document is emitted floor(rate) times plus one copy if a hash of its id and the seed, taken as a
number in [0, 1), is below the fraction of the rate. Which copies come out depends on nothing but
the document and the seed, so lost tasks are redone alike.

Defined cases: sources without a target, with a null or non-positive share or with
``max_repeats`` below 1 are not used; sources without documents (or with size 0) are reported with
share 0 and rate 0; documents with a null source or size 0 are not used; repeated targets of a source
are an error of the caller (the highest share is taken). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SOURCES = 100_000  # targets are broadcast only up to this many rows


def rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, size, rate) of the used sources. ``sizes`` has
    (source, size), one row per document."""
    per = sizes.where(F.col("source").isNotNull() & (F.col("size") > 0)).groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("size"))
    t = targets.where((F.col("target_share") > 0) & ~F.isnan("target_share") & (F.col("max_repeats") >= 1) & F.col("source").isNotNull())
    t = t.groupBy("source").agg(F.max("target_share").cast("double").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = t.join(per, "source", "left").withColumns({"docs": F.coalesce("docs", F.lit(0)), "size": F.coalesce("size", F.lit(0))})
    there = F.col("size") > 0
    # one row over the sources, not over the documents
    total = j.agg(F.sum(F.when(there, F.col("target_share"))).alias("_given"), F.min(F.when(there, F.col("max_repeats") * F.col("size") / F.col("target_share"))).alias("_most"))
    j = j.crossJoin(F.broadcast(total))
    rate = F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.col("_most") / F.col("size"))
    return j.withColumns({"rate": F.when(there, rate).otherwise(F.lit(0.0)), "goal_share": F.when(there, F.col("target_share") / F.col("_given")).otherwise(F.lit(0.0))}).drop("_given", "_most")


def uniform(key: str, seed: int):
    """A number in [0, 1) from the id and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix_copies(docs: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Copies (doc_id, source, size, copies) of the documents used, and the rates. ``docs`` has
    (doc_id, source, size)."""
    r = rates(docs.select("source", "size"), targets)
    small = r.select("source", "rate")
    if targets.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES:
        small = F.broadcast(small)
    j = docs.where(F.col("size") > 0).join(small, "source")
    copies = (F.floor("rate") + F.when(uniform("doc_id", seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return j.withColumn("copies", copies).where(F.col("copies") > 0).select("doc_id", "source", "size", "copies"), r


def shares(copies: DataFrame, rate: DataFrame) -> DataFrame:
    """What was reached, by source."""
    got = copies.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("mixed_size"), F.sum("copies").alias("mixed_docs"), F.max("copies").alias("most_repeats"))
    j = rate.join(got, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mixed_size", "mixed_docs", "most_repeats")})
    total = j.agg(F.sum("mixed_size").alias("_all"))
    # total is one row
    return j.crossJoin(F.broadcast(total)).withColumn("reached_share", F.coalesce(F.col("mixed_size") / F.nullif(F.col("_all"), F.lit(0)), F.lit(0.0))).drop("_all")
