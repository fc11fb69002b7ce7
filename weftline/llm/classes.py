"""Records in classes of equal content: pairs of classes to pairs of records, without a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import shuffle_partitions


def member_pairs(pairs: DataFrame, members: DataFrame, block: int = 256) -> DataFrame:
    """Every (x, y) of records whose classes are paired, with the other columns of the pair.

    ``pairs`` has (a, b, ...), each unordered pair of classes once, a = b for the records within a
    class; ``members`` has distinct (id, cls). Classes are cut into blocks of about ``block``
    records; each pair of blocks is joined in its own place, so no task or key grows with a class.
    """
    n = shuffle_partitions(pairs.sparkSession)
    other = [c for c in pairs.columns if c not in ("a", "b")]
    size = members.groupBy("cls").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = members.join(size, "cls").select("cls", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("at"), "id")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    p = pairs.join(size.toDF("a", "_ka"), "a").join(size.toDF("b", "_kb"), "b")
    p = p.withColumn("i", F.explode(upto("_ka"))).withColumn("j", F.explode(upto("_kb"))).where((F.col("a") != F.col("b")) | (F.col("i") <= F.col("j"))).drop("_ka", "_kb")
    left = p.join(placed.toDF("a", "i", "x"), ["a", "i"]).repartition(n, "a", "b", "i", "j")
    right = p.select("a", "b", "i", "j").join(placed.toDF("b", "j", "y"), ["b", "j"]).repartition(n, "a", "b", "i", "j")
    both = left.join(right, ["a", "b", "i", "j"])
    return both.where((F.col("a") != F.col("b")) | (F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).select("x", "y", "a", "b", *other)
