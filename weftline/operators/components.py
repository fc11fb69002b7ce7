"""Connected components by minimum propagation and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import cut


def contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over mirrored edges (a, b): every end takes the smallest end next to it, pointers
    are shortened, and the graph shrinks to the ends pointed at. Gives (v, m): where each end went,
    and the edges that are left."""
    to = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m")))
    for _ in range(2):  # pointers to pointers
        up = to.select(F.col("v").alias("m"), F.col("m").alias("mm"))
        to = to.join(up, "m").select("v", F.col("mm").alias("m"))
    to = cut(to)
    ta, tb = to.select(F.col("v").alias("a"), F.col("m").alias("ma")), to.select(F.col("v").alias("b"), F.col("m").alias("mb"))
    return to, cut(edges.join(ta, "a").join(tb, "b").select(F.col("ma").alias("a"), F.col("mb").alias("b")).where(F.col("a") != F.col("b")).distinct())


def moved(labels: DataFrame, to: DataFrame, column: str = "group_id") -> DataFrame:
    """The labels after a round: ``column`` follows ``to`` where it went somewhere."""
    other = [c for c in labels.columns if c != column]
    return labels.join(to.select(F.col("v").alias(column), "m"), column, "left").select(*other, F.coalesce("m", column).alias(column))


def propagate(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Minimum labels over mirrored edges (a, b); ``labels`` (vertex, group_id) maps vertices to
    ends of the edges. The number of rounds is logarithmic."""
    while not edges.isEmpty():
        to, edges = contract(edges)
        labels = cut(moved(labels, to))
    return labels


def mirrored(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges (a, b) in both directions, without null ends and self-links."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, group_id): the smallest vertex of each vertex's component. Null ends and
    self-links are ignored."""
    both = cut(mirrored(edges, a, b))
    return propagate(both, both.select(F.col("a").alias("vertex"), F.col("a").alias("group_id")).distinct())
