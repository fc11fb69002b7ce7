"""Consolidating pairwise matches into groups (connected components of the link graph).

The giant component is peeled first: from the vertex of the highest degree a breadth-first search
runs as frontier joins, one level a round. What a level reached is anti-joined away at once, so the
hub's many links are never joined again. While the frontier moves, the rest of the graph takes one
round of minimum propagation with each level (every vertex takes the smallest vertex next to it,
pointers are shortened, the graph is contracted), so a long tail shrinks ahead of the frontier and no
diameter bounds the number of rounds: it is logarithmic in the worst case. When the frontier is
empty, its whole component has been peeled. If that held at least ``giant`` of all vertices, the next
component is peeled in the same way from the hub of what remains; the small components that are left
finish by minimum propagation. Nothing but single numbers comes to the driver; each round is
checkpointed. No size, level or tail ends a search early.

Defined cases: links with a null end are left out; a vertex linked to itself is a group of its
own unless it has other links; repeated and reversed links count once; an empty table gives no
rows. The identifier of a group is its smallest vertex in UTF-8 order. Columns other than the two
named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import contract, mirrored, moved, propagate
from weftline.plans.lineage import cut


def peel(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The component of the vertex of the highest degree: (reached labels v, the edges without it,
    the labels as moved by contraction, levels)."""
    hub = edges.groupBy("a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").limit(1).select(F.col("a").alias("v"))
    reached = frontier = cut(hub)
    level = 0
    while True:
        level += 1
        step = edges.join(frontier, edges.a == frontier.v).select(F.col("b").alias("v")).distinct()
        step = cut(step.join(frontier, "v", "left_anti"))
        gone = frontier.select(F.col("v").alias("a"))
        edges = cut(edges.join(gone, "a", "left_anti").join(gone.toDF("b"), "b", "left_anti").select("a", "b"))
        if step.isEmpty():
            return reached, edges, labels, level
        to, edges = contract(edges)
        labels = cut(moved(labels, to))
        frontier = cut(moved(step.select("v", F.lit(1).alias("one")), to.withColumnRenamed("v", "x").select(F.col("x").alias("v"), "m"), "v").select("v").distinct())
        reached = reached.unionByName(frontier) if level % 4 else cut(reached.unionByName(frontier))


def peeled_groups(links: DataFrame, a: str, b: str, giant: float = 0.05) -> DataFrame:
    """(vertex, group_id, peel): ``peel`` is the number of the peeled component from 1, 0 for the rest."""
    both = cut(mirrored(links, a, b))
    labels = both.select(F.col("a").alias("vertex"), F.col("a").alias("group_id")).distinct()
    vertices = labels.count()
    edges, parts, number = both, None, 0
    while not edges.isEmpty():
        number += 1
        reached, edges, labels, _ = peel(edges, labels)
        part = cut(labels.join(reached.select(F.col("v").alias("group_id")), "group_id", "left_semi").select("vertex", F.lit(number).alias("peel")))
        parts = part if parts is None else parts.unionByName(part)
        if part.count() < giant * vertices:
            break
    labels = propagate(edges, labels)
    if parts is None:
        return labels.withColumn("peel", F.lit(0))
    least = parts.groupBy("peel").agg(F.min("vertex").alias("least"))
    # one row per peeled component, at most 1 / giant + 1
    named = parts.join(F.broadcast(least), "peel")
    return labels.join(named, "vertex", "left").select("vertex", F.coalesce("least", "group_id").alias("group_id"), F.coalesce("peel", F.lit(0)).alias("peel"))


def connected_groups(links: DataFrame, a: str, b: str, giant: float = 0.05) -> DataFrame:
    """Columns ``vertex`` and ``group_id`` for every vertex of the links."""
    done = peeled_groups(links, a, b, giant).select("vertex", "group_id")
    loops = links.where(F.col(a) == F.col(b)).select(F.col(a).alias("vertex"), F.col(a).alias("group_id")).distinct()
    return done.unionByName(loops.join(done.select("vertex"), "vertex", "left_anti"))
