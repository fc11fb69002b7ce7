"""Account graph: directed edge statistics, derived layers, projections, node index, groups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import exact_mean, ratio_or_zero
from weftline.operators import similar
from weftline.operators.cleaning import LABELS
from weftline.operators.components import components
from weftline.operators.ranking import global_index, quantiles, top_per_group
from weftline.plans.lineage import cut, shuffle_partitions


def edge_stats(comments: DataFrame) -> DataFrame:
    """One row per (source, target): volume, score statistics, label counts and ratios, weights.

    All of it is one aggregation with map-side combining; the fixed label domain needs no pivot.
    """
    n = F.count("*")
    s = comments.groupBy("source", "target").agg(
        n.alias("n"), exact_mean("score", 6).alias("mean_score"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), exact_mean("weight", 9).alias("mean_weight"),
        *[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in LABELS],
    )
    signed = F.col("mean_weight") * F.log1p("n")
    return s.withColumns({f"ratio_{x}": F.col(f"n_{x}") / F.col("n") for x in LABELS}).withColumns({
        "w_count": F.col("n").cast("double"), "w_log": F.log1p("n"), "w_signed": signed, "w_positive": F.greatest(signed, F.lit(0.0)), "w_negative": F.greatest(-signed, F.lit(0.0)), "w_opposed": F.log1p("n_oppositional"),
    })


def degree_adjusted(edges: DataFrame, share: float = 0.99) -> DataFrame:
    """Edge volume damped for busy ends: n / (1 + exp(out / p99_out + in / p99_in - 2))."""
    out = edges.groupBy("source").agg(F.sum("n").alias("out"))
    into = edges.groupBy("target").agg(F.sum("n").alias("in"))
    high = quantiles(out, [], "out", {"p_out": share}).crossJoin(quantiles(into, [], "in", {"p_in": share}))
    x = F.coalesce(F.try_divide("out", "p_out") + F.try_divide("in", "p_in") - 2, F.lit(50.0))
    j = edges.select("source", "target", "n").join(out, "source").join(into, "target").crossJoin(F.broadcast(high))  # one row
    return j.select("source", "target", (F.col("n") / (1 + F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))))).alias("w_adjusted"))


def trigger_response(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """How regularly account b (target) answers the posts of account a (source): coverage of a's
    posts, volume and delays of b's first comments."""
    c = comments.where((F.col("post_id") != "") & F.col("ts").isNotNull()).select("source", "target", "post_id", "ts")
    totals = posts.groupBy("author").agg(F.count("*").alias("posts"))
    per = c.groupBy("target", "source", "post_id").agg(F.min("ts").alias("first"), F.count("*").alias("n"))
    per = per.join(posts.select("post_id", F.col("ts").alias("posted")), "post_id", "left")
    delay = (F.col("first") - F.col("posted")) / 60.0
    per = per.withColumn("delay", F.when(delay >= 0, delay))
    e = per.groupBy("target", "source").agg(F.count("*").alias("posts_hit"), F.sum("n").alias("comments"), F.percentile("delay", F.array(F.lit(0.5), F.lit(0.9))).alias("q"))
    e = e.join(totals, F.col("target") == F.col("author"))
    cover = ratio_or_zero(F.col("posts_hit"), F.col("posts"))
    return e.select(
        F.col("target").alias("a"), F.col("source").alias("b"), F.col("posts").alias("a_posts"), "posts_hit", "comments", cover.alias("coverage"), (F.col("comments") / F.col("posts_hit")).alias("comments_per_post"),
        F.col("q")[0].alias("median_delay"), F.col("q")[1].alias("p90_delay"), (cover * F.log1p("posts_hit") * F.log1p("comments")).alias("w_trigger"),
    )


@dataclass(frozen=True)
class Projection:
    threshold: float
    top_k: int = 25
    min_shared: int = 2
    max_sources: int = 200


def co_targets(edges: DataFrame, weight: str, cfg: Projection) -> DataFrame:
    """Accounts that point at the same targets, by cosine of their weighted target profiles.

    Each target first keeps its ``max_sources`` strongest sources, so a target of any popularity
    adds at most max_sources^2 / 2 pairs; norms are taken after that cap. With ``max_sources`` 0 all
    sources of every target count (whole_co_targets). A pair stays if it is among the ``top_k`` of
    either end. Columns (a, b, shared, similarity), a < b.
    """
    p = edges.where(F.col(weight) > 0).select("source", "target", F.col(weight).alias("w"))
    if cfg.max_sources <= 0:
        return whole_co_targets(p, cfg)
    p = top_per_group(p, ["target"], [F.desc("w"), F.asc("source")], cfg.max_sources)
    norm = p.groupBy("source").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    x, y = p.toDF("a", "target", "wa"), p.toDF("b", "target", "wb")
    pairs = x.join(y, "target").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    pairs = pairs.where(F.col("shared") >= cfg.min_shared).join(norm.toDF("a", "na"), "a").join(norm.toDF("b", "nb"), "b")
    cos = F.round(F.least(F.lit(1.0), F.col("dot") / (F.col("na") * F.col("nb"))), 9)
    pairs = pairs.select("a", "b", "shared", cos.alias("similarity")).where(F.col("similarity") >= cfg.threshold)
    if cfg.top_k <= 0:
        return pairs
    ends = pairs.select(F.col("a").alias("me"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("me"), F.col("a").alias("other"), "similarity"))
    best = top_per_group(ends, ["me"], [F.desc("similarity"), F.asc("other")], cfg.top_k)
    keep = best.select(F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b")).distinct()
    return pairs.join(keep, ["a", "b"], "left_semi")


def whole_co_targets(p: DataFrame, cfg: Projection, task: int = 50_000_000, side: int = 3_000_000) -> DataFrame:
    """co_targets over all sources of every target; ``p`` has (source, target, w), w > 0.

    Blocks of sources meet the profiles of all in their own tasks (similar.shared_pairs), and each
    source's best leave a task, so what is shuffled doesn't grow with the pairs. ``task``: products
    of a block about; ``side``: entries of the profiles that a block meets at once.
    """
    of = p.groupBy("source").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count("*").alias("n")).where(F.col("n") >= cfg.min_shared).drop("n")
    names = cut(global_index(of, ["source"], "s"))  # numbers in the order of the names
    p = p.join(names.select("source", "s"), "source")
    size = cut(p.groupBy("target").agg(F.count("*").alias("k")).where(F.col("k") > 1))
    order = global_index(size.select("target", (-F.col("k")).alias("rarer"), "k"), ["rarer", "target"], "t")
    e = p.join(order.select("target", "t"), "target").select("s", F.struct(F.col("t").cast("int").alias("t"), "w").alias("x"))
    rows = e.groupBy("s").agg(F.array_sort(F.collect_list("x")).alias("x"))
    rows = cut(rows.join(names.select("s", "norm"), "s").select("s", "norm", F.col("x.t").alias("ts"), F.col("x.w").alias("ws"), F.size("x").alias("n")))
    entries = rows.agg(F.sum("n")).first()[0] or 0
    # products: for each target the pairs of those sources that have a more popular one
    lists = rows.select(F.explode(F.slice("ts", min(cfg.min_shared, 2), F.greatest("n", F.lit(1)))).alias("t")).groupBy("t").agg(F.count("*").cast("double").alias("k"))
    work = lists.agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0
    blocks = (max(shuffle_partitions(p.sparkSession), int(work // task) + 1), entries // side + 1)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        got = list(similar.shared_pairs(a, b, cfg.min_shared, cfg.threshold, cfg.top_k)) if len(a) and len(b) else []
        types = {"me": pa.int64(), "other": pa.int64(), "shared": pa.int64(), "similarity": pa.float64()}
        return pa.table({c: pa.array(np.concatenate([g[i] for g in got]) if got else [], kind) for i, (c, kind) in enumerate(types.items())})

    found = similar.blocked(rows.drop("n"), rows.drop("n"), "s", blocks, run, "me long, other long, shared long, similarity double")
    if cfg.top_k > 0 and blocks[1] > 1:
        found = top_per_group(found, ["me"], [F.desc("similarity"), F.asc("other")], cfg.top_k)
    pairs = found.groupBy(F.least("me", "other").alias("x"), F.greatest("me", "other").alias("y")).agg(F.max("shared").alias("shared"), F.max("similarity").alias("similarity"))
    pairs = pairs.join(names.select(F.col("s").alias("x"), F.col("source").alias("a")), "x").join(names.select(F.col("s").alias("y"), F.col("source").alias("b")), "y")
    return pairs.select("a", "b", "shared", "similarity")


def node_index(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(account, node_id): positions from 0 of all ends in UTF-8 order."""
    ends = edges.select(F.col(a).alias("account")).unionByName(edges.select(F.col(b).alias("account"))).distinct()
    return global_index(ends, ["account"], "node_id")


def coo(edges: DataFrame, nodes: DataFrame, weight: str, a: str = "source", b: str = "target", mirror: bool = False) -> DataFrame:
    """Sparse matrix entries (row, col, data) of a layer, without zeros; ``mirror`` adds the transpose."""
    e = edges.where(F.round(weight, 9) != 0).select(F.col(a).alias("x"), F.col(b).alias("y"), F.col(weight).alias("data"))
    m = e.join(nodes.toDF("x", "row"), "x").join(nodes.toDF("y", "col"), "y").select("row", "col", "data")
    return m.unionByName(m.select(F.col("col").alias("row"), F.col("row").alias("col"), "data")) if mirror else m


def layers(edges: DataFrame) -> DataFrame:
    """All statistical layers in long form (layer, source, target, weight), without zeros (to nine
    decimals: scores that cancel out add up to almost 0)."""
    names = {"count": "w_count", "signed": "w_signed", "positive": "w_positive", "negative": "w_negative", "opposed": "w_opposed"}
    each = F.array(*[F.struct(F.lit(k).alias("layer"), F.col(v).alias("weight")) for k, v in names.items()])
    return edges.select("source", "target", F.inline(each)).where(F.round("weight", 9) != 0).select("layer", "source", "target", "weight")


def all_layers(edges: DataFrame, trigger: DataFrame, co_target: DataFrame, co_negative: DataFrame) -> DataFrame:
    """The nine layers of the graph in long form (layer, source, target, weight), without zeros:
    count, single_signed, signed, positive, negative, degree_adjusted, trigger_response, co_target,
    co_negative_target."""
    single = {"count": "w_count", "single_signed": "w_signed", "signed": "w_signed", "positive": "w_positive", "negative": "w_negative"}
    each = F.array(*[F.struct(F.lit(k).alias("layer"), F.col(v).alias("weight")) for k, v in single.items()])
    out = edges.select("source", "target", F.inline(each))
    more = {"degree_adjusted": (degree_adjusted(edges), "source", "target", "w_adjusted"), "trigger_response": (trigger, "a", "b", "w_trigger"), "co_target": (co_target, "a", "b", "similarity"), "co_negative_target": (co_negative, "a", "b", "similarity")}
    for layer, (d, a, b, w) in more.items():
        out = out.unionByName(d.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(layer).alias("layer"), F.col(w).alias("weight")))
    return out.where(F.round("weight", 9) != 0).select("layer", "source", "target", "weight")


def strength(pairs: DataFrame, weight: str, a: str = "a", b: str = "b") -> DataFrame:
    """(account, strength): sum over both ends of undirected pairs."""
    both = pairs.select(F.col(a).alias("account"), F.col(weight).alias("w")).unionByName(pairs.select(F.col(b).alias("account"), F.col(weight).alias("w")))
    return both.groupBy("account").agg(F.sum("w").alias("strength"))


def reach(edges: DataFrame) -> DataFrame:
    """(account, out_n, in_n, targets, sources): directed volumes and breadths."""
    one = edges.select(F.col("source").alias("account"), F.col("n").alias("o"), F.lit(0).cast("long").alias("i"), F.lit(1).alias("t"), F.lit(0).alias("s"))
    two = edges.select(F.col("target").alias("account"), F.lit(0).cast("long").alias("o"), F.col("n").alias("i"), F.lit(0).alias("t"), F.lit(1).alias("s"))
    return one.unionByName(two).groupBy("account").agg(F.sum("o").alias("out_n"), F.sum("i").alias("in_n"), F.sum("t").alias("targets"), F.sum("s").alias("sources"))


def group_members(pairs: DataFrame, min_size: int, max_size: int) -> tuple[DataFrame, DataFrame]:
    """(account, group_id, size) of components of admitted size, and (group_id, size) of larger ones."""
    member = components(pairs, "a", "b").toDF("account", "group_id")
    size = member.groupBy("group_id").agg(F.count("*").alias("size"))
    return member.join(size.where(F.col("size").between(min_size, max_size)), "group_id"), size.where(F.col("size") > max_size)


def group_summary(pairs: DataFrame, members: DataFrame, weight: str) -> DataFrame:
    """Size, inner edges, weight and density of each group."""
    ends = members.select(F.col("account").alias("a"), "group_id", "size")
    inner = pairs.join(ends, "a").groupBy("group_id", "size").agg(F.count("*").alias("edges"), F.sum(weight).alias("weight_sum"), F.max(weight).alias("weight_max"))
    return inner.withColumn("density", 2 * F.col("edges") / (F.col("size") * (F.col("size") - 1)))


def shared_targets(members: DataFrame, edges: DataFrame, weight: str, min_members: int = 2, top_n: int = 10) -> DataFrame:
    """For each group the targets that several members point at: (group_id, target, members, weight_sum, place)."""
    j = edges.select(F.col("source").alias("account"), "target", F.col(weight).alias("w")).join(members.select("account", "group_id"), "account")
    g = j.groupBy("group_id", "target").agg(F.countDistinct("account").alias("members"), F.round(F.sum("w"), 9).alias("weight_sum")).where(F.col("members") >= min_members)
    return top_per_group(g, ["group_id"], [F.desc("members"), F.desc("weight_sum"), F.asc("target")], top_n, "place")
