"""The stages as one run over a folder of tables: each result is a Parquet table of the output folder."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.plans import accounts, interactions

FRONT = {"posts": interactions.posts, "comments": interactions.interactions, "edges": interactions.edges, "trigger_response": interactions.trigger, "co_target": interactions.co_target, "co_negative": interactions.co_negative}
BACK = {"signals": accounts.account_signals, "seeds": accounts.seeds, "expansion": accounts.tiered_expansion, "pair_timing": accounts.expansion_timing}

SWEEP = (0.1, 0.2, 0.3)


def row_ranges(start: int, end: int, workers: int) -> list[tuple[int, int]]:
    """Balanced half-open ranges; the remainder goes to the first ones, empty ranges are left out."""
    size, extra = divmod(max(0, end - start), max(1, workers))
    out, at = [], start
    for i in range(max(1, workers)):
        n = size + (i < extra)
        if n:
            out.append((at, at + n))
        at += n
    return out


def run(spark: SparkSession, folder: str, out: str, stages: dict | None = None) -> dict[str, int]:
    """Writes the stages (all by default) and a JSON summary of their row counts; returns the counts."""
    counts = {}
    for name, stage in (stages or FRONT | BACK).items():
        path = f"{out}/{name}.parquet"
        stage(spark, folder).write.mode("overwrite").parquet(path)
        counts[name] = spark.read.parquet(path).count()
    spark.createDataFrame([(json.dumps(counts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary")
    return counts


def run_parallel(steps: dict, workers: int = 4) -> dict:
    """Runs independent steps (name -> function without arguments) side by side, as jobs of one session.
    All of them run to their end; then the failed ones are named in one error."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        waiting = {name: pool.submit(step) for name, step in steps.items()}
    failed = {name: f.exception() for name, f in waiting.items() if f.exception()}
    if failed:
        raise RuntimeError("failed: " + ", ".join(f"{n} ({type(e).__name__}: {e})" for n, e in failed.items())) from next(iter(failed.values()))
    return {name: f.result() for name, f in waiting.items()}


def work_sizes(spark: SparkSession, folder: str):
    """(task, rows): posts to score, and comments that answer one of them directly."""
    from weftline.sources.tables import table

    p = interactions.posts(spark, folder)
    c = table(spark, folder, "analyzed_comments").where((F.col("parent_type") == "post") & F.col("comment_id").isNotNull()).join(p.select("post_id"), "post_id", "left_semi").select("comment_id").distinct()
    one = p.agg(F.lit("posts").alias("task"), F.count("*").alias("rows"))
    return one.unionByName(c.agg(F.lit("comments").alias("task"), F.count("*").alias("rows")))


def scoring_steps(df, order: list[str], score, path: str, start: int, end: int, workers: int) -> dict:
    """Steps for run_parallel: rows ``start`` to ``end`` in balanced ranges, each scored by ``score`` (DataFrame to
    DataFrame, any provider) and written to its own folder under ``path``."""
    from weftline.sources.tables import row_range

    def step(a: int, b: int):
        return lambda: score(row_range(df, order, a, b)).write.mode("overwrite").parquet(f"{path}/rows={a}-{b}")

    return {f"[{a}, {b})": step(a, b) for a, b in row_ranges(start, end, workers)}


def full_back(spark: SparkSession, folder: str, out: str) -> dict[str, int]:
    """The back half with discovery, group timing, ranking and baselines."""
    from weftline.plans import discovery

    more = {"group_discovery": discovery.group_discovery, "group_sync": discovery.group_sync, "final_groups": discovery.final_groups, "baselines": discovery.temporal_baselines}
    return run(spark, folder, out, BACK | more)


def threshold_sweep(spark: SparkSession, folder: str, thresholds: tuple[float, ...] = SWEEP):
    """Expansion at several layer thresholds, as one table."""
    from dataclasses import replace

    from weftline.operators import expansion
    from weftline.plans.lineage import cut

    e = cut(interactions.edges(spark, folder))
    seeds, layers = cut(accounts.expansion_seeds(spark, folder)), accounts._layers(e, spark, folder, min(thresholds))
    out = None
    for t in thresholds:
        # an account's best from t on are the first of its best, so the pairs of the lowest threshold hold those of all
        got = expansion.expand(seeds, layers | {"co_negative": layers["co_negative"].where(F.col("w") >= t)}, replace(accounts.TIERS, co_negative=t))
        got = got.groupBy("tier").agg(F.count("*").alias("members"), F.countDistinct("candidate").alias("accounts")).withColumn("threshold", F.lit(t))
        out = got if out is None else out.unionByName(got)
    return out


__all__ = ["FRONT", "BACK", "row_ranges", "run", "threshold_sweep"]
