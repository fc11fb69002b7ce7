"""Scoring texts by an outside provider: retries, calls by batch, retrieved context, offline stand-ins.

A provider is a Python function from a text to a response. It runs inside Arrow batches on the
executors; responses come back as raw text and are parsed by column expressions. No network is
used here; tests and queries run deterministic stand-ins.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import clamp_int
from weftline.operators import similar, text_features
from weftline.operators.ranking import top_per_group, top_ranks
from weftline.plans.lineage import cut

# The stand-in's own word patterns for the stance of a comment and the tone of a post.
PRO = "\\b(agree|right|good|great|thanks|love|nice|true|helpful|yes)\\b"
CONTRA = "\\b(wrong|bad|no|not|scam|hate|stupid|false|never|lie|liar)\\b"


def retrying(call: Callable[[str], str], tries: int = 5, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``call`` with up to ``tries`` attempts; the wait after the i-th failure is min(2^i, longest)
    seconds, i from 0. The last error is raised."""

    def again(text: str) -> str:
        for i in range(tries):
            try:
                return call(text)
            except Exception:
                if i == tries - 1:
                    raise
                sleep(min(2.0**i, longest))
        raise ValueError("tries must be at least 1")

    return again


def responses(rows: DataFrame, key: str, prompt: Column, call: Callable[[str], str]) -> DataFrame:
    """(key, response): one call for each row; a null prompt gets a null response without a call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [None if p is None else call(p) for p in b.column("prompt").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(said, pa.string())], names=[key, "response"])

    return rows.select(key, prompt.alias("prompt")).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, response string")


def counts(texts: DataFrame, key: str, text: str, dim: int = 64, known: int = 100_000) -> DataFrame:
    """(key, counts): terms in md5 buckets (dim divides 256) as int32 counts, of texts that have any; the
    same buckets as text_features.hashed_terms, without a row for each term. A task remembers the
    buckets of at most ``known`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, seen = re.compile(text_features.TOKEN), {}
        for b in batches:
            said = [term.findall(x) for x in b.column("x").to_pylist()]
            for t in {t for ts in said for t in ts} - seen.keys():
                if len(seen) >= known:
                    seen = {t: seen[t] for ts in said for t in ts if t in seen}
                seen[t] = int(hashlib.md5(t.encode(), usedforsecurity=False).hexdigest()[-2:], 16) % dim
            n = np.fromiter(map(len, said), np.int64, len(said))
            bucket = np.fromiter((seen[t] for ts in said for t in ts), np.int64, int(n.sum()))
            c = np.bincount(np.repeat(np.arange(len(said)), n) * dim + bucket, minlength=len(said) * dim).astype(np.int32).reshape(-1, dim)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(some)), pa.array([c[i].tobytes() for i in some], pa.binary())], names=[key, "counts"])

    rows = texts.where(F.col(text).isNotNull()).select(key, F.lower(F.col(text)).alias("x"))
    return rows.mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, counts binary")


def context(queries: DataFrame, chunks: DataFrame, key: str, text: str, chunk_id: str, chunk: str, k: int = 3, block: int = 20_000) -> DataFrame:
    """(key, chunk_id, similarity, place): the k chunks most like each query text.

    Chunks of equal term counts differ only in name, so one row of each with its first k names is
    compared. Blocks of about ``block`` queries and chunks meet in their own tasks, and only each
    query's best leave a task (similar.top_similar).
    """
    q = cut(counts(queries, key, text).withColumnRenamed(key, "id"))
    c = top_per_group(counts(chunks, chunk_id, chunk), ["counts"], [F.asc(chunk_id)], k).groupBy("counts").agg(F.array_sort(F.collect_list(chunk_id)).alias("names"))
    c = cut(c.withColumn("id", F.monotonically_increasing_id()))
    blocks = tuple(max(1, -(-x.count() // block)) for x in (q, c))
    n = similar.top_similar(q, c, "id", "counts", k, eps=1e-8, blocks=blocks)
    n = top_ranks(n, ["query"], F.desc("similarity"), k)  # with all ties, as names decide between those
    named = n.join(c.select(F.col("id").alias("match"), F.explode("names").alias(chunk_id)), "match")
    best = top_per_group(named, ["query"], [F.desc("similarity"), F.asc(chunk_id)], k, "place")
    return best.select(F.col("query").alias(key), chunk_id, "similarity", "place")


def with_context(queries: DataFrame, found: DataFrame, chunks: DataFrame, key: str, text: str, chunk_id: str, chunk: str) -> DataFrame:
    """(key, prompt): each query text after its retrieved chunks, the most similar one first."""
    c = found.join(chunks.select(chunk_id, F.col(chunk).alias("_c")), chunk_id).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "_c"))), lambda x: x["_c"]).alias("_cs"))
    return queries.join(c, key, "left").select(key, F.concat_ws("\n\n", F.coalesce("_cs", F.array().cast("array<string>")), F.array(F.col(text))).alias("prompt"))


def tone(text: Column) -> Column:
    """Stand-in for a sentiment score, -100 to 100."""
    x = F.lower(F.coalesce(text, F.lit("")))
    pro, contra = F.regexp_count(x, F.lit(PRO)), F.regexp_count(x, F.lit(CONTRA))
    return clamp_int((100.0 * (pro - contra) / F.greatest(pro + contra, F.lit(1))).cast("string"), -100, 100, 0)


def stance(text: Column) -> Column:
    """Stand-in for the stance label of a comment."""
    x = F.lower(F.coalesce(text, F.lit("")))
    pro, contra = F.regexp_count(x, F.lit(PRO)), F.regexp_count(x, F.lit(CONTRA))
    return F.when(F.trim(x) == "", "unclear").when(pro > contra, "supportive").when(contra > pro, "oppositional").when(pro > 0, "mixed").otherwise("neutral")
