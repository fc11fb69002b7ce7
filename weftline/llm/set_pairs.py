"""All pairs of records whose value sets overlap above a threshold.

Method: T-occurrence list merging. Values are ordered from rare to frequent, and a record is sent
to the partitions of the values in its prefix: of two records that reach the threshold, the first
value they share (in that order) lies in both prefixes, so each pair is found in exactly one
partition, that of its first shared value. A partition holds whole records as inverted lists
(value -> sorted record positions). Each record probes them with the overlap T that its smallest
admissible partner needs: the longest lists are set aside, the short ones are merged through a
heap that skips ahead whenever fewer than T - L lists agree, and what the merge counted is
completed by binary search in the L long lists. Record positions are sorted by set size, so a
probe only looks at the window of admissible sizes.

Skew: values of small lists share a partition of about ``tile`` records and ``tile_values`` values; a
value in the prefix of more gets tiles of its own, each joining two blocks of at most about that
many, so no task or buffer grows with a value's frequency. Only (record, value) travels until the
tiles of a record are known; its whole set is attached then, once per tile. Equal sets are one
class and are joined once; pairs of their members are made in blocks.

Defined cases: null records or values are left out; repeated (record, value) rows count once; a
record with fewer than ``min_overlap`` values has no pairs; an empty table gives no rows. Columns
other than the two named are ignored. Values are compared by a 64-bit hash.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrow import runs
from weftline.llm.classes import member_pairs
from weftline.plans.lineage import cut, shuffle_partitions

_EPS = 1e-9


@dataclass(frozen=True)
class SetJoin:
    threshold: float = 0.6  # common / union
    min_overlap: int = 3
    tile: int = 4096  # records per partition of inverted lists
    tile_values: int = 1 << 21  # and values

    def need(self, a: int, b: int) -> int:
        """Least overlap of two sets of these sizes."""
        return max(self.min_overlap, math.ceil(self.threshold / (1 + self.threshold) * (a + b) - _EPS))

    def least_size(self, a: int) -> int:
        return max(self.min_overlap, math.ceil(self.threshold * a - _EPS))


def merge_skip(lists: list[list[int]], lo: int, hi: int, need: int) -> Iterator[tuple[int, int]]:
    """(position, overlap) for each position in [lo, hi) on at least ``need`` of the sorted lists."""
    at = []
    for p in lists:
        i = bisect_left(p, lo)
        if i < len(p) and p[i] < hi:
            at.append((p, i))
    at.sort(key=lambda x: len(x[0]))
    m = len(at)
    if m < need:
        return
    longest = len(at[-1][0])
    aside = min(need - 1, int(need / (0.05 * math.log2(longest + 1) + 1)))
    short, long = at[: m - aside], [p for p, _ in at[m - aside :]]
    need_short = need - len(long)
    heap = [(p[i], k, i) for k, (p, i) in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= need_short:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need_short:
            count = len(popped) + sum((j := bisect_left(p, top)) < len(p) and p[j] == top for p in long)
            if count >= need:
                yield top, count
            for _, k, i in popped:
                p = short[k][0]
                if i + 1 < len(p) and p[i + 1] < hi:
                    heapq.heappush(heap, (p[i + 1], k, i + 1))
        else:
            # no position before the (need_short)-th smallest list head can be on enough lists
            while heap and len(popped) < need_short - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            target = heap[0][0]
            for _, k, i in popped:
                p = short[k][0]
                j = bisect_left(p, target, i)
                if j < len(p) and p[j] < hi:
                    heapq.heappush(heap, (p[j], k, j))


def _tile_pairs(cfg: SetJoin):
    """Pairs of one tile whose first shared value is one of the tile's (``own``: those of a record's
    prefix values it was sent for). side 0: index only, 1: probe only, 2: both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["tile", "i", "j"]):
            if t.num_rows < 2:
                continue
            block = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            ids, sides = t.column("rec").to_pylist(), t.column("side").to_pylist()
            sets, own = t.column("vals").to_pylist(), t.column("own").to_pylist()
            order = sorted(range(len(ids)), key=lambda x: (len(sets[x]), ids[x]))
            ids, sides, sets, own = ([x[k] for k in order] for x in (ids, sides, sets, own))
            sizes = [len(s) for s in sets]
            index = defaultdict(list)
            for pos, s in enumerate(sets):
                if sides[pos] != 1:
                    for v in s:
                        index[v].append(pos)
            same = block[0] == block[1]
            found: list[tuple[int, int, int]] = []
            for pos, s in enumerate(sets):
                if sides[pos] == 0:
                    continue
                n = sizes[pos]
                low = cfg.least_size(n)
                lo = bisect_left(sizes, low)
                hi = pos if same else bisect_right(sizes, math.floor(n / cfg.threshold + _EPS))
                if lo >= hi:
                    continue
                lists = [p for v in s if (p := index.get(v)) is not None]
                for other, count in merge_skip(lists, lo, hi, cfg.need(n, low)):
                    if other == pos or count < cfg.need(n, sizes[other]):
                        continue
                    mine = set(s)
                    first = next(v for v in sets[other] if v in mine)  # in the order of frequency
                    if first in own[pos]:
                        found.append((ids[pos], ids[other], count) if ids[pos] < ids[other] else (ids[other], ids[pos], count))
            if found:
                a, b, c = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["a", "b", "shared"])

    return run


def value_sets(rows: DataFrame, record: Column, value: Column, min_size: int) -> DataFrame:
    """(record, vals): distinct values of each record as hashes, from rare to frequent."""
    r = rows.select(record.alias("record"), F.xxhash64(value).alias("v"), value.alias("_raw")).where(F.col("record").isNotNull() & F.col("_raw").isNotNull())
    r = r.select("record", "v").distinct()
    n = r.groupBy("v").agg(F.count("*").alias("df"))
    sets = r.join(n, "v").groupBy("record").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s"))
    return sets.where(F.size("s") >= min_size).select("record", F.col("s.v").alias("vals"))


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record, rec, size) membership and (rec, vals) of the classes of equal sets."""
    keyed = sets.withColumn("rec", F.xxhash64("vals"))
    return keyed.select("record", "rec", F.size("vals").alias("size")), keyed.groupBy("rec").agg(F.first("vals").alias("vals"))


def class_pairs(classes: DataFrame, cfg: SetJoin) -> DataFrame:
    """(a, b, shared) for different classes (rec, vals) that reach the threshold, a < b."""
    spark = classes.sparkSession
    n = F.size("vals")
    keep = n - F.greatest(F.lit(cfg.min_overlap), F.ceil(F.lit(cfg.threshold) * n - F.lit(_EPS))) + 1
    prefix = classes.select("rec", n.alias("size"), F.explode(F.slice("vals", F.lit(1), keep.cast("int"))).alias("value"))
    counts = prefix.groupBy("value").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
    # a value in one prefix only can't be the first shared value of any pair
    load = F.greatest(F.col("n") / F.lit(float(cfg.tile)), F.col("held") / F.lit(float(cfg.tile_values)))
    counts = cut(counts.where(F.col("n") > 1).select("value", load.alias("load")))
    total = counts.agg(F.sum("load")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "a long, b long, shared long")
    buckets = max(1, math.ceil(total))
    blocks = F.ceil("load").cast("int")
    entries = prefix.select("rec", "value").join(counts, "value")
    # a record with several prefix values in one bucket is sent there once
    light = entries.where(F.col("load") <= 1).groupBy(F.pmod("value", F.lit(buckets)).cast("long").alias("tile"), "rec").agg(F.collect_list("value").alias("own"))
    light = light.select("tile", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), "rec", "own")
    mine = F.pmod(F.xxhash64("rec", F.lit(7)), blocks).cast("int")
    heavy = entries.where(F.col("load") > 1).withColumns({"blocks": blocks, "mine": mine})
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "mine").alias("i"), F.greatest(k, "mine").alias("j")))
    # tiles of one heavy value are numbered below zero, those of buckets from zero
    heavy = heavy.select((-1 - F.pmod("value", F.lit(1 << 62))).alias("tile"), F.inline(tiles), "mine", "rec", F.array("value").alias("own"))
    heavy = heavy.select("tile", "i", "j", F.when(F.col("i") == F.col("j"), 2).when(F.col("mine") == F.col("i"), 1).otherwise(0).alias("side"), "rec", "own")
    sent = light.unionByName(heavy).join(classes.select("rec", "vals"), "rec")
    sent = sent.repartition(shuffle_partitions(spark), "tile", "i", "j").sortWithinPartitions("tile", "i", "j")
    return sent.select("tile", "i", "j", "side", "rec", "vals", "own").mapInArrow(_tile_pairs(cfg), "a long, b long, shared long")


def record_classes(rows: DataFrame, record: Column, value: Column, cfg: SetJoin = SetJoin()) -> DataFrame:
    """(record, class_id, copies, links): the whole result without pairs of records. ``class_id`` is
    the smallest record with the same set, ``copies`` how many have it, ``links`` to how many other
    classes it is linked."""
    members, classes = set_classes(cut(value_sets(rows, record, value, cfg.min_overlap)))
    pairs = class_pairs(classes, cfg)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rec")).groupBy("rec").agg(F.count("*").alias("links"))
    per = members.groupBy("rec").agg(F.min("record").alias("class_id"), F.count("*").alias("copies")).join(links, "rec", "left")
    return members.join(per, "rec").select("record", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def set_pairs(rows: DataFrame, record: Column, value: Column, cfg: SetJoin = SetJoin()) -> DataFrame:
    """(record_lo, record_hi, shared, size_lo, size_hi): every pair of different records that
    reaches the threshold, members of equal sets included."""
    sets = cut(value_sets(rows, record, value, cfg.min_overlap))
    members, classes = set_classes(sets)
    pairs = class_pairs(classes, cfg)
    own = members.groupBy("rec").agg(F.count("*").alias("n"), F.first("size").alias("shared")).where("n > 1")
    pairs = cut(pairs.unionByName(own.select(F.col("rec").alias("a"), F.col("rec").alias("b"), F.col("shared").cast("long"))))
    size = members.select("rec", "size").distinct()
    pairs = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    both = member_pairs(pairs, members.select(F.col("record").alias("id"), F.col("rec").alias("cls"))).withColumnsRenamed({"x": "ra", "y": "rb"})
    lo = F.col("ra") < F.col("rb")
    return both.select(
        F.least("ra", "rb").alias("record_lo"), F.greatest("ra", "rb").alias("record_hi"), "shared",
        F.when(lo, F.col("na")).otherwise(F.col("nb")).alias("size_lo"), F.when(lo, F.col("nb")).otherwise(F.col("na")).alias("size_hi"),
    )
