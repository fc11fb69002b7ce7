"""Top N items within every group by secondary sort.

Rows are sorted inside their partitions by (group, score descending, item) and streamed as Arrow
batches; of each run at most N items pass, and only the N items passed so far of the open run are
remembered, whatever the group's size. The pass runs twice: first on the partitions as they come
(salted by whatever key they were partitioned on, so a group with a third of all rows is spread
over all tasks and shrinks to N rows a task before anything of it is shuffled), then on the rows
hash-partitioned by group.

Defined cases: rows with a null group, item or score (or NaN score) are left out; an item that
comes several times in a group counts once, with its highest score; equal scores go by item in
UTF-8 order; groups with fewer than N items give all of them; an empty table gives no rows. Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrow import starts
from weftline.plans.lineage import shuffle_partitions


def _first(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_group, last_item, seen = None, None, set()
        for b in batches:
            if not b.num_rows:
                continue
            group, item = b.column("grp"), b.column("item")
            opens = starts(group, last_group)
            fresh = opens | starts(item, last_item)
            last_group, last_item = group[b.num_rows - 1].as_py(), item[b.num_rows - 1].as_py()
            at = np.flatnonzero(opens)
            cuts = [0, *at[at > 0].tolist(), b.num_rows]
            keep: list[int] = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if opens[lo]:
                    seen = set()
                i = lo
                while len(seen) < n and i < hi:
                    if fresh[i] and (x := item[i].as_py()) not in seen:
                        seen.add(x)
                        keep.append(i)
                    i += 1
            if keep:
                yield b.take(pa.array(keep))

    return run


def top_items(rows: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """Columns ``group``, ``item``, ``score``: the first ``n`` distinct items of each group by
    score descending, then item ascending."""
    s = F.col(score).cast("double")
    flat = rows.select(F.col(group).cast("string").alias("grp"), F.col(item).cast("string").alias("item"), s.alias("score"))
    flat = flat.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    order = [F.col("grp"), F.col("score").desc(), F.col("item")]
    schema = "grp string, item string, score double"
    local = flat.sortWithinPartitions(*order).mapInArrow(_first(n), schema)
    best = local.repartition(shuffle_partitions(rows.sparkSession), "grp").sortWithinPartitions(*order).mapInArrow(_first(n), schema)
    return best.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score))
