"""One feature row per entity from an event table.

Bucket and sort: events are hash-partitioned by entity and sorted by (entity, type, time, event)
inside the partitions; a streaming pass over Arrow batches turns the runs of a type into counters,
totals and latest times and emits each entity's wide row as soon as its run ends. There is no other
shuffle. Counters are sparse (one entry per type that occurs) until rows are emitted, in blocks of
bounded size; the clock features come from counts per active hour of the open entity.
Entities with at least ``hot_share`` of all events (found by a counting pass; at most 1 / hot_share of
them, a broadcast table) take a second branch that buckets them by (entity, clock hour), so that no
task holds one of them whole; their partial rows, one per entity and task, are merged by adding.
Both branches run the same streaming pass.

Defined cases: events without entity, time or event id are left out; an event id repeated for the
same entity, type and time counts once; an event type outside ``types`` counts for the entity but for
no type column; null amounts add nothing; an empty table gives no rows. A single event has interval
0. Input columns other than those named are ignored, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrow import starts
from weftline.plans.lineage import cut, shuffle_partitions

PARTIAL = "entity string, k long, t0 double, t1 double, hours long, hour_max long, night long, weekend long, amount_n long, amount_sum double, amount_min double, amount_max double, type_n array<long>, type_sum array<double>, type_last array<double>"


@dataclass(frozen=True)
class Events:
    entity: Column
    time: Column  # epoch seconds, double
    event: Column  # id of the event
    kind: Column  # event type, one of ``types``
    amount: Column
    types: tuple[str, ...]
    night_hours: int = 6  # hours 0 to 5


_SUMS = ("k", "amount_n", "amount_sum")
_CELLS = 1 << 18  # type counters of a block of emitted rows


class _Rows:
    """Counters of some entities: arrays with an entry per entity, per (entity, type) and per (entity,
    clock hour); ``tr`` and ``hr`` are the entity's number."""

    def __init__(self, entity: np.ndarray, sums: dict[str, np.ndarray], types: dict[str, np.ndarray], hours: dict[str, np.ndarray]) -> None:
        self.entity, self.sums, self.types, self.hours = entity, sums, types, hours

    def part(self, lo: int, hi: int) -> _Rows:
        t, h = (self.types["tr"] >= lo) & (self.types["tr"] < hi), (self.hours["hr"] >= lo) & (self.hours["hr"] < hi)
        types, hours = {c: v[t] for c, v in self.types.items()}, {c: v[h] for c, v in self.hours.items()}
        return _Rows(self.entity[lo:hi], {c: v[lo:hi] for c, v in self.sums.items()}, types | {"tr": types["tr"] - lo}, hours | {"hr": hours["hr"] - lo})

    def joined(self, o: _Rows) -> _Rows:
        """One entity, whose counters come in two parts."""
        a, b = self.sums, o.sums
        sums = {c: a[c] + b[c] if c in _SUMS else np.minimum(a[c], b[c]) if c in ("t0", "amount_min") else np.maximum(a[c], b[c]) for c in a}
        both = {c: np.concatenate([self.types[c], o.types[c]]) for c in self.types}
        kinds, at = np.unique(both["kind"], return_inverse=True)
        last = np.full(len(kinds), -np.inf)
        np.maximum.at(last, at, both["last"])
        types = {"tr": np.zeros(len(kinds), np.int64), "kind": kinds, "n": np.bincount(at, both["n"], len(kinds)).astype(np.int64), "sum": np.bincount(at, both["sum"], len(kinds)), "last": last}
        hour, at = np.unique(np.concatenate([self.hours["hour"], o.hours["hour"]]), return_inverse=True)
        n = np.bincount(at, np.concatenate([self.hours["n"], o.hours["n"]]), len(hour)).astype(np.int64)
        return _Rows(self.entity, sums, types, {"hr": np.zeros(len(hour), np.int64), "hour": hour, "n": n})

    def batches(self, types: int, night: int) -> Iterator[pa.RecordBatch]:
        step = max(1, _CELLS // max(1, types))
        for lo in range(0, len(self.entity), step):
            yield self.part(lo, lo + step)._batch(types, night)

    def _batch(self, m: int, night: int) -> pa.RecordBatch:
        n, s, t, h = len(self.entity), self.sums, self.types, self.hours
        most = np.zeros(n, np.int64)
        np.maximum.at(most, h["hr"], h["n"])
        inside = lambda ok: np.bincount(h["hr"], np.where(ok, h["n"], 0), n).astype(np.int64)
        cols = [pa.array(self.entity, pa.string()), s["k"], s["t0"], s["t1"], np.bincount(h["hr"], minlength=n), most, inside(h["hour"] % 24 < night), inside((h["hour"] // 24 + 3) % 7 >= 5), s["amount_n"], s["amount_sum"], s["amount_min"], s["amount_max"]]
        cell, offsets = t["tr"] * m + t["kind"], pa.array(np.arange(n + 1, dtype=np.int32) * m)
        for c, none in (("n", 0), ("sum", 0.0), ("last", -np.inf)):
            wide = np.full(n * m, none)
            wide[cell] = t[c]
            cols.append(pa.ListArray.from_arrays(offsets, pa.array(wide)))
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in PARTIAL.split(", ")])


def _counted(b: pa.RecordBatch, last: tuple | None) -> tuple[_Rows, bool, tuple]:
    """Counters of a batch sorted by (entity, type, time, event); whether its first entity is another
    than that of the row before; its last row."""
    entity, event = b.column("entity"), b.column("event")
    t, kind = b.column("t").to_numpy(zero_copy_only=False), b.column("kind").to_numpy(zero_copy_only=False).astype(np.int64)
    before = last or (None, -2, None, None)
    changed = lambda x, v: np.concatenate([[x[0] != v], x[1:] != x[:-1]])
    new_e = starts(entity, before[0])
    new_k = new_e | changed(kind, before[1])
    keep = new_k | changed(t, before[2]) | starts(event, before[3])
    fresh = bool(new_e[0])
    new_e[0] = new_k[0] = True
    e_at, k_at = np.flatnonzero(new_e), np.flatnonzero(new_k)
    e_run = np.cumsum(new_e) - 1
    amount = b.column("amount").to_numpy(zero_copy_only=False).astype(float)
    there = keep & ~np.isnan(amount)
    value, one = np.where(there, amount, 0.0), keep.astype(np.int64)
    sums = {
        "k": np.add.reduceat(one, e_at), "t0": np.minimum.reduceat(t, e_at), "t1": np.maximum.reduceat(t, e_at), "amount_n": np.add.reduceat(there.astype(np.int64), e_at), "amount_sum": np.add.reduceat(value, e_at),
        "amount_min": np.minimum.reduceat(np.where(there, amount, np.inf), e_at), "amount_max": np.maximum.reduceat(np.where(there, amount, -np.inf), e_at),
    }
    types = {"tr": e_run[k_at], "kind": kind[k_at], "n": np.add.reduceat(one, k_at), "sum": np.add.reduceat(value, k_at), "last": np.maximum.reduceat(t, k_at)}
    known = types["kind"] >= 0
    hour = np.floor(t / 3600).astype(np.int64)
    low, span = hour.min(), hour.max() - hour.min() + 1
    code, n = np.unique(e_run[keep] * span + hour[keep] - low, return_counts=True)
    hours = {"hr": code // span, "hour": code % span + low, "n": n}
    end = (entity[len(t) - 1].as_py(), int(kind[-1]), t[-1], event[len(t) - 1].as_py())
    return _Rows(np.array(entity.take(pa.array(e_at)).to_pylist(), object), sums, {c: v[known] for c, v in types.items()}, hours), fresh, end


def _stream(types: int, night: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Rows | None = None
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            rows, fresh, last = _counted(b, last)
            n, lo = len(rows.entity), 0
            if held is not None and not fresh:
                held, lo = held.joined(rows.part(0, 1)), 1
                if n == 1:
                    continue
            if held is not None:
                yield from held.batches(types, night)
            if n - 1 > lo:
                yield from rows.part(lo, n - 1).batches(types, night)
            held = rows.part(n - 1, n)
        if held is not None:
            yield from held.batches(types, night)

    return run


def _hot(events: DataFrame, share: float) -> DataFrame:
    """Entities with at least this share of the rows: at most 1 / share of them."""
    counts = events.groupBy("entity").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    # total is one row
    return cut(counts.join(F.broadcast(total), F.col("n") >= F.lit(share) * F.col("all")).select("entity"))


def partial_rows(df: DataFrame, spec: Events, hot_share: float = 0.002) -> DataFrame:
    """Complete counters per entity (see PARTIAL)."""
    kind = F.coalesce(*[F.when(spec.kind == F.lit(t), F.lit(i)) for i, t in enumerate(spec.types)], F.lit(-1))
    events = df.select(
        spec.entity.alias("entity"), spec.time.cast("double").alias("t"), spec.event.cast("string").alias("event"), kind.cast("int").alias("kind"), spec.amount.cast("double").alias("amount")
    ).where(F.col("entity").isNotNull() & F.col("t").isNotNull() & ~F.isnan("t") & F.col("event").isNotNull())
    n = shuffle_partitions(df.sparkSession)
    hot = F.broadcast(_hot(events.select("entity"), hot_share))  # at most 1 / hot_share rows
    order, step = ["entity", "kind", "t", "event"], _stream(len(spec.types), spec.night_hours)
    cold = events.join(hot, "entity", "left_anti").repartition(n, "entity")
    out = cold.sortWithinPartitions(*order).mapInArrow(step, PARTIAL)
    split = events.join(hot, "entity", "left_semi").repartition(n, F.col("entity"), F.floor(F.col("t") / 3600))
    parts = split.sortWithinPartitions(*order).mapInArrow(step, PARTIAL)
    m = len(spec.types)
    merged = parts.groupBy("entity").agg(
        *[F.sum(c).alias(c) for c in ("k",)], F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("hours").alias("hours"), F.max("hour_max").alias("hour_max"),
        *[F.sum(c).alias(c) for c in ("night", "weekend", "amount_n", "amount_sum")], F.min("amount_min").alias("amount_min"), F.max("amount_max").alias("amount_max"),
        F.array(*[F.sum(F.col("type_n")[i]) for i in range(m)]).alias("type_n"), F.array(*[F.sum(F.col("type_sum")[i]) for i in range(m)]).alias("type_sum"), F.array(*[F.max(F.col("type_last")[i]) for i in range(m)]).alias("type_last"),
    )
    return out.unionByName(merged)


def feature_table(df: DataFrame, spec: Events, hot_share: float = 0.002) -> DataFrame:
    """The wide table: volume, span, rate, interval, burst, night and weekend features, totals of
    the amount, and for every event type its count, total and latest time."""
    p = partial_rows(df, spec, hot_share)
    days = F.floor((F.col("t1") - F.col("t0")) / 86400) + 1
    none = lambda c: F.when(F.col("amount_n") > 0, F.col(c))
    names = [(i, "".join(x if x.isalnum() else "_" for x in t)) for i, t in enumerate(spec.types)]
    return p.select(
        F.col("entity"), F.col("k").alias("event_count"), F.col("t0").alias("first_time"), F.col("t1").alias("last_time"), days.cast("long").alias("active_days"),
        (F.col("k") / days).alias("events_per_day"), F.when(F.col("k") > 1, (F.col("t1") - F.col("t0")) / (F.col("k") - 1)).otherwise(F.lit(0.0)).alias("mean_interval_seconds"),
        F.col("hours").alias("active_hours"), F.col("hour_max").alias("max_events_per_hour"), (F.col("hour_max") / (F.col("k") / F.col("hours") + F.lit(1e-6))).alias("burst_ratio"),
        (F.col("night") / F.col("k")).alias("night_activity_ratio"), (F.col("weekend") / F.col("k")).alias("weekend_activity_ratio"),
        F.col("amount_n").alias("amount_count"), F.col("amount_sum").alias("amount_total"), none("amount_min").alias("amount_min"), none("amount_max").alias("amount_max"),
        *[F.col("type_n")[i].alias(f"n_{t}") for i, t in names], *[F.col("type_sum")[i].alias(f"total_{t}") for i, t in names],
        *[F.when(F.col("type_n")[i] > 0, F.col("type_last")[i]).alias(f"last_{t}") for i, t in names],
    )
