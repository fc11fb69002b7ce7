"""Most similar rows by cosine, over dense vectors and over sparse target profiles: blocks of rows meet in
their own tasks, and only each row's best leave a task.

Candidates come from a bound that can lose none; their similarities are then computed in double precision,
term by term in a fixed order, and rounded like Spark's ``round(x, 9)``, so results don't depend on blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 2_000_000  # products at once
MARGIN = 2e-5  # above the error of a product in single precision
GROUPS = 16


def nano(x: np.ndarray) -> np.ndarray:
    """x in [0, 2) in units of 1e-9, the shortest decimal rounded half up."""
    y = x * 1e9
    r = np.floor(y + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        r[i] = int(Decimal(repr(float(x[i]))).scaleb(9).to_integral_value(ROUND_HALF_UP))
    return r


def places(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by row, then value descending (else as it was), and the positions from 0 within each row in that order."""
    order = np.lexsort((-value, row))
    r = row[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    return order, np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))


def norms(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x))
    for c in range(x.shape[1]):
        s += x[:, c] * x[:, c]
    return np.sqrt(s)


def _reach(s: np.ndarray, k: int) -> np.ndarray:
    """At most the k-th largest value of each row: the k-th largest of the maxima of disjoint groups."""
    m = s.shape[1] // GROUPS * GROUPS
    if m // GROUPS >= k:
        s = np.concatenate([s[:, :m].reshape(len(s), GROUPS, -1).max(axis=1), s[:, m:]], axis=1)
    n = s.shape[1]
    return np.partition(s, n - k, axis=1)[:, n - k] if n > k else np.full(len(s), -np.inf, s.dtype)


def best(q: np.ndarray, x: np.ndarray, k: int, least: float, eps: float):
    """Yields (i, j, similarity) arrays: for each row i of q the rows j of x of rank up to k by rounded
    cosine, with all ties of the last, from ``least``."""
    qn, xn = norms(q), norms(x)
    q1, x1 = (q / qn[:, None]).astype(np.float32), (x / xn[:, None]).astype(np.float32)
    step = max(1, SLICE // len(x))
    for at in range(0, len(q), step):
        s = q1[at : at + step] @ x1.T
        i, j = np.nonzero(s >= np.maximum(_reach(s, k), least)[:, None] - MARGIN)
        i += at
        dot = np.zeros(len(i))
        for c in range(q.shape[1]):
            dot += q[i, c] * x[j, c]
        r = nano(dot / (qn[i] * xn[j] + eps))
        keep = r / 1e9 >= least
        i, j, r = i[keep], j[keep], r[keep]
        order, place = places(i, r)
        i, j, r = i[order], j[order], r[order]
        last = np.full(len(q), -1, np.int64)
        last[i[place == k - 1]] = r[place == k - 1]
        keep = r >= last[i]
        yield i[keep], j[keep], r[keep] / 1e9


def blocked(left: DataFrame, right: DataFrame, by: str, blocks: tuple[int, int], run: Callable, schema: str) -> DataFrame:
    """``run`` (two Arrow tables to one) for each pair of one of ``blocks[0]`` blocks of ``left`` and one of
    ``blocks[1]`` of ``right``; blocks are by hash of the columns ``by``."""
    n, m = blocks
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, where both are one frame
    part = lambda d, k: F.pmod(F.xxhash64(d[by]), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    x = left.withColumn("_i", part(left, n)).withColumn("_j", every(m)).repartition(2 * n * m, "_i", "_j")
    y = right.withColumn("_j", part(right, m)).withColumn("_i", every(n)).repartition(2 * n * m, "_i", "_j")
    return x.groupBy("_i", "_j").cogroup(y.groupBy("_i", "_j")).applyInArrow(run, schema)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length: lists of doubles, or binary counts of int32, the latter scaled to length 1."""
    c = column.combine_chunks()
    if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
        n = np.frombuffer(b"".join(c.to_pylist()), np.int32).reshape(len(c), -1).astype(np.float64)
        return n / np.sqrt((n * n).sum(axis=1))[:, None]
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def top_similar(queries: DataFrame, index: DataFrame, key: str, vector: str, k: int, least: float = -1.0, eps: float = 0.0, blocks: tuple[int, int] = (1, 1)) -> DataFrame:
    """(query, match, similarity): for each row of ``queries`` the rows of ``index`` of rank up to k by
    cosine in each block of the index, with all ties of the last. Both have a unique (key, vector); no vector is 0."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        none = a.column(key).slice(0, 0)
        out = [pa.table({"query": none, "match": b.column(key).slice(0, 0), "similarity": pa.array([], pa.float64())})]
        if len(a) and len(b):
            for i, j, s in best(matrix(a.column(vector)), matrix(b.column(vector)), k, least, eps):
                out.append(pa.table({"query": a.column(key).take(pa.array(i)), "match": b.column(key).take(pa.array(j)), "similarity": s}))
        return pa.concat_tables(out)

    return blocked(queries.select(key, vector), index.select(key, vector), key, blocks, run, f"query {dict(queries.dtypes)[key]}, match {dict(index.dtypes)[key]}, similarity double")


def _entries(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Sources in ascending order with their norms, and their entries by source and target: positions of
    sources, targets, weights, and the place of each entry within its source."""
    t = t.sort_by("s")
    s, norm = t.column("s").to_numpy(), t.column("norm").to_numpy()
    targets = t.column("ts").combine_chunks()
    n = targets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(len(s)), n)
    first = np.cumsum(n) - n
    return s, norm, at, targets.flatten().to_numpy(zero_copy_only=False).astype(np.int64), t.column("ws").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.arange(len(at)) - first[at]


def shared_pairs(left: pa.Table, right: pa.Table, min_shared: int, threshold: float, top_k: int):
    """Yields (me, other, shared, similarity) arrays: for each source of ``left`` its ``top_k`` (0 for all)
    of ``right`` by similarity, then number.

    Targets are numbered from the most popular. Sources that share two targets share one that is the most
    popular of neither: the rarer one. So where two are needed, lists leave out each source's most popular
    target; what that one adds to a pair is looked up afterwards. Nothing is lost, and the sources that a hub
    alone brings together never meet.
    """
    s, na, la, lt, lw, lp = _entries(left)
    o, nb, ra, rt, rw, rp = _entries(right)
    skip = 1 if min_shared > 1 else 0
    width = int(max(lt.max(initial=0), rt.max(initial=0))) + 1
    full_l, full_r = la * width + lt, ra * width + rt  # ascending
    use = rp >= skip
    order = np.lexsort((ra[use], rt[use]))
    inv_t, inv_b, inv_w = rt[use][order], ra[use][order], rw[use][order]
    start, end = np.searchsorted(inv_t, np.arange(width)), np.searchsorted(inv_t, np.arange(width), "right")
    top = lambda t, w, p: (t[p == 0], w[p == 0])
    (ta, wa), (tb, wb) = top(lt, lw, lp), top(rt, rw, rp)
    use = lp >= skip
    la1, lt1, lw1 = la[use], lt[use], lw[use]
    many = end[lt1] - start[lt1]
    upto = np.cumsum(np.bincount(la1, many, len(s))).astype(np.int64)
    at = 0
    while at < len(s):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
        lo, hi = np.searchsorted(la1, [at, stop])
        n = many[lo:hi]
        e = np.repeat(np.arange(lo, hi), n)
        f = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n) + start[lt1[e]]
        a, b, dot = la1[e], inv_b[f], lw1[e] * inv_w[f]
        at = stop
        keep = s[a] != o[b]
        a, b, dot = a[keep], b[keep], dot[keep]
        if not len(a):
            continue
        key = a * len(o) + b
        order = np.argsort(key, kind="stable")
        key, dot = key[order], dot[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        dot, shared = np.add.reduceat(dot, first), np.diff(np.r_[first, len(key)])
        a, b = np.divmod(key[first], len(o))
        if skip:
            same = ta[a] == tb[b]
            dot[same] += wa[a[same]] * wb[b[same]]
            shared[same] += 1
            # of two different ones only the rarer can be among the other's targets
            for full, rows, t, w, weights, z in ((full_r, b, ta[a], wa[a], rw, ta[a] > tb[b]), (full_l, a, tb[b], wb[b], lw, tb[b] > ta[a])):
                z = np.flatnonzero(z)
                want = rows[z] * width + t[z]
                p = np.minimum(np.searchsorted(full, want), len(full) - 1)
                hit = full[p] == want
                dot[z[hit]] += w[z[hit]] * weights[p[hit]]
                shared[z[hit]] += 1
        keep = shared >= min_shared
        a, b, dot, shared = a[keep], b[keep], dot[keep], shared[keep]
        r = nano(np.minimum(1.0, dot / (na[a] * nb[b])))
        keep = r / 1e9 >= threshold
        if top_k <= 0:
            keep &= s[a] < o[b]
        a, b, shared, r = a[keep], b[keep], shared[keep], r[keep]
        if top_k > 0:
            order, place = places(a, r)
            order = order[place < top_k]
            a, b, shared, r = a[order], b[order], shared[order], r[order]
        yield s[a], o[b], shared, r / 1e9
