"""Grouping records into similarity clusters by hierarchical density clustering.

1. Neighbour graph. Points are put in the order of a space-filling (Morton) curve under several
   random rotations; in each order, range partitions are streamed in windows and every point is
   compared with the points of its window only. The ``k`` nearest over all orders are its
   neighbours. The number of orders grows with the logarithm of the number of points, as each order
   separates more of them. So that no dense region falls apart, every point is also compared with the
   representative of its grid cell (side epsilon / sqrt(d)) in two shifted grids.
2. Mutual reachability. A point's core distance is that to its (min_size - 1)-th neighbour; an edge
   weighs the maximum of its length and both core distances.
3. Distributed Boruvka. In each round every component picks its lightest outgoing edge (ties by
   endpoints, so that no cycles arise), components are hooked and pointers shortened, the graph is
   contracted and parallel edges are merged. The edges picked are the minimum spanning forest.
4. Condensed hierarchy. The edges of the tree are taken in the order of their own weights w, at
   lambda = 1 / w. A component is a cluster from ``min_size`` points on; a smaller one that joins a
   cluster falls out of it at lambda; where two clusters meet, both end and a new one begins. A
   cluster's stability is the sum over its points of the lambda at which they leave it, less that at
   which it begins. Up to epsilon, meetings of clusters are not taken as splits (the hybrid selection
   by a distance bound), so the components at epsilon can be condensed each on its own, side by side;
   the tree over these components follows. A tree of more than ``cap`` edges is worked off in slices
   of ``cap`` edges by rising weight, so no task holds more.
5. Selection by stability. A cluster is selected if it is at least as stable as the best choice among
   the clusters below it; each component belongs to the topmost selected cluster above it. What joins
   a cluster beyond epsilon is noise.
6. Members carry their persistence, 1 / core distance; the most persistent ones are the exemplars.

Nothing but single numbers comes to the driver. Distances under epsilon / 1e6 count as that.

Defined cases: points with a null or NaN coordinate or a null id are left out; an id that comes
again with equal or other coordinates counts once (its lowest coordinates); equal points have
distance 0; noise has no row; under ``min_size`` points or an empty table give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.arrow import numbers, runs
from weftline.operators.components import components
from weftline.operators.ranking import cumulative
from weftline.plans.lineage import cut, shuffle_partitions


@dataclass(frozen=True)
class Density:
    epsilon: float
    min_size: int = 5
    k: int = 8
    orders: int = 4  # up to 2,000 points; one more for each doubling
    window: int = 256
    cap: int = 500_000  # edges of a tree that one task condenses at a time
    seed: int = 5


def points(rows: DataFrame, key: Column, coordinates: list[Column]) -> DataFrame:
    """(id, pid, x) of the usable rows, one per id."""
    xs = [c.cast("double") for c in coordinates]
    p = rows.select(key.alias("id"), F.array(*xs).alias("x")).where(F.col("id").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    return p.groupBy("id").agg(F.min("x").alias("x")).select("id", F.xxhash64("id").alias("pid"), "x")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    x = b.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _orders(cfg: Density, low: np.ndarray, span: float, orders: int):
    d = len(low)
    bits = max(1, 62 // d)
    rng = np.random.default_rng(cfg.seed)
    turns = [(np.eye(d), np.zeros(d))] + [(np.linalg.qr(rng.normal(size=(d, d)))[0], rng.uniform(0, 1, d)) for _ in range(orders - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = (_matrix(b) - low) / span
            for t, (turn, shift) in enumerate(turns):
                y = x @ turn + shift
                # a rotation about a corner of the unit cube stays within sqrt(d) of it, plus the shift
                q = np.clip((y + np.sqrt(d)) / (2 * np.sqrt(d) + 1) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                code = np.zeros(len(q), np.int64)
                for bit in range(bits - 1, -1, -1):
                    for j in range(d):
                        code = (code << 1) | ((q[:, j] >> bit) & 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), t, np.int32)), pa.array(code), b.column("pid"), b.column("x")], names=["turn", "code", "pid", "x"])

    return run


def _nearest(ids: np.ndarray, x: np.ndarray, lo: int, hi: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of x to each of x[lo:hi], by exact distances."""
    k = min(k, len(x) - 1)
    if k < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    y = x - x[lo]  # products near the origin lose little
    q = np.einsum("ij,ij->i", y, y)
    rough = q[None, :] - 2 * (y[lo:hi] @ y.T)
    rough[np.arange(hi - lo), np.arange(lo, hi)] = np.inf
    wide = min(len(x) - 1, k + 4)  # some more by the rough distances, then the exact ones
    near = np.argpartition(rough, wide - 1, axis=1)[:, :wide]
    diff = x[near] - x[lo:hi, None, :]
    d = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    best = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.repeat(ids[lo:hi], k), np.take_along_axis(ids[near], best, 1).reshape(-1), np.take_along_axis(d, best, 1).reshape(-1)


def _windows(cfg: Density):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, step = cfg.window // 2, cfg.window
        ids, x, turns, done = np.zeros(0, np.int64), None, np.zeros(0, np.int32), 0

        def emit(lo: int, hi: int, left: int, right: int) -> pa.RecordBatch:
            a, b, d = _nearest(ids[left:right], x[left:right], lo - left, hi - left, cfg.k)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["a", "b", "d"])

        for b in batches:
            if not b.num_rows:
                continue
            ids = np.concatenate([ids, b.column("pid").to_numpy()])
            turns = np.concatenate([turns, b.column("turn").to_numpy()])
            x = _matrix(b) if x is None else np.concatenate([x, _matrix(b)])
            # points [done, n) are not yet served; orders don't mix
            while len(ids) - done > step + half or turns[-1] != turns[done]:
                end = int(np.searchsorted(turns, turns[done], "right"))
                begin = int(np.searchsorted(turns, turns[done], "left"))
                hi = min(done + step, end)
                if hi + half > len(ids) and end == len(ids):
                    break
                yield emit(done, hi, max(begin, done - half), min(end, hi + half))
                done = hi
            drop = max(0, done - half)
            ids, x, turns, done = ids[drop:], x[drop:], turns[drop:], done - drop
        while x is not None and done < len(ids):
            end, begin = int(np.searchsorted(turns, turns[done], "right")), int(np.searchsorted(turns, turns[done], "left"))
            hi = min(done + step, end)
            yield emit(done, hi, max(begin, done - half), min(end, hi + half))
            done = hi

    return run


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))


def neighbours(pts: DataFrame, dims: int, cfg: Density) -> tuple[DataFrame, DataFrame]:
    """(a, b, w): edges of the mutual-reachability graph, a < b; (pid, core)."""
    box = pts.agg(F.count("*"), *[F.min(F.col("x")[i]) for i in range(dims)], *[F.max(F.col("x")[i]) for i in range(dims)]).first()
    low = np.array(box[1 : dims + 1], float)
    span = float(max(1e-9, (np.array(box[dims + 1 :], float) - low).max()))
    orders = cfg.orders + max(0, round(np.log2(box[0] / 2000)))
    placed = pts.select("pid", "x").mapInArrow(_orders(cfg, low, span, orders), "turn int, code long, pid long, x array<double>")
    near = placed.repartitionByRange("turn", "code").sortWithinPartitions("turn", "code", "pid").mapInArrow(_windows(cfg), "a long, b long, d double")
    side = cfg.epsilon / float(np.sqrt(dims))
    stars = None
    for shift in (0.0, 0.5):
        cell = F.transform("x", lambda v, s=shift: F.floor(v / F.lit(side) + F.lit(s)))
        celled = pts.select("pid", "x", cell.alias("cell"))
        rep = celled.groupBy("cell").agg(F.min(F.struct("pid", "x")).alias("r"))
        star = celled.join(rep, "cell").where(F.col("pid") != F.col("r.pid")).select(F.col("pid").alias("a"), F.col("r.pid").alias("b"), _distance("x", "r.x").alias("d"))
        stars = star if stars is None else stars.unionByName(star)
    stars = cut(stars)
    own = near.unionByName(stars).groupBy("a", "b").agg(F.min("d").alias("d"))
    ranked = cut(own.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= max(cfg.k, cfg.min_size - 1)))
    core = cut(ranked.where(F.col("r") == cfg.min_size - 1).select(F.col("a").alias("pid"), F.col("d").alias("core")))
    pairs = ranked.select("a", "b", "d").unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))
    edges = pairs.join(core.toDF("a", "ca"), "a").join(core.toDF("b", "cb"), "b").select("a", "b", F.greatest("d", "ca", "cb").alias("w"))
    return edges, core


def boruvka(edges: DataFrame, vertices: DataFrame, levels: list[float]) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest (a, b, w) of the edges up to the last level, and for each
    vertex its component at the end of each level: (pid, c0, c1, ...)."""
    graph = cut(edges.where(F.col("w") <= levels[-1]).select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("w", "a", "b").alias("e")))
    labels = vertices.select("pid", F.col("pid").alias("c"))
    tree = None
    columns: list[str] = []
    for number, top in enumerate(levels):
        while True:
            active = graph.where(F.col("e.w") <= top)
            ends = active.select(F.col("ca").alias("c"), F.col("cb").alias("o"), "e").unionByName(active.select(F.col("cb").alias("c"), F.col("ca").alias("o"), "e"))
            best = cut(ends.groupBy("c").agg(F.min(F.struct("e", "o")).alias("m")).select("c", F.col("m.o").alias("up"), F.col("m.e").alias("e")))
            if best.isEmpty():
                break
            chosen = best.select("e.a", "e.b", "e.w").distinct()
            tree = chosen if tree is None else tree.unionByName(chosen)
            back = best.select(F.col("c").alias("up"), F.col("up").alias("back"))
            # of two components that picked each other, the smaller is the root
            to = best.join(back, "up").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("up")), F.col("c")).otherwise(F.col("up")).alias("up"))
            to = cut(to)
            while True:
                for _ in range(3):
                    to = to.join(to.select(F.col("c").alias("up"), F.col("up").alias("upup")), "up").select("c", F.col("upup").alias("up"), (F.col("up") != F.col("upup")).alias("moved"))
                to = cut(to)
                # done when the last shortening moved no pointer: all lead to roots
                still = to.where("moved").isEmpty()
                to = to.select("c", "up")
                if still:
                    break
            a, b = to.toDF("ca", "na"), to.toDF("cb", "nb")
            moved = graph.join(a, "ca", "left").join(b, "cb", "left").select(F.coalesce("na", "ca").alias("x"), F.coalesce("nb", "cb").alias("y"), "e").where(F.col("x") != F.col("y"))
            graph = cut(moved.groupBy(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).agg(F.min("e").alias("e")))
            labels = cut(labels.join(to, "c", "left").select("pid", *columns, F.coalesce("up", "c").alias("c")))
        labels = labels.withColumn(f"c{number}", F.col("c"))
        columns.append(f"c{number}")
    if tree is None:
        tree = edges.select("a", "b", "w").limit(0)
    return tree, labels.select("pid", *columns)


STATE = (("v", "long"), ("rep", "long"), ("n", "long"), ("lam", "double"), ("split", "double"), ("cid", "long"), ("below", "double"))
OUT = "kind int, grp long, " + ", ".join(f"{c} {t}" for c, t in STATE) + ", parent long, own double"


def condense(a: np.ndarray, b: np.ndarray, w: np.ndarray, states: dict[int, tuple], epsilon: float, min_size: int) -> tuple[dict[int, tuple], list[tuple]]:
    """Works off the edges of one tree by rising weight.

    ``states`` has (n, lam, split, cid, below) of ends that stand for several points: their number,
    the sum of the lambdas at which they leave the open cluster, the heaviest meeting of two clusters
    up to epsilon (-1: none), the number of the open cluster (0: none) and the best total stability
    below it. Gives (rep, *state) of every end, and (cid, parent, own, below) of the clusters that ended.
    """
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)].tolist(), ends[len(a) :].tolist()
    at = [states.get(v, (1, 0.0, -1.0, 0, 0.0)) for v in ids.tolist()]
    up = list(range(len(ids)))
    closed: list[tuple] = []

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for x, y, d, ea, eb in zip(left, right, w.tolist(), a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x == y:
            continue
        lam = 1 / max(d, epsilon * 1e-6)
        (nx, lx, sx, cx, bx), (ny, ly, sy, cy, by) = at[x], at[y]
        n = nx + ny
        if d <= epsilon:
            big_x, big_y = nx >= min_size, ny >= min_size
            if big_x and big_y:
                new = (n, lx + ly, d, 0, 0.0)
            elif big_x or big_y:
                new = (n, lx + ly + (ny if big_x else nx) * lam, sx if big_x else sy, 0, 0.0)
            else:
                new = (n, n * lam if n >= min_size else 0.0, -1.0, 0, 0.0)
        elif cx and cy:
            number = hash((ea, eb, 1)) or 1
            best = 0.0
            for c, own, below in ((cx, lx - nx * lam, bx), (cy, ly - ny * lam, by)):
                closed.append((c, number, own, below))
                best += max(own, below)
            new = (n, n * lam, -1.0, number, best)
        elif cx or cy:
            new = (n, (lx + ny * lam, ly + nx * lam)[not cx], -1.0, cx or cy, bx if cx else by)
        else:
            new = (n, 0.0, -1.0, 0, 0.0)
        if nx < ny:
            x, y = y, x
        up[y] = x
        at[x] = new
    return {v: (int(ids[r := root(i)]), *at[r]) for i, v in enumerate(ids.tolist())}, closed


def _condense(epsilon: float, min_size: int):
    names = [c for c, _ in STATE[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["grp"]):
            a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "w"))
            states = {}
            for end, e in ((a, "a"), (b, "b")):
                there = np.flatnonzero(~np.isnan(numbers(t.column(f"n_{e}"))))
                if len(there):
                    rows = t.take(pa.array(there))
                    states |= dict(zip(end[there].tolist(), zip(*[rows.column(f"{c}_{e}").to_pylist() for c in names], strict=True), strict=True))
            reps, closed = condense(a, b, w, states, epsilon, min_size)
            grp = t.column("grp")[0].as_py()
            rows = [(0, grp, v, *s, None, None) for v, s in reps.items()] + [(1, grp, None, None, None, None, None, c, below, parent, own) for c, parent, own, below in closed]
            kinds = [pa.int32(), pa.int64(), *[pa.int64() if k == "long" else pa.float64() for _, k in STATE], pa.int64(), pa.float64()]
            for lo in range(0, len(rows), 100_000):
                cols = zip(*rows[lo : lo + 100_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return run


def condensed(edges: DataFrame, leaves: DataFrame | None, epsilon: float, min_size: int, cap: int) -> DataFrame:
    """The rows of OUT for trees given by edges (grp, a, b, w): kind 0 has the last state of every end's
    representative in each slice, kind 1 the clusters that ended. ``leaves`` (v, n, lam, split, cid,
    below) describes ends that stand for several points."""
    most = edges.groupBy("grp").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
    slices = max(1, -(-most // cap))
    if slices > 1:
        at = cumulative(edges.withColumns({"e": F.struct("w", "a", "b"), "n": F.lit(1)}).select("grp", "e", "n"), ["grp"], "e")
        edges = cut(at.select("grp", "e.a", "e.b", "e.w", F.floor((F.col("upto") - 1) / cap).alias("slice")))
    parts, now = shuffle_partitions(edges.sparkSession), leaves
    where, out = None, None  # (v, rep) of the ends so far
    for i in range(slices):
        e = edges.where(F.col("slice") == i).drop("slice") if slices > 1 else edges
        for end in "ab":
            if where is not None:
                e = e.join(where.toDF(end, "_rep"), end, "left").withColumn(end, F.coalesce("_rep", end)).drop("_rep")
            names = [f"{c}_{end}" for c, _ in STATE[2:]]
            e = e.join(now.toDF(end, *names), end, "left") if now is not None else e.withColumns({n: F.lit(None).cast(t) for n, (_, t) in zip(names, STATE[2:], strict=True)})
        e = e.select("grp", "a", "b", "w", *[f"{c}_{x}" for x in "ab" for c, _ in STATE[2:]])
        got = cut(e.repartition(parts, "grp").sortWithinPartitions("grp", "w", "a", "b").mapInArrow(_condense(epsilon, min_size), OUT))
        out = got if out is None else out.unionByName(got)
        if slices > 1:
            fresh = got.where("kind = 0")
            to = fresh.select("v", "rep")
            moved = to if where is None else where.join(to.toDF("rep", "_to"), "rep", "left").select("v", F.coalesce("_to", "rep").alias("rep")).unionByName(to.join(where.select("v"), "v", "left_anti"))
            where = cut(moved)
            held = fresh.where(F.col("v") == F.col("rep")).select(F.col("rep").alias("v"), *[c for c, _ in STATE[2:]])
            now = cut(held if now is None else held.unionByName(now.join(held.select("v"), "v", "left_anti")))
    return out


def _final(states: DataFrame) -> DataFrame:
    """The state of each whole tree: that with all of its points."""
    fields = [c for c, _ in STATE[2:]]
    return states.where("kind = 0").groupBy("grp").agg(F.max(F.struct(*fields)).alias("s")).select("grp", "s.*")


def condensed_tree(tree: DataFrame, labels: DataFrame, cfg: Density) -> DataFrame:
    """(cid, parent, own, below): all clusters of the condensed hierarchy. A cluster without clusters
    below is numbered by its component at epsilon; ``labels`` has (pid, c0, c1): the component at
    epsilon and the tree of every point."""
    of = labels.select(F.col("pid").alias("a"), F.col("c0"), F.col("c1"))
    inner = tree.where(F.col("w") <= cfg.epsilon).join(of, "a").select(F.col("c0").alias("grp"), "a", "b", "w")
    low = _final(condensed(inner, None, cfg.epsilon, cfg.min_size, cfg.cap)).where(F.col("n") >= cfg.min_size)
    sizes = labels.groupBy("c0").agg(F.count("*").alias("points"))
    leaves = sizes.join(low.select(F.col("grp").alias("c0"), "lam"), "c0", "left")
    leaves = cut(leaves.select(F.col("c0").alias("v"), F.col("points").alias("n"), F.coalesce("lam", F.lit(0.0)).alias("lam"), F.lit(-1.0).alias("split"), F.when(F.col("lam").isNotNull(), F.col("c0")).otherwise(F.lit(0)).alias("cid"), F.lit(0.0).alias("below")))
    b = labels.select(F.col("pid").alias("b"), F.col("c0").alias("cb"))
    outer = cut(tree.where(F.col("w") > cfg.epsilon).join(of, "a").join(b, "b").select(F.col("c1").alias("grp"), F.col("c0").alias("a"), F.col("cb").alias("b"), "w"))
    rows = condensed(outer, leaves, cfg.epsilon, cfg.min_size, cfg.cap)
    ended = rows.where("kind = 1").select("cid", "parent", "own", "below")
    top = _final(rows).where(F.col("cid") != 0).select("cid", F.lit(None).cast("long").alias("parent"), F.col("lam").alias("own"), "below")
    alone = leaves.where(F.col("cid") != 0).join(outer.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "v", "left_anti")
    return cut(ended.unionByName(top).unionByName(alone.select("cid", F.lit(None).cast("long").alias("parent"), F.col("lam").alias("own"), "below")))


def select_clusters(clusters: DataFrame) -> DataFrame:
    """(cid, cluster): the topmost selected cluster at or above each cluster, by pointers that double
    their reach each round."""
    chosen = F.when(F.col("own") >= F.col("below"), F.col("cid"))
    state = cut(clusters.select("cid", F.col("parent").alias("up"), chosen.alias("best")))
    while not state.where(F.col("up").isNotNull()).isEmpty():
        above = state.select(F.col("cid").alias("up"), F.col("up").alias("up2"), F.col("best").alias("best2"))
        state = cut(state.join(above, "up", "left").select("cid", F.col("up2").alias("up"), F.coalesce("best2", "best").alias("best")))
    return state.select("cid", F.col("best").alias("cluster"))


def density_clusters(rows: DataFrame, key: Column, coordinates: list[Column], cfg: Density) -> tuple[DataFrame, DataFrame]:
    """(id, pid, x, cluster, persistence), one row per clustered point, cluster being a number; and
    the minimum spanning forest (a, b, w) over the numbers pid of the points."""
    pts = cut(points(rows, key, coordinates))
    if pts.isEmpty():
        none = pts.select("id", "pid", "x", F.col("pid").alias("cluster"), F.lit(0.0).alias("persistence"))
        return none, pts.select(F.col("pid").alias("a"), F.col("pid").alias("b"), F.lit(0.0).alias("w"))
    edges, core = neighbours(pts, len(coordinates), cfg)
    tree, labels = boruvka(edges, core.select("pid"), [cfg.epsilon, float("inf")])
    tree, labels = cut(tree), cut(labels)
    picked = select_clusters(condensed_tree(tree, labels, cfg))
    found = labels.select("pid", F.col("c0").alias("cid")).join(picked, "cid").drop("cid")
    return cut(pts.join(found, "pid").join(core, "pid").select("id", "pid", "x", "cluster", (1 / F.greatest("core", F.lit(1e-12))).alias("persistence"))), tree


def _too_far(members: DataFrame, dims: int, epsilon: float, block: int = 256) -> DataFrame:
    """(cluster, ia, ib): members of a cluster that are more than epsilon apart.

    By the triangle inequality only points whose distances from the cluster's centre add up to more
    than epsilon can be; only these are compared, in blocks, so no task takes a whole cluster.
    """
    centre = members.groupBy("cluster").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(dims)]).alias("m"))
    far = cut(members.join(centre, "cluster").select("cluster", "id", "x", _distance("x", "m").alias("r")))
    reach = far.groupBy("cluster").agg(F.max("r").alias("most"))
    outer = far.join(reach, "cluster").where(F.col("r") + F.col("most") > epsilon).select("cluster", "id", "x", "r")
    size = outer.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("blocks"))
    outer = outer.join(size, "cluster")
    a = outer.select("cluster", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("at"), F.col("id").alias("ia"), F.col("x").alias("xa"), F.col("r").alias("ra"))
    b = outer.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("at"), F.col("id").alias("ib"), F.col("x").alias("xb"), F.col("r").alias("rb"))
    near = (F.col("ia") < F.col("ib")) & (F.col("ra") + F.col("rb") > epsilon) & (_distance("xa", "xb") > epsilon)
    return a.join(b, ["cluster", "at"]).where(near).select("cluster", "ia", "ib")


def _large(members: DataFrame, min_size: int) -> DataFrame:
    enough = members.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    return members.join(enough.select("cluster"), "cluster", "left_semi")


def all_alike(members: DataFrame, tree: DataFrame, dims: int, epsilon: float, min_size: int, cap: int = 500_000) -> DataFrame:
    """The clusters as sets whose members all lie within epsilon of each other.

    A cluster that holds points too far apart is split where its spanning tree joins two parts of at
    least ``min_size`` points at the largest weight, and its parts are tested again. One that can't be
    split loses, of each two points too far apart, the one with more such partners (ties: the larger
    id). Every round splits a cluster or takes points away, and rounds go on until none is left to mend. A
    point that fell away joins a cluster that came out of its old one if it is alike to all of it.
    """
    whole, changed = members.withColumn("was", F.col("cluster")), False
    now = whole
    while True:
        bad = cut(_too_far(now, dims, epsilon))
        if bad.isEmpty():
            break
        changed = True
        broken = bad.select("cluster").distinct()
        p = now.join(broken, "cluster", "left_semi").select("pid", "cluster")
        inner = tree.join(p.toDF("a", "grp"), "a").join(p.toDF("b", "grp_b"), "b").where(F.col("grp") == F.col("grp_b")).select("grp", "a", "b", "w")
        inner = cut(inner)
        cuts = condensed(inner, None, float("inf"), min_size, cap).where("kind = 0 and split >= 0").groupBy("grp").agg(F.max("split").alias("at"))
        cuts = cut(cuts)
        part = components(inner.join(cuts, "grp").where(F.col("w") < F.col("at")), "a", "b").toDF("pid", "part")
        divided = now.join(cuts.select(F.col("grp").alias("cluster")), "cluster", "left_semi").drop("cluster").join(part, "pid").withColumnRenamed("part", "cluster").select(*now.columns)
        n = bad.select("cluster", F.explode(F.array("ia", "ib")).alias("id")).groupBy("cluster", "id").agg(F.count("*").alias("n"))
        j = bad.join(n.toDF("cluster", "ia", "na"), ["cluster", "ia"]).join(n.toDF("cluster", "ib", "nb"), ["cluster", "ib"])
        gone = j.select("cluster", F.when(F.col("na") > F.col("nb"), F.col("ia")).otherwise(F.col("ib")).alias("id")).distinct()
        rest = now.join(cuts.select(F.col("grp").alias("cluster")), "cluster", "left_anti").join(gone, ["cluster", "id"], "left_anti").select(*now.columns)
        now = cut(_large(rest.unionByName(divided), min_size))
    if not changed:
        return _large(members, min_size)
    loose = whole.join(now.select("pid"), "pid", "left_anti")
    centre = now.groupBy("was", "cluster").agg(F.count("*").alias("size"), F.array(*[F.avg(F.col("x")[i]) for i in range(dims)]).alias("m"))
    near = loose.drop("cluster").join(centre, "was").where(_distance("x", "m") <= epsilon)
    with_all = near.join(now.select("cluster", F.col("x").alias("y")), "cluster").where(_distance("x", "y") <= epsilon).groupBy("pid", "cluster", "size").agg(F.count("*").alias("alike")).where(F.col("alike") == F.col("size"))
    back = with_all.groupBy("pid").agg(F.min("cluster").alias("cluster"))
    now = cut(now.unionByName(loose.drop("cluster").join(back, "pid").select(*now.columns)))
    # of two that came back and aren't alike, the larger id stays away
    clash = _too_far(now, dims, epsilon).select("cluster", F.col("ib").alias("id")).distinct()
    return now.join(clash, ["cluster", "id"], "left_anti").select(*members.columns)
