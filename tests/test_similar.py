"""Similar rows and shared targets by blocks: nothing is left out, whatever the blocks."""

import os
from itertools import combinations
from math import sqrt

import numpy as np
import pytest

from weftline.operators import similar

FOLDER = os.environ.get("WEFTLINE_DATA", "/root/testdata/sf0.001")
with_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_best_has_all_ties_and_java_rounding():
    q, x = np.array([[1.0, 0.0], [1.0, 1.0]]), np.array([[2.0, 0.0], [1.0, 1.0], [3.0, 0.0], [0.0, 1.0]] * 10)
    got = [(int(i), int(j), float(s)) for a in similar.best(q, x, 2, 0.5, 0.0) for i, j, s in zip(*a, strict=True)]
    assert sorted(got) == [(0, j, 1.0) for j in range(40) if j % 2 == 0] + [(1, j, 1.0) for j in range(1, 40, 4)]
    assert list(similar.nano(np.array([0.1234567895, 0.1234567885, 0.5, 1.0]))) == [123456790, 123456789, 500000000, 1000000000]


def test_tag_similarity_shuffles_only_the_best(spark):
    """It sorted every pair of profiles before: 400 distinct profiles gave 160,000 rows."""
    p = spark.createDataFrame([(i, [1.0, i / 100, (i * 7 % 13) / 10]) for i in range(400)], "pid int, v array<double>")
    for blocks in ((1, 1), (3, 3)):
        got = similar.top_similar(p, p, "pid", "v", 4, 0.75, 0.0, blocks).collect()
        assert len(got) <= 400 * 5 * blocks[1]
        v = np.array([[1.0, i / 100, (i * 7 % 13) / 10] for i in range(400)])
        s = np.round(v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1)), 9)
        fourth = -np.sort(-s, axis=1)[:, 3]
        want = {(i, j) for i in range(400) for j in range(400) if s[i, j] >= max(fourth[i], 0.75)}
        assert want <= {(r["query"], r["match"]) for r in got}


@pytest.mark.parametrize(("shared", "top", "side"), [(2, 0, 10**6), (2, 3, 10**6), (2, 3, 50), (1, 2, 10**6), (3, 0, 10**6)])
def test_whole_co_targets_against_brute_force(spark, shared, top, side):
    """Two hubs of 260 and 230 sources, of which 200 each counted before."""
    from weftline.operators import graph

    rng = np.random.default_rng(5)
    w = {(f"s{i:03}", "hub"): 1.0 + i % 3 for i in range(260)} | {(f"s{i:03}", "star"): 2.0 for i in range(230)}
    w |= {(f"s{rng.integers(260):03}", f"t{rng.integers(30)}"): float(rng.integers(1, 4)) for _ in range(500)}
    of = {}
    for (s, t), x in w.items():
        of.setdefault(s, {})[t] = x
    norm = {s: sqrt(sum(x * x for x in p.values())) for s, p in of.items()}
    pairs = {}
    for a, b in combinations(sorted(of), 2):
        both = of[a].keys() & of[b].keys()
        sim = round(min(1.0, sum(of[a][t] * of[b][t] for t in both) / (norm[a] * norm[b])), 9)
        if len(both) >= shared and sim >= 0.2:
            pairs[a, b] = (len(both), sim)
    if top:
        near = {}
        for (a, b), (_, sim) in pairs.items():
            near.setdefault(a, []).append((-sim, b))
            near.setdefault(b, []).append((-sim, a))
        pairs = {(a, b): x for (a, b), x in pairs.items() if (-x[1], b) in sorted(near[a])[:top] or (-x[1], a) in sorted(near[b])[:top]}
    e = spark.createDataFrame([(s, t, x) for (s, t), x in w.items()], "source string, target string, w double")
    cfg = graph.Projection(0.2, top, shared, 0)
    got = {(r.a, r.b): (r.shared, r.similarity) for r in graph.whole_co_targets(e, cfg, 10_000, side).collect()}
    assert got == pairs and graph.co_targets(e, "w", cfg).count() == len(pairs) > 200


@with_data
@pytest.mark.parametrize("name", ["tiered_expansion", "induced_edges", "shared_with_seed", "expansion_sweep"])
def test_expansion_counts_all_sources(spark, name):
    from tests.oracle import compare, duck
    from weftline.plans import catalogue

    folder = FOLDER.replace("sf0.001", "sf0.01")  # has targets of up to 300 sources
    sql = catalogue.oracle_sql()[name]
    assert "<= 200" not in sql
    said = compare(spark, duck(folder), folder, name, catalogue.queries()[name], sql)
    assert said.startswith("ok"), said


def test_context_takes_any_number_of_queries(spark):
    """It raised an error above 10,000 queries before."""
    from weftline.operators import providers

    q = spark.range(10_001).selectExpr("cast(id as int) id", "concat('fees rise on exchange', id % 7) text")
    c = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(["exchange fees rise", "a wallet", "exchange fees rise", "12 34", "fees rise on"])], "cid string, chunk string")
    rows = providers.context(q, c, "id", "text", "cid", "chunk", 2, 4_000).collect()
    assert len(rows) == 20_002 and {r.place for r in rows} == {1, 2}
    assert "c3" not in {r.cid for r in rows}


def test_counts_are_the_hashed_terms(spark):
    from weftline.operators import providers, text_features

    t = spark.createDataFrame([("a", "Don't buy NOW, buy x2 İstanbul K9"), ("b", "1 2 3"), ("c", None), ("d", "buy now now")], "id string, text string")
    want = {(r.id, r.bucket): r.weight for r in text_features.hashed_terms(t, "id", "text").collect()}
    got = {}
    for r in providers.counts(t, "id", "text", known=1).collect():
        n = np.frombuffer(r.counts, np.int32)
        got |= {(r.id, int(b)): n[b] / sqrt((n * n).sum()) for b in np.flatnonzero(n)}
    assert got == want
