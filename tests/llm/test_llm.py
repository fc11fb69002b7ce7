"""Operators for training data against brute force, exact round trips and held-out accuracy."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm.classes import member_pairs
from weftline.llm.clusters import Density, all_alike, boruvka, density_clusters
from weftline.llm.content import ContentModel, content_scores, offending_sentences
from weftline.llm.groups import connected_groups, peeled_groups
from weftline.llm.mixing import mix_copies, shares
from weftline.llm.near_duplicates import NearDuplicates, _block_pairs, near_duplicate_groups, near_duplicate_pairs
from weftline.llm.sentences import sentences
from weftline.llm.set_pairs import SetJoin, merge_skip, set_pairs
from weftline.llm.tokens import Tokenizer, _encoder, corpus_ids, corpus_sizes, cuts, join, split
from weftline.llm.top_items import top_items


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# p1


def test_merge_skip_counts():
    r = random.Random(1)
    for _ in range(300):
        lists = [sorted(r.sample(range(60), r.randint(0, 40))) for _ in range(r.randint(1, 9))]
        lo, hi, need = r.randint(0, 20), r.randint(20, 60), r.randint(1, 6)
        want = {p: n for p in range(lo, hi) if (n := sum(p in x for x in lists)) >= need}
        assert dict(merge_skip([x for x in lists if x], lo, hi, need)) == want


@pytest.mark.parametrize("tile", [4096, 8])
def test_set_pairs_against_brute_force(spark, tile):
    r = random.Random(2)
    sets = {}
    for i in range(160):
        base = r.sample(range(40), r.randint(1, 9))
        sets[f"r{i:03}"] = set(base)
        if i % 3 == 0:
            sets[f"s{i:03}"] = set(base[: max(1, len(base) - 1)]) | {r.randint(0, 45)}
        if i % 10 == 0:
            sets[f"t{i:03}"] = set(base)
    for x in sets.values():
        if r.random() < 0.7:
            x.add(999)  # a value of most records
    data = [(k, f"v{v}", "clash", 1) for k, s in sets.items() for v in s]
    data += data[:50] + [(None, "v1", "x", 1), ("r000", None, "x", 1)]
    got = {(a, b): n for a, b, n, _, _ in rows(set_pairs(spark.createDataFrame(data, "record string, value string, rec string, vals int"), F.col("record"), F.col("value"), SetJoin(0.6, 3, tile)))}
    keys = sorted(sets)
    want = {(a, b): n for i, a in enumerate(keys) for b in keys[i + 1 :] if (n := len(sets[a] & sets[b])) >= 3 and n / len(sets[a] | sets[b]) >= 0.6}
    assert got == want and len(want) > 20


def test_set_pairs_empty(spark):
    assert set_pairs(spark.createDataFrame([], "r string, v string"), F.col("r"), F.col("v")).count() == 0
    assert set_pairs(spark.createDataFrame([("a", "x"), ("b", "y")], "r string, v string"), F.col("r"), F.col("v")).count() == 0


# p2


def union_find(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


def test_groups_with_giant_tail_and_chains(spark):
    r = random.Random(4)
    links = [("hub", f"h{i}") for i in range(40)] + [("h1", "t000")] + [(f"t{i:03}", f"t{i + 1:03}") for i in range(60)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(45)]
    links += [(f"x{r.randint(0, 99)}", f"x{r.randint(0, 99)}") for _ in range(50)] + [("lone", "lone"), (None, "a"), ("h3", "hub"), ("hub", "h3")]
    got = dict(rows(connected_groups(spark.createDataFrame(links, "a string, b string"), "a", "b")))
    assert got == union_find(links)
    assert connected_groups(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_groups_peel_the_giant(spark):
    """The giant with the hub is peeled whole, then the next large one; what is left is labelled."""
    links = [("hub", f"h{i:02}") for i in range(30)] + [(f"h{i:02}", f"t{i:02}") for i in range(20)] + [("two", f"w{i:02}") for i in range(20)]
    links += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("p", "q"), ("t19", "u0"), ("u0", "u1")]
    got = {r.vertex: (r.group_id, r.peel) for r in peeled_groups(spark.createDataFrame(links, "a string, b string"), "a", "b", 0.25).collect()}
    assert {v: g for v, (g, _) in got.items()} == union_find(links)
    peels = {n: {v for v, (_, p) in got.items() if p == n} for n in {p for _, p in got.values()}}
    assert len(peels[1]) == 53 and "hub" in peels[1] and len(peels[1]) / len(got) > 0.25  # the share peeled
    label = union_find(links)
    for n, found in peels.items():  # whole components, one a peel
        assert {v for v in label if label[v] in {label[x] for x in found}} == found and (n == 0 or len({label[x] for x in found}) == 1)


# p3


def test_density_clusters(spark):
    r = np.random.default_rng(1)
    data, want = [], {}
    for c, (centre, n) in enumerate([((0, 0, 0), 300), ((6, 0, 0), 5), ((0, 6, 1), 40), ((0, 0, 9), 4)]):
        x = r.normal(size=(n, 3))
        x = x / np.linalg.norm(x, axis=1, keepdims=True) * r.uniform(0, 0.5, (n, 1)) + centre
        for i, p in enumerate(x):
            data.append((f"k{c}-{i:03}", *map(float, p), 1))
            if n >= 5:
                want[f"k{c}-{i:03}"] = f"k{c}-000"
    data += [("far", 50.0, 50.0, 50.0, 1), ("null", None, 0.0, 0.0, 1), ("nan", float("nan"), 0.0, 0.0, 1), (None, 0.0, 0.0, 0.0, 1), data[0], data[5]]
    df = spark.createDataFrame(data, "id string, x double, y double, z double, cluster int")
    got, tree = density_clusters(df, F.col("id"), [F.col(c) for c in "xyz"], Density(1.0))
    found = all_alike(got, tree, 3, 1.0, 5)
    least = {}
    for i, c in rows(found.select("id", "cluster")):
        least.setdefault(c, i)
    assert {i: least[c] for i, c in rows(found.select("id", "cluster"))} == want


def by_hand(x, eps, m):
    """Clusters from all pairs, top down: the heaviest edges of the single-linkage tree are taken away one
    by one; stabilities, selection and the distance bound by their definitions."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, m - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    n = len(x)
    inside, tree, best = {0}, [], {i: (w[0, i], 0) for i in range(1, n)}
    while best:
        v = min(best, key=best.get)
        d0, u = best.pop(v)
        tree.append((d0, u, v))
        inside.add(v)
        for o in best:
            best[o] = min(best[o], (w[v, o], v))
    tree.sort()

    def parts(points, edges):
        label = {p: p for p in points}

        def find(p):
            while label[p] != p:
                p = label[p]
            return p

        for _, u, v in edges:
            label[find(u)] = find(v)
        out = {}
        for p in points:
            out.setdefault(find(p), []).append(p)
        return list(out.values())

    def has_bound(points, edges):  # a cluster: it holds a component of m points at eps
        return any(len(p) >= m for p in parts(points, [e for e in edges if e[0] <= eps]))

    def node(points, edges):
        """(sum of the lambdas at which points leave, points left, clusters it splits into) of a cluster."""
        leave = 0.0
        while True:
            if not edges or edges[-1][0] <= eps:
                # no splits from here: a point leaves where its component is left with fewer than m points
                for p in points:
                    at = next((e[0] for i, e in enumerate(edges) if len(next(q for q in parts(points, edges[: i + 1]) if p in q)) >= m), None)
                    leave += 1 / at if at else 0.0
                return leave, points, []
            top = edges[-1][0]
            two = parts(points, edges[:-1])
            big = [p for p in two if has_bound(p, [e for e in edges[:-1] if e[1] in p])]
            if len(big) == 2:
                kids = []
                for p in big:
                    sub = [e for e in edges[:-1] if e[1] in p]
                    kids.append((p, node(p, sub)))
                return leave + len(points) / top, points, [(p, k, 1 / top) for p, k in kids]
            small = [p for p in two if p is not (big[0] if big else None)]
            leave += sum(len(p) for p in small) / top
            if not big:
                return leave, [], []
            points, edges = big[0], [e for e in edges[:-1] if e[1] in big[0]]

    all_points = list(range(n))

    def solve(all_in, result, birth):
        leave, points, kids = result
        own = leave - all_in * birth
        if not kids:
            leaves = [p for p in parts(points, [e for e in tree if e[0] <= eps and e[1] in points]) if len(p) >= m]
            return own, [frozenset(p) for p in leaves], True
        below, got = 0.0, []
        for p, r, b in kids:
            s, c, _ = solve(len(p), r, b)
            below += s
            got.append(c)
        flat = [c for g in got for c in g]
        return (own, [frozenset().union(*flat)], True) if own >= below else (below, flat, False)

    if not has_bound(all_points, tree):
        return set()
    return set(solve(n, node(all_points, tree), 0.0)[1])


@pytest.mark.parametrize("cap", [500_000, 9])
def test_condensed_hierarchy_against_the_definition(spark, cap):
    several = 0
    for seed in (1, 3):
        r = np.random.default_rng(seed)
        x = np.concatenate([r.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.3, 14), ((3, 0), 0.3, 12), ((1.6, 2.5), 0.8, 14), ((9, 9), 0.2, 8), ((9, 10.5), 0.5, 9), ((20, 0), 0.1, 4))])
        df = spark.createDataFrame([(f"p{i:03}", float(a), float(b)) for i, (a, b) in enumerate(x)], "id string, x double, y double")
        got, _ = density_clusters(df, F.col("id"), [F.col("x"), F.col("y")], Density(0.45, 4, k=80, cap=cap))
        found = {}
        for i, c in rows(got.select("id", "cluster")):
            found.setdefault(c, set()).add(int(i[1:]))
        want = by_hand(x, 0.45, 4)
        assert {frozenset(v) for v in found.values()} == want
        several += len(want) > 2
    assert several


def points_of(spark, x):
    pts = spark.createDataFrame([(f"p{i:02}", i, [float(v) for v in p], 1) for i, p in enumerate(x)], "id string, pid long, x array<double>, cluster long")
    edges = pts.toDF("ia", "a", "xa", "ca").join(pts.toDF("ib", "b", "xb", "cb"), F.col("a") < F.col("b")).select("a", "b", F.sqrt(F.pow(F.col("xa")[0] - F.col("xb")[0], 2) + F.pow(F.col("xa")[1] - F.col("xb")[1], 2)).alias("w"))
    return pts, boruvka(edges, pts.select("pid"), [float("inf")])[0]


def test_all_alike_drops_what_breaks_a_cluster(spark):
    pts, tree = points_of(spark, [(0.1 * i, 0) for i in range(6)] + [(1.05, 0)])
    assert [r.id for r in all_alike(pts, tree, 2, 1.0, 5).orderBy("id").collect()] == [f"p{i:02}" for i in range(6)]
    assert all_alike(pts.where("id < 'p03'"), tree, 2, 1.0, 5).count() == 0


def test_all_alike_splits_bridged_clusters(spark):
    """Two equal clusters with a bridge between them come apart; an outer point is not lost."""
    one = [(0.1 * i, 0.1 * (i % 2)) for i in range(6)]
    x = [*one, *[(a + 2.2, b) for a, b in one], (1.3, 0.0), (-0.4, 0.0)]
    pts, tree = points_of(spark, x)
    got = {}
    for i, c in rows(all_alike(pts, tree, 2, 1.0, 5).select("id", "cluster")):
        got.setdefault(c, set()).add(int(i[1:]))
    assert sorted(map(sorted, got.values())) == [[*range(6), 13], [*range(6, 12)]]


def test_density_empty(spark):
    df = spark.createDataFrame([], "id string, x double")
    assert density_clusters(df, F.col("id"), [F.col("x")], Density(1.0))[0].count() == 0


# p4


def test_top_items(spark):
    r = random.Random(6)
    data = [(r.choice(["big"] * 9 + ["s1", "s2", None]), f"i{r.randint(0, 300)}", r.choice([0.0, 0.25, 0.5, None, float("nan"), -1.0]), 7) for _ in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "53")
    try:
        got = rows(top_items(spark.createDataFrame(data, "g string, item string, score double, grp int").repartition(5), "g", "item", "score", 7))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = {}
    for g, i, s, _ in data:
        if g and s is not None and not math.isnan(s):
            best[g, i] = max(best.get((g, i), -9), s)
    want = []
    for g in {g for g, _ in best}:
        want += [(g, i, s) for s, i in sorted(((s, i) for (h, i), s in best.items() if h == g), key=lambda x: (-x[0], x[1]))[:7]]
    assert got == sorted(want)
    assert top_items(spark.createDataFrame([], "g string, item string, score double"), "g", "item", "score", 3).count() == 0


# p5


def shingles(x, n):
    import re

    w = re.findall("[a-z0-9]+", x.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= 20 else set()


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünïcode", "it's", "İ"]
    texts = {}
    for i in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randint(15, 90))]
        texts[f"a{i:02}"] = " ".join(w)
        for k in range(r.randint(0, 2)):
            v = list(w)
            for _ in range(r.randint(0, 6)):
                v[r.randrange(len(v))] = "edit"
            if r.random() < 0.3:
                v = v[len(v) // 3 :] + v[: len(v) // 3]
            texts[f"b{i:02}{k}"] = r.choice(["  ", "\n\n"]).join(v).upper()
    texts |= {"empty": "", "blank": " \n", "long": " ".join(vocabulary * 40), "long2": " ".join(vocabulary * 40) + " more words"}
    data = [(k, v, 1) for k, v in texts.items()] + [("a00", texts["a00"], 1), ("null", None, 1), (None, texts["a01"], 1)]
    df = spark.createDataFrame(data, "id string, text string, cls int")
    cfg = NearDuplicates(0.6, 3, 20)
    got = {(a, b) for a, b, *_ in rows(near_duplicate_pairs(df, F.col("id"), F.col("text"), cfg))}
    s = {k: shingles(v, 3) for k, v in texts.items()}
    keys = sorted(s)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.6}
    assert got == want and len(want) > 20
    g = {x.id: x for x in near_duplicate_groups(df, F.col("id"), F.col("text"), cfg).collect()}
    label = union_find([*want, *[(k, k) for k in keys if s[k]]])
    assert g.keys() == label.keys()
    assert {(label[a] == label[b]) == (g[a].group_id == g[b].group_id) for a in label for b in label} == {True}


def test_large_blocks_are_cut_into_tiles(spark):
    """Blocks far larger than a tile give the same pairs as the plain join, each block once."""
    r = np.random.default_rng(3)
    keys = np.sort(np.concatenate([np.full(40, 7), np.full(3, 8), np.full(1, 9), r.integers(10, 60, 90)]))
    cls = r.integers(0, 500, len(keys))
    rows_ = sorted({(int(k), int(c)) for k, c in zip(keys, cls, strict=True)})
    rows_ += rows_[:5]  # repeated rows
    rows_ = sorted(rows_)
    want = {(a, b) for k in set(keys.tolist()) for a in {c for q, c in rows_ if q == k} for b in {c for q, c in rows_ if q == k} if a < b}
    for size in (1, 5, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows_[i : i + size]], pa.int64()), pa.array([c for _, c in rows_[i : i + size]], pa.int64())], names=["key", "cls"]) for i in range(0, len(rows_), size)]
        for tile in (2, 8, 512):
            got, large = set(), {}
            for b in _block_pairs(tile)(iter(batches)):
                for k, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if y is None:
                        large.setdefault(k, []).append(x)
                    else:
                        got.add((x, y))
            assert all(len(v) > tile and len(v) == len(set(v)) for v in large.values())
            assert got | {(a, b) for v in large.values() for a in v for b in v if a < b} == want


@pytest.mark.parametrize("block", [1, 3, 256])
def test_member_pairs_in_blocks(spark, block):
    m = {"A": [f"a{i}" for i in range(7)], "B": [f"b{i}" for i in range(5)], "C": ["c0"]}
    members = spark.createDataFrame([(x, c) for c, xs in m.items() for x in xs], "id string, cls string")
    pairs = spark.createDataFrame([("A", "B", 1), ("A", "A", 2), ("B", "C", 3), ("C", "C", 4)], "a string, b string, shared int")
    got = [(frozenset((r.x, r.y)), r.shared) for r in member_pairs(pairs, members, block).collect()]
    want = {(frozenset((x, y)), s) for a, b, s in (("A", "B", 1), ("A", "A", 2), ("B", "C", 3), ("C", "C", 4)) for x in m[a] for y in m[b] if x != y}
    assert set(got) == want and len(got) == len(want)


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([("a", "too short")], "id string, text string")
    assert near_duplicate_pairs(df, F.col("id"), F.col("text"), NearDuplicates()).count() == 0
    assert near_duplicate_groups(df.where("false"), F.col("id"), F.col("text"), NearDuplicates()).count() == 0


# p8

TRICKY = ["", " ", "a", "I'll it's  we've\n\n\n x", "日本語のテキスト。これは、長い文です！" * 30, "<|endoftext|> plain", "tab\tand space   line \x1c\x1f end", "é́ combining, ño", "👩‍👩‍👧 family. ok" * 50, "word " * 3000, "x" * 9000, "1234567890" * 500, "a.b,c;d:e!f?g (h) i" * 100, "кириллица, слово. ещё" * 60, "゛゜・ー。" * 200]


def test_chunks_join_exactly():
    encode = _encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    r = random.Random(9)
    texts = TRICKY + ["".join(r.choice("ab c.,'\n 日。éß1😀\t") for _ in range(r.randint(1, 800))) for _ in range(400)]
    for t in texts:
        for mean, longest in ((8, 64), (256, 4096)):
            ends = cuts(t, mean, longest) if t else []
            parts = [t[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            assert "".join(parts) == t
            assert join(encode, [split(encode, p) for p in parts]).tolist() == encode(t).tolist()


def test_corpus_ids(spark):
    encode = _encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    data = [(i, t, "x") for i, t in enumerate([*TRICKY, None])] + [(0, "twice", "x"), (0, "twice", "x")]
    got = sorted((r.doc_id, list(r.ids)) for r in corpus_ids(spark.createDataFrame(data, "doc_id long, text string, seq string"), F.col("doc_id"), F.col("text"), Tokenizer(chunk=32)).collect())
    assert got == sorted((i, encode(t).tolist() if t else []) for i, t, _ in data)
    assert corpus_ids(spark.createDataFrame([], "doc_id long, text string"), F.col("doc_id"), F.col("text")).count() == 0


def test_shared_chunks_are_reused(spark):
    """Texts with passages that come again take the way of shared chunks, the others are encoded in place; sizes agree."""
    encode = _encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    r = random.Random(12)
    say = lambda n: " ".join(r.choice(["chart", "moon,", "fees.", "日本語。", "él", "x1"]) + str(r.randint(0, 999)) for _ in range(n))
    passages = [say(300) for _ in range(3)]
    texts = [say(r.randint(0, 80)) + " " + r.choice(passages) + "\n" + say(r.randint(0, 80)) if i % 2 else say(60) for i in range(80)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 1), (901, "", 1)], "doc_id long, text string, size int").repartition(4)
    got = {x.doc_id: list(x.ids) for x in corpus_ids(df, F.col("doc_id"), F.col("text"), Tokenizer(chunk=64)).collect()}
    assert got == {i: encode(t).tolist() for i, t in enumerate(texts)} | {900: [], 901: []}
    assert {x.doc_id: x.size for x in corpus_sizes(df.drop("size"), "text").collect()} == {i: len(x) for i, x in got.items()}


# p9


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "big" if i % 4 else "small", 10 + i % 3) for i in range(20000)] + [(90001, None, 5), (90002, "big", 0)], "doc_id long, source string, size int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("gone", 0.1, 4), ("off", None, 1)], "source string, target_share double, max_repeats int")
    copies, rate = mix_copies(docs, targets)
    s = {r.source: r for r in shares(copies, rate).collect()}
    assert set(s) == {"big", "small", "gone"} and s["gone"].mixed_size == 0 and s["gone"].rate == 0
    assert s["small"].rate == pytest.approx(2.0) and s["small"].most_repeats == 2 and s["big"].most_repeats == 1
    assert s["big"].reached_share == pytest.approx(5 / 9, abs=0.01) and s["small"].reached_share == pytest.approx(4 / 9, abs=0.01)
    assert rows(copies) == rows(mix_copies(docs.repartition(7), targets)[0])
    assert shares(*mix_copies(docs.where("false"), targets)).agg(F.sum("mixed_size")).first()[0] == 0


# p10


def test_sentences_undo_disguises():
    assert sentences("go k1ll y o u r s e l f m0r0n, s.t.u.p.i.d ІDIОT sooooo!! (fine) $5,500.00") == ["go kill yourself moron", "stupid idiot so", "(fine) 0"]
    assert sentences(None) == sentences(" \n") == []
    assert len(sentences("word " * 100)) > 10


def test_content_model_held_out(spark):
    r = random.Random(10)
    calm = ["the chart moved up today", "fees are low on monday", "my wallet synced at last", "nobody noticed the vote", "i feel like a fool for selling", "please stop calling people fools"]
    bad = ["you are a worthless fool", "get lost you filthy fool", "we should drive them all out", "shut up you filthy liar"]
    docs, labels = [], []
    for i in range(900):
        s = [r.choice(calm) + r.choice([" again", "", " lol"]) for _ in range(r.randint(1, 6))]
        if i % 4 == 0:
            s.insert(r.randint(0, len(s)), r.choice(bad))
        docs.append((i, r.choice([". ", "! ", "\n"]).join(s), "clash"))
        if i < 600:
            labels.append((i, "abuse" if (i % 4 == 0) != (r.random() < 0.03) else "none", 1.0))
    docs += [(9001, None, ""), (9002, "", ""), (9003, " ", ""), (9004, docs[0][1] * 200, "")]
    labels += [(77777, "abuse", 1.0), (1, None, 1.0)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, category string, score double")
    got = {x.doc_id: x for x in content_scores(d, l, ContentModel(min_steps=300)).collect()}
    hit = [(got[i].score >= 0.5, i % 4 == 0) for i in range(600, 900)]
    assert sum(a == b for a, b in hit) / len(hit) > 0.97
    assert got[9001].score == got[9002].score == got[9003].score == 0 and got[9004].score >= 0.5
    assert got[600].worst_score == max(got[600].worst_score, 0.3)
    places = {}
    for x in offending_sentences(d, l, ContentModel(min_steps=300)).collect():
        places.setdefault(x.doc_id, []).append((x.place, x.sentence, x.score))
    assert places.keys() == {i for i, x in got.items() if x.score >= 0.5}
    for i, found in places.items():
        assert all(sentences(next(t for k, t, _ in docs if k == i))[p] == s for p, s, _ in found) and max(q for *_, q in found) == pytest.approx(got[i].worst_score)
        assert len(found) == max(1, got[i].offending) or got[i].offending == 0
    none = content_scores(d, l.where("false"), ContentModel())
    assert none.count() == len(docs) and none.where("score > 0.01").count() == 0
