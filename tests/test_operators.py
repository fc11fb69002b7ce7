"""Small cases of the core operators: nulls, empty tables, ties, repeated rows, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import accounts, text
from weftline.operators import cleaning, components, discovery, evaluation, expansion, graph, heavy_keys, ranking, temporal
from weftline.operators.entity_features import Events, feature_table, partial_rows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_account_names(spark):
    df = spark.createDataFrame([(" a\t",), ("[Deleted]",), (None,), ("",), ("NaN",), ("B\r\n",)], "x string")
    assert [r[0] for r in df.select(accounts.valid_name("x")).collect()] == ["a", None, None, None, None, "B"]


def test_text_normal_form(spark):
    df = spark.createDataFrame([("a\r\n\r\n\r\n\r\nb \t c ",), (None,), ("[removed]",)], "x string")
    assert [r[0] for r in df.select(text.clean(F.col("x"))).collect()] == ["a\n\nb c", "", ""]


def test_chunks_cover_the_text(spark):
    x = "".join(chr(97 + i % 26) for i in range(1234))
    got = spark.createDataFrame([(x,), ("",), (None,)], "x string").select(text.chunks(F.col("x"), 500, 100).alias("c")).collect()
    assert [len(r.c) for r in got] == [4, 0, 0]
    assert all(x[i * 400 : i * 400 + 500] == c for i, c in enumerate(got[0].c))


def test_clamp_int(spark):
    df = spark.createDataFrame([("2.5",), ("inf",), ("x",), (None,), ("1e9",), ("-7",)], "x string")
    assert [r[0] for r in df.select(text.clamp_int(F.col("x"), 0, 100, 50)).collect()] == [2, 50, 50, 50, 100, 0]


def test_global_index_and_percentile(spark):
    values = [random.Random(1).randint(-3, 20) for _ in range(500)]
    df = spark.createDataFrame([(i, float(v) if v != 5 else None) for i, v in enumerate(values)], "id int, v double")
    got = {r.id: r.p for r in ranking.positive_percentile(df, "v", "p", "id").collect()}
    pos = sorted(float(v) for v in values if v > 0 and v != 5)
    for i, v in enumerate(values):
        if v <= 0 or v == 5:
            assert got[i] == 0
        else:
            at = [k + 1 for k, x in enumerate(pos) if x == v]
            assert got[i] == pytest.approx(sum(at) / len(at) / len(pos))
    ids = ranking.global_index(df.select("id"), ["id"], "at").collect()
    assert all(r.id == r["at"] for r in ids)
    assert ranking.global_index(df.where("id < 0"), ["id"], "at").count() == 0


def test_keep_first_ties(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", None, "w")], "k string, n int, t string")
    assert rows(cleaning.keep_first(df, ["k"], [F.asc("n"), F.asc("t")])) == [("a", 1, "y"), ("b", None, "w")]


def test_heavy_keys(spark):
    data = [("s", "hot", str(i % 7), i % 5) for i in range(3000)] + [("s", f"k{i}", None, None) for i in range(60)] + [("s", None, "x", 1), ("t", "u", "x", 2)]
    df = spark.createDataFrame(data, "side string, key string, other string, score int")
    w = heavy_keys.compress(df, ["side", "key"], {"other": F.col("other"), "score": F.col("score")})
    p = {r.key: r for r in heavy_keys.profiles(w, ["side", "key"], ["other", "score"]).collect()}
    assert p["hot"].rows == 3000 and p["hot"].other_distinct == 7 and p["hot"].score_mode == "0" and p["hot"].score_mode_rows == 600
    assert p["k1"].rows == 1 and p["k1"].other_distinct == 0 and p["k1"].other_mode is None
    q = {r.key: r for r in heavy_keys.percentiles(w, ["side", "key"], "score", {"lo": 0.2, "mid": 0.5, "hi": 1.0}).collect()}
    assert (q["hot"].lo, q["hot"].mid, q["hot"].hi) == (0.0, 2.0, 4.0)
    assert rows(heavy_keys.heavy(w, ["side"], "key", 0.5, "other").select("side", "key")) == [("s", "hot"), ("t", "u")]
    empty = heavy_keys.compress(df.where("false"), ["side", "key"], {"score": F.col("score")})
    assert heavy_keys.heavy(empty, ["side"], "key", 0.5, "score").count() == 0


def events():
    return Events(F.col("user"), F.col("t"), F.col("id"), F.col("kind"), F.col("amount"), ("a", "b"))


FIELDS = "user string, t double, id string, kind string, amount double, entity string, k int"


def brute(data):
    out = {}
    seen = set()
    for user, t, i, kind, amount, *_ in data:
        if user is None or t is None or i is None or (user, t, i) in seen:
            continue
        seen.add((user, t, i))
        out.setdefault(user, []).append((t, kind, amount))
    want = {}
    for user, ev in out.items():
        hours = {}
        for t, _, _ in ev:
            hours[t // 3600] = hours.get(t // 3600, 0) + 1
        ts = sorted(t for t, _, _ in ev)
        amounts = [a for _, _, a in ev if a is not None]
        want[user] = (len(ev), ts[0], ts[-1], len(hours), max(hours.values()), sum(int(t // 3600 % 24) < 6 for t in ts) / len(ts), sum(amounts), min(amounts, default=None), sum(k == "a" for _, k, _ in ev), max((t for t, k, _ in ev if k == "a"), default=None))
    return want


@pytest.mark.parametrize("hot", [0.9, 0.05])
def test_entity_features_against_brute_force(spark, hot):
    r = random.Random(3)
    data = []
    for i in range(4000):
        user = "hot" if r.random() < 0.4 else f"u{r.randint(0, 300)}"
        row = (user, float(r.randint(0, 40) * 1800 + r.choice([0, 10, 20])), f"e{i}", r.choice(["a", "b", "c", None]), r.choice([None, 1.5, -2.0]), "clash", 1)
        data += [row] * (2 if r.random() < 0.2 else 1)
    data += [(None, 1.0, "x", "a", 1.0, "c", 1), ("u1", None, "y", "a", 1.0, "c", 1), ("u2", 5.0, None, "b", 1.0, "c", 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {x.entity: x for x in feature_table(spark.createDataFrame(data, FIELDS).repartition(3), events(), hot).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(data)
    assert got.keys() == want.keys()
    for user, w in want.items():
        g = got[user]
        assert (g.event_count, g.first_time, g.last_time, g.active_hours, g.max_events_per_hour, g.night_activity_ratio, g.amount_total, g.amount_min, g.n_a, g.last_a) == pytest.approx(w), user


def test_entity_features_with_hundreds_of_types(spark):
    """Sparse counters of 300 types, batches and blocks far smaller than an entity."""
    r = random.Random(11)
    types = tuple(f"k{i}" for i in range(300))
    data = [(f"u{r.randint(0, 40)}", float(r.randint(0, 10**6)), f"e{i}", f"k{int(r.expovariate(0.02)) % 310}", float(r.randint(0, 9)), "", 1) for i in range(6000)]
    spec = Events(F.col("user"), F.col("t"), F.col("id"), F.col("kind"), F.col("amount"), types)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {x.entity: x for x in partial_rows(spark.createDataFrame(data, FIELDS).repartition(3), spec).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for user in {d[0] for d in data}:
        mine = [d for d in data if d[0] == user]
        n = [sum(d[3] == k for d in mine) for k in types]
        assert list(got[user].type_n) == n and got[user].k == len(mine)
        assert list(got[user].type_sum) == [sum(d[4] for d in mine if d[3] == k) for k in types]
        assert [x for x, c in zip(got[user].type_last, n, strict=True) if c] == [max(d[1] for d in mine if d[3] == k) for k, c in zip(types, n, strict=True) if c]


def test_entity_features_empty(spark):
    assert feature_table(spark.createDataFrame([], FIELDS), events()).count() == 0
    assert partial_rows(spark.createDataFrame([("u", 1.0, "i", None, None, "", 0)], FIELDS), events()).count() == 1


def test_components(spark):
    r = random.Random(5)
    links = [(f"v{r.randint(0, 200)}", f"v{r.randint(0, 200)}") for _ in range(120)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(90)] + [(None, "v1"), ("z", "z")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = dict(rows(components.components(spark.createDataFrame(links, "a string, b string"), "a", "b")))
    assert got == {v: find(v) for v in parent}


def test_co_targets_cap_and_ties(spark):
    e = spark.createDataFrame([(s, t, 1.0) for s in "abc" for t in ("x", "y")] + [("d", "x", 1.0)], "source string, target string, w double")
    p = graph.Projection(0.1, 1, 2, 200)
    assert rows(graph.co_targets(e, "w", p)) == [("a", "b", 2, 1.0), ("a", "c", 2, 1.0)]
    assert graph.co_targets(e.where("false"), "w", p).count() == 0
    assert rows(graph.co_targets(e, "w", graph.Projection(0.1, 0, 2, 2)).select("a", "b")) == [("a", "b")]


def test_tiers(spark):
    t = spark.createDataFrame([(0.2, 0.0, 0.0, 0.0), (0.0, 0.9, 0.0, 0.3), (0.1, 0.0, 0.5, 0.0), (0.0, 0.0, 0.5, 0.0), (0.0, 0.9, 0.0, 0.0), (0.0, 0.0, 0.0, 0.3), (0.0, 0.0, 0.0, 0.0)], "co_negative double, tag double, trigger double, co_target double")
    n, why = expansion.tier(expansion.Tiers())
    assert [r[0] for r in t.select(n).collect()] == [1, 2, 3, 99, 99, 99, 99]
    assert t.select(why).collect()[4][0] == "support_only_tag"


def test_pair_timing_and_labels(spark):
    c = spark.createDataFrame([("1", "a", "p", 0.0), ("2", "b", "p", 300.0), ("3", "b", "p", 1801.0), ("4", "a", "q", 0.0), ("5", "c", "q", 9000.0)], "comment_id string, source string, post_id string, ts double")
    p = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "a string, b string")
    got = {(r.a, r.b): r for r in temporal.labelled(temporal.pair_timing(p, c, temporal.Windows())).collect()}
    assert (got["a", "b"].within_strong, got["a", "b"].within_moderate, got["a", "b"].label, got["a", "b"].confidence) == (1, 1, "strong_temporal_sync", "fragile_single_event")
    assert (got["a", "c"].label, got["a", "c"].confidence, got["b", "c"].confidence) == ("weak_temporal_overlap", "weak_context", "none")


def test_spearman_and_overlap(spark):
    d = spark.createDataFrame([(i, float(i), float(-i)) for i in range(50)] + [(99, None, 1.0)], "id int, x double, y double")
    assert evaluation.spearman(d, "x", "y").first().rho == -1.0
    assert rows(evaluation.top_overlap(d, "id", "x", "x", (5, 10))) == [(5, 5, 1.0), (10, 10, 1.0)]


def test_random_pairs_repeat(spark):
    a = spark.createDataFrame([(f"u{i}",) for i in range(40)], "u string")
    one, two = rows(discovery.random_pairs(a, "u", 300)), rows(discovery.random_pairs(a.repartition(3), "u", 300))
    assert one == two and len(one) == len(set(one)) > 200 and all(x < y for x, y in one)
    assert len(rows(discovery.random_pairs(a, "u", 20))) == 20 and discovery.random_pairs(a.limit(1), "u", 5).count() == 0


def test_matched_pairs_keep_the_bins(spark):
    n = spark.createDataFrame([(f"u{i:02}", 2 if i < 10 else 7 if i < 20 else 200) for i in range(30)], "account string, n long")
    pool = n.where("account like '%5' or account like '%6' or account like '%7'").where("account < 'u20'")
    got = rows(discovery.matched_pairs(spark.createDataFrame([("u01", "u11"), ("u02", "u12"), ("u03", "u29"), ("u04", "nobody")], "a string, b string"), n, pool))
    names = {r.account for r in pool.collect()}
    assert 2 <= len(got) <= 4 and all(a in names and b in names and a != b for a, b in got)
    assert discovery.matched_pairs(spark.createDataFrame([], "a string, b string"), n, pool).count() == 0


def test_groups_are_ranked_by_all_keys(spark):
    g = spark.createDataFrame([("s1", 1, None), ("s2", 2, 0), ("s3", 1, 5), ("s4", 1, 5)], "seed string, x int, y int")
    assert [r.seed for r in discovery.ranked_groups(g, ["x", "y"], "seed").orderBy("group_rank").collect()] == ["s2", "s3", "s4", "s1"]
    r = ranking.descending_rank(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None), ("e", float("nan")), ("f", 0.0)], "k string, v double"), "v", "r")
    assert {x.k: x.r for x in r.collect()} == {"b": 1, "c": 1, "a": 3, "f": 4, "d": None, "e": None}


def test_tier_ablation(spark):
    m = spark.createDataFrame([("s", "a", 1), ("s", "b", 4), ("s", "c", 2), ("t", "a", 4)], "seed string, candidate string, tier int")
    p = spark.createDataFrame([("s", "a", "b", "strong_temporal_sync", "robust"), ("s", "a", "c", "moderate_temporal_sync", "none"), ("s", "a", "x", "none", "none")], "seed string, a string, b string, label string, confidence string")
    got = {r.setting: tuple(r)[1:] for r in discovery.tier_ablation(discovery.with_tiers(p, m), m).collect()}
    assert got == {"with_tier4": (4, 3, 3, 1, 1, 1), "without_tier4": (2, 2, 2, 0, 1, 0), "tier4_only": (2, 2, 1, 1, 0, 1)}


def test_exact_quantiles(spark):
    r = random.Random(7)
    data = [(r.choice("ab"), r.choice([None, *map(float, range(40))])) for _ in range(400)]
    df = spark.createDataFrame(data, "k string, v double")
    import numpy as np

    got = {x.k: (x.q1, x.q9) for x in ranking.quantiles(df, ["k"], "v", {"q1": 0.1, "q9": 0.93}).collect()}
    for k in "ab":
        assert got[k] == pytest.approx(tuple(np.quantile([v for a, v in data if a == k and v is not None], [0.1, 0.93])))
    assert ranking.quantiles(df, [], "v", {"q": 0.5}).first().q == pytest.approx(np.median([v for _, v in data if v is not None]))
    assert ranking.quantiles(df.where("false"), [], "v", {"q": 0.5}).count() == 0


def test_functional_bots(spark):
    posts = [("bot", f"p{i}", float(i), "daily thread", f"the same text again and again number {i}") for i in range(12)] + [("human", f"h{i}", float(i), f"title {i}", "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(60))) for i in range(6)] + [("few", "f1", 1.0, "daily thread", "the same text")]
    got = cleaning.functional_bots(spark.createDataFrame(posts, "author string, post_id string, ts double, title string, selftext string")).collect()
    assert [(r.author, r.posts, r.compared) for r in got] == [("bot", 12, 10)]
