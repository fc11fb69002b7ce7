"""Results are whole: nothing that the job asks for is cut off."""

import inspect
import os
from itertools import combinations

import pytest

from tests.oracle import compare, duck
from weftline.operators import behaviour, expansion, temporal
from weftline.plans import accounts, extras, pipeline

FOLDER = os.environ.get("WEFTLINE_DATA", "/root/testdata/sf0.001")
with_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def write(df, tmp_path, name):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")


def test_member_pairs_keep_all_included_members(spark, tmp_path):
    names = [f"m{i:03}" for i in range(70)]
    rows = [("s", x, True) for x in names] + [("s", "m000", True), ("s", "out", False), ("t", "m001", True), ("t", "m002", True)]
    write(spark.createDataFrame(rows, "seed string, candidate string, include boolean"), tmp_path, "expansion_members")
    scored = [(x, *[0.5] * 6) for x in names[:60]]  # ten members have no score
    write(spark.createDataFrame(scored, "user_id string, " + ", ".join(f"{c} double" for c in (*accounts.SIGNALS, "mca_score_primary", "mca_score_alt"))), tmp_path, "mca_scores")
    got = sorted((r.seed, r.a, r.b) for r in accounts.member_pairs(spark, str(tmp_path)).collect())
    assert got == [("s", a, b) for a, b in combinations(names, 2)] + [("t", "m001", "m002")]


@pytest.mark.parametrize("block", [1, 7, 256])
def test_group_pairs_blocks_agree(spark, block):
    m = spark.createDataFrame([(g, f"x{i:02}") for g, n in (("g", 40), ("h", 3), ("i", 1)) for i in range(n)], "g string, x string")
    got = sorted(map(tuple, temporal.group_pairs(m, "g", "x", block).collect()))
    assert got == [(g, f"x{a:02}", f"x{b:02}") for g, n in (("g", 40), ("h", 3)) for a, b in combinations(range(n), 2)]


def test_group_timing_has_every_pair(spark):
    m = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c"), ("h", "a"), ("h", "b")], "seed string, candidate string")
    c = spark.createDataFrame([("c1", "a", "p", 0), ("c2", "b", "p", 60)], "comment_id string, source string, post_id string, ts long")
    got = {(r.seed, r.a, r.b): r.label for r in temporal.group_timing(m, "seed", "candidate", c, temporal.Windows()).collect()}
    strong, none = "strong_temporal_sync", "no_temporal_sync"
    assert got == {("g", "a", "b"): strong, ("h", "a", "b"): strong, ("g", "a", "c"): none, ("g", "b", "c"): none}


def test_pipeline_times_its_own_expansion():
    assert pipeline.BACK["pair_timing"] is accounts.expansion_timing


@with_data
@pytest.mark.parametrize("name", ["tiered_expansion", "induced_edges", "shared_with_seed"])
def test_expansion_uses_the_tag_layer(spark, name):
    con, sql = duck(FOLDER), accounts.oracle_sql()[name]
    said = compare(spark, con, FOLDER, name, accounts.QUERIES[name], sql)
    assert said.startswith("ok"), said
    if name == "tiered_expansion":
        assert con.execute(f"select count(*) from ({sql}) where tag > 0").fetchone()[0]


@with_data
def test_account_signals_have_all_three_manipulative_terms(spark):
    con, sql = duck(FOLDER), accounts.oracle_sql()["account_signals"]
    said = compare(spark, con, FOLDER, "account_signals", accounts.QUERIES["account_signals"], sql)
    assert said.startswith("ok"), said
    assert con.execute(f"select max(manipulative) from ({sql})").fetchone()[0] > 0.25


def test_expansion_keeps_a_hundred_members(spark):
    empty = spark.createDataFrame([], "me string, other string, w double")
    near = spark.createDataFrame([("s", f"x{i:03}", 0.5) for i in range(120)], "me string, other string, w double")
    layers = {"co_negative": near, "co_target": empty, "tag": empty, "trigger": empty}
    got = sorted(r.candidate for r in expansion.expand(spark.createDataFrame([("s",)], "seed string"), layers, accounts.TIERS).collect())
    assert got == ["s", *[f"x{i:03}" for i in range(99)]]


def test_post_clusters_see_tags_and_words(spark):
    p = spark.createDataFrame([("p1", 3, "buy now"), ("p2", 0, "red fox"), ("p3", 0, "old dog"), ("p4", 0, None)], "post_id string, num_comments long, analysis_text string")
    c = spark.createDataFrame([("p1", 40.0, "mixed"), ("p1", -20.0, "neutral")], "post_id string, score double, label string")
    rows = {r.post_id: r for r in extras.cluster_features(p, c).collect()}
    assert len(extras.NUMERIC) == 32 and len(extras.TEXT) == 64
    one = rows["p1"]
    assert (one.tag_urgency, one.tag_call_to_action, one.tag_fear, one.rhetoric_score, one.num_comments, one.chars) == (1.0, 1.0, 0.0, 25.0, 3.0, 7.0)
    assert (one.min_score, one.max_score, one.ratio_mixed, one.ratio_neutral) == (-20.0, 40.0, 0.5, 0.5)
    assert [rows["p2"][x] for x in extras.NUMERIC] == [rows["p3"][x] for x in extras.NUMERIC]  # they differ only in their words
    assert [rows["p2"][x] for x in extras.TEXT] != [rows["p3"][x] for x in extras.TEXT] and not any(rows["p4"][x] for x in extras.TEXT)


def test_kmeans_uses_plain_columns(spark):
    f = spark.createDataFrame([(f"u{i}", 1.0, float(i % 2)) for i in range(20)], "user_id string, same double, t double")
    got = {r.user_id: r.cluster for r in behaviour.kmeans(f, ["same"], k=2, seed=1, plain=["t"]).collect()}
    assert len({got[f"u{i}"] for i in range(0, 20, 2)}) == 1


@with_data
@pytest.mark.parametrize(("name", "length"), [("top_accounts", "limit 100"), ("seed_neighbours", "<= 15"), ("trigger_neighbours", "<= 15")])
def test_reports_have_the_reference_length(spark, name, length):
    folder = FOLDER if name != "seed_neighbours" else FOLDER.replace("sf0.001", "sf0.01")  # no seed has more than 10 on the smallest
    con, sql = duck(folder), accounts.oracle_sql()[name]
    assert length in sql
    said = compare(spark, con, folder, name, accounts.QUERIES[name], sql)
    assert said.startswith("ok"), said


def test_top_accounts_ranks_a_hundred(spark, tmp_path):
    rows = [(f"u{i:03}", *[i / 200] * 6) for i in range(130)]
    write(spark.createDataFrame(rows, "user_id string, " + ", ".join(f"{c} double" for c in (*accounts.SIGNALS, "mca_score_primary", "mca_score_alt"))), tmp_path, "mca_scores")
    assert sorted(r.place for r in accounts.QUERIES["top_accounts"](spark, str(tmp_path)).collect()) == list(range(1, 101))


def test_group_pairs_send_few_rows(spark):
    """A group of 3,000 was sent 12 times over before, once for each block of 256."""
    m = spark.createDataFrame([("g", f"x{i:04}") for i in range(3000)], "g string, x string")
    plan = temporal.group_pairs(m, "g", "x")
    assert plan.count() == 3000 * 2999 // 2 and plan.distinct().count() == 3000 * 2999 // 2
    assert inspect.signature(temporal.group_pairs).parameters["block"].default >= 2048
