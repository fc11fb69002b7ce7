"""Sources, rhetoric stand-in, streaming windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.operators import discovery, providers, rhetoric
from weftline.sources import tables
from weftline.streaming import windows


def test_csv_round_trip_and_guards(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "quoted"\nline', "NA"), ("2", None, "x")], "id string, text string, name string")
    tables.write_csv(df, str(tmp_path / "t"), "gzip")
    back = tables.read_csv(spark, str(tmp_path / "t"), "id string, text string, name string", ["NA"], source_file=True)
    assert sorted((r.id, r.text, r.name) for r in back.collect()) == [("1", 'a "quoted"\nline', None), ("2", None, "x")]
    assert back.where(F.col("source_file").contains("/t/")).count() == 2
    with pytest.raises(ValueError, match="missing"):
        tables.require(df, ["id", "missing"])
    assert tables.ensure(df, "score", "double", 0.0).first().score == 0.0
    assert tables.ensure(df, "name", "int", 7).select("name").distinct().collect()[0][0] == 7
    assert tables.existing(df, ["id", "none"]).columns == ["id"]


def test_row_range_and_resume(spark):
    df = spark.createDataFrame([(i, f"x{i}") for i in range(30)], "id int, x string")
    assert sorted(r.id for r in tables.row_range(df, ["id"], 5, 9).collect()) == [5, 6, 7, 8]
    done = spark.createDataFrame([(1, "one"), (99, "gone")], "id int, label string")
    assert tables.pending(df, done, "id").count() == 29
    r = tables.resume(df, done, "id")
    assert r.count() == 30 and r.where("label = 'one'").count() == 1


def test_parsed_tags(spark):
    df = spark.createDataFrame([('```json\n["fear", "fear", "odd", "urgency"]\n```',), ("not json",), (None,)], "x string")
    assert [list(r[0]) for r in df.select(rhetoric.parsed_tags(F.col("x"))).collect()] == [["fear", "urgency"], [], []]


def test_tag_similarity_blocks_agree(spark):
    data = [(f"u{i:02}", f"p{i}-{k}", t) for i in range(25) for k, t in enumerate([["buy now! everyone", "they crash"], ["always buy!", "today they lose"], ["experts vote", "most sell now"]][i % 3])]
    f = rhetoric.rhetoric_features(rhetoric.scored(spark.createDataFrame(data, "author string, post_id string, analysis_text string"), "analysis_text"))
    whole, parts = (sorted(map(tuple, rhetoric.tag_similarity(f, top_k=3, block=b).collect())) for b in (1000, 1))
    assert whole == parts and whole


def test_streams_match_batches(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [(f"e{i}", f"u{i % 5}", t0 + dt.timedelta(minutes=7 * i)) for i in range(300)]
    spark.createDataFrame(rows, "event string, user string, ts timestamp").repartition(4).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("late", "u0", t0 + dt.timedelta(days=30))], "event string, user string, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event string, user string, ts timestamp").parquet(str(tmp_path / "in"))
    windows.append(windows.hourly_activity(stream, "user", "ts"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.user, r.hour): r.events for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.user, r.hour): r.events for r in windows.hourly_activity(spark.createDataFrame(rows, "event string, user string, ts timestamp"), "user", "ts").collect()}
    assert got == want
    windows.append(windows.distinct_events(stream, "event", "ts"), str(tmp_path / "out2"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 301


def test_layouts_and_batches(spark, tmp_path):
    a = spark.createDataFrame([("c1", "t3_p", "u", 1.0)], "comment_id string, link_id string, author string, created_utc double")
    assert tuple(tables.one_layout(a).first()) == ("c1", "p", "u", 1.0)
    assert tables.one_layout(a.withColumnRenamed("link_id", "post_id")).first().post_id == "t3_p"
    with pytest.raises(ValueError):
        tables.one_layout(a.drop("author"))
    for name, rows in (("b1", [("1", "old"), ("2", "x")]), ("b2", [("1", "new"), ("3", None)])):
        tables.write_csv(spark.createDataFrame(rows, "id string, label string").coalesce(1), str(tmp_path / name))
    got = tables.merge_batches(spark, [str(tmp_path / "b1"), str(tmp_path / "b2")], "id", "id string, label string").collect()
    assert sorted((r.id, r.label) for r in got) == [("1", "new"), ("2", "x"), ("3", None)]


def test_steps_are_saved_and_resumed(spark, tmp_path):
    df, path = spark.createDataFrame([(i,) for i in range(25)], "id int"), str(tmp_path / "saved")
    work = lambda d: d.withColumn("twice", F.col("id") * 2)
    assert tables.save_in_steps(df.where("id < 7"), path, "id", work, 4) == 2
    assert tables.save_in_steps(df, path, "id", work, 10) == 2 and tables.save_in_steps(df, path, "id", work, 10) == 0
    assert sorted((r.id, r.twice) for r in spark.read.parquet(path).collect()) == [(i, 2 * i) for i in range(25)]


def test_layers_and_summary_are_written(spark, tmp_path):
    rows = [("count", "a", "b", 1.0), ("signed", "a", "b", 0.0), ("signed", "a", "c", -2.0)]
    tables.write_layers(spark.createDataFrame(rows, "layer string, source string, target string, weight double"), str(tmp_path / "l"))
    assert sorted((r.layer, r.weight) for r in spark.read.parquet(str(tmp_path / "l")).collect()) == [("count", 1.0), ("signed", -2.0)]
    tables.write_json(spark.createDataFrame([(1, "x")], "n int, s string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().n == 1


def test_provider_retries():
    waits, said = [], iter([ValueError("1"), ValueError("2"), "done"])

    def call(text):
        x = next(said)
        if isinstance(x, Exception):
            raise x
        return x + text

    assert providers.retrying(call, 5, 30, waits.append)("!") == "done!" and waits == [1.0, 2.0]
    waits.clear()
    with pytest.raises(ZeroDivisionError):
        providers.retrying(lambda t: 1 / 0, 7, 30, waits.append)("x")
    assert waits == [1.0, 2.0, 4.0, 8.0, 16.0, 30.0]


def test_retrieved_context_reaches_the_provider(spark):
    q = spark.createDataFrame([(1, "fees rise on the exchange"), (2, None)], "id int, text string")
    c = spark.createDataFrame([("a", "exchange fees rise again"), ("b", "a wallet for the moon"), ("c", "")], "cid string, chunk string")
    found = providers.context(q, c, "id", "text", "cid", "chunk", 1)
    assert [(r.id, r.cid, r.place) for r in found.collect()] == [(1, "a", 1)]
    p = providers.with_context(q, found, c, "id", "text", "cid", "chunk")
    got = {r.id: r.response for r in providers.responses(p, "id", F.col("prompt"), lambda t: t.upper()).collect()}
    assert got == {1: "EXCHANGE FEES RISE AGAIN\n\nFEES RISE ON THE EXCHANGE", 2: ""}


def test_tone_and_stance(spark):
    df = spark.createDataFrame([("Yes, great",), ("this is WRONG",), ("good but bad",), ("hm",), (" ",), (None,)], "x string")
    assert [tuple(r) for r in df.select(providers.stance(F.col("x")), providers.tone(F.col("x"))).collect()] == [("supportive", 100), ("oppositional", -100), ("mixed", 0), ("neutral", 0), ("unclear", 0), ("unclear", 0)]


def test_cluster_suspicion(spark):
    cols = ["rhetoric_score", "high_manipulation", "tag_call_to_action", "tag_urgency", "tag_overconfidence", "tag_fear", "ratio_oppositional", "controversy"]
    df = spark.createDataFrame([(0, 5, *[1.0] * 8), (1, 9, *[0.0] * 8), (2, 3, *[1.0] * 8)], "cluster int, posts long, " + ", ".join(f"mean_{c} double" for c in cols))
    got = {r.cluster: (r.suspicion_score, r.suspicion_rank) for r in discovery.suspicion(df).collect()}
    assert got == {0: (82.55, 1), 2: (82.55, 2), 1: (0.0, 3)}
