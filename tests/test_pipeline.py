"""The staged run, work ranges, summaries."""

import json
import os

import pytest
from pyspark.sql import functions as F

from weftline.operators import rollup
from weftline.plans import pipeline

FOLDER = os.environ.get("WEFTLINE_DATA", "/root/testdata/sf0.001")


def test_row_ranges():
    assert pipeline.row_ranges(10, 21, 3) == [(10, 14), (14, 18), (18, 21)]
    assert pipeline.row_ranges(0, 2, 5) == [(0, 1), (1, 2)]
    assert pipeline.row_ranges(5, 5, 2) == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_staged_run(spark, tmp_path):
    stages = {k: pipeline.FRONT[k] for k in ("posts", "edges", "co_target")}
    counts = pipeline.run(spark, FOLDER, str(tmp_path), stages)
    assert set(counts) == set(stages) and counts["edges"] > 0
    assert json.loads(spark.read.text(f"{tmp_path}/summary").first()[0]) == counts
    assert pipeline.run(spark, FOLDER, str(tmp_path), stages) == counts  # a rerun overwrites


def test_matched_accounts(spark):
    pool = spark.createDataFrame([(f"u{i:02}", i % 2) for i in range(20)], "account string, bin int")
    cand = pool.where(F.col("account").isin("u00", "u01", "u02"))
    got = rollup.matched(cand, pool, "account", "bin", 1).collect()
    assert len(got) == 3 and len({r.match for r in got}) == 3
    assert all(int(r.match[1:]) % 2 == r.bin and r.match not in ("u00", "u01", "u02") for r in got)
    assert [r.match for r in rollup.matched(cand, cand, "account", "bin", 1).collect()] == [None] * 3


def test_pair_summary_and_names(spark):
    p = spark.createDataFrame([("a", "b", 1, 0, 1, 5.0, "x"), ("a", "c", 0, 0, 0, None, "x")], "a string, b string, same_posts long, within_strong long, within_moderate long, median_delay double, label string")
    r = rollup.pair_summary(p, ["label"]).first()
    assert (r.pairs, r.accounts, r.same_post_rate, r.strong_rate, r.moderate_rate, r.mean_median_delay) == (2, 3, 0.5, 0.0, 0.5, 5.0)
    assert rollup.pair_summary(p.where("false"), []).first().pairs == 0
    m = spark.createDataFrame([("g", f"m{i:02}", float(i)) for i in range(15)], "g string, m string, s double")
    assert rollup.first_names(m, "g", "m", [F.desc("s")]).first().names == ", ".join(f"m{i:02}" for i in range(14, 2, -1))


def test_parallel_steps_collect_failures(spark, tmp_path):
    assert pipeline.run_parallel({"a": lambda: 1, "b": lambda: 2}) == {"a": 1, "b": 2}
    done = []
    with pytest.raises(RuntimeError, match="bad .ZeroDivisionError"):
        pipeline.run_parallel({"bad": lambda: 1 / 0, "good": lambda: done.append(1)}, 1)
    assert done == [1]
    df = spark.createDataFrame([(i,) for i in range(11)], "id int")
    steps = pipeline.scoring_steps(df, ["id"], lambda d: d.withColumn("score", F.col("id") + 1), str(tmp_path / "s"), 2, 9, 3)
    assert list(steps) == ["[2, 5)", "[5, 7)", "[7, 9)"]
    pipeline.run_parallel(steps)
    assert sorted((r.id, r.score) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [(i, i + 1) for i in range(2, 9)]
