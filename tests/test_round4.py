"""What the fourth review found: each test failed before its fix."""

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from cantabile.functions.text import word_units
from cantabile.operators import passes, rescue
from cantabile.plans.catalogue import QUERIES


def test_tempo_on_half_a_billionth_is_rounded_as_sql_rounds_it(spark):
    """323, 1287 and 1297 ms over 5.12 units are half a billionth past a whole one, and a little less when a billion times as much."""
    spans = [323, 1287, 1297, 2200]
    rows = [(0, i, k, k * 100, s if k else 90, 0.9, "aligned", 2.56) for i, s in enumerate(spans) for k in (0, 1)]
    words = spark.createDataFrame(rows, "track_id long, line_idx long, word_idx long, start_ms long, end_ms long, conf double, origin string, units double")
    have = {r.line_idx: r.tempo for r in rescue.line_tempo(words).collect()}
    want = dict(duckdb.sql(f"SELECT i, round(CASE WHEN v BETWEEN 0.018 AND 0.42 THEN v END, 9) FROM (SELECT i, s / 1000 / 5.12::DOUBLE AS v FROM (VALUES {', '.join(map(str, enumerate(spans)))}) t(i, s))").fetchall())
    assert have == want and want[3] is None


def test_units_are_the_double_next_to_their_decimals(spark):
    words = ["aeioul", "mae", "x", "", "lamour"]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(word_units(F.col("w"))).collect()]
    assert got == [5.72, 2.72, 1.0, 1.0, 5.16]


def repeated(spark, path, times):
    """Events of sf0.01, each `times` times under ids of their own in the track it came from."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    many = events.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("event_id", F.col("event_id") + F.col("_r") * 10_000_000).drop("_r")
    many.coalesce(1).write.parquet(f"{path}/events.parquet")


@pytest.mark.parametrize("name", ["H16_reconstruct", "F11_tempo_prior"])
def test_words_set_anew_on_half_a_millisecond_equal_the_sql(spark, tmp_path, name):
    """Lines of equal words share their room into equal parts, many of which end on a half."""
    repeated(spark, tmp_path, 6)
    have = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=str)
    with duckdb.connect() as c:
        c.execute("SET threads = 1")
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = sorted(c.execute(oracle_sql()[name]).fetchall(), key=str)
    assert len(have) == len(want) and have == want


def test_words_of_candidates_are_joined_once(spark):
    """What a word set anew is called goes with it; it isn't looked up in a second copy of all that leads to it."""
    words = "array<struct<word_idx:int,word:string,normalized:string,start_ms:bigint,end_ms:bigint,conf:double,origin:string>>"
    kinds = f"track_id long, line_idx long, pass_idx int, words {words}, start_ms long, end_ms long, next_anchor_ms long, lookahead_ms long, conf double, score double, anchor_delta_ms long, lead_ms long, gap_ms long"
    lines = [(0, 0, i, [(k, f"w{k}", f"w{k}", 1000 * k + 30 * i, 1000 * k + 400, 0.5 + 0.1 * i, "aligned") for k in range(3)], 0, 2400, 3000, None, 0.5, 0.5, 0, 500, None) for i in (0, 1)]
    priors = spark.createDataFrame([(0, 0, 0.1)], "track_id long, line_idx long, prior double")
    out = passes.merged(spark.createDataFrame(lines, kinds), priors)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("adaptive_consensus") and sum("Generate explode" in line for line in plan.splitlines()) == 2
    assert [w.word for w in out.first().words] == ["w0", "w1", "w2"]
