"""Long groups cut into stretches, and totals carried over a whole table: equal to the plain recurrences."""

import random

import pytest
from pyspark.sql import functions as F

from cantabile.operators import cache, ordered


def clamped(rows, step=1, missing=False):
    out, last = {}, {}
    for key, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if v is None and missing:
            now, moved = (last[key] + step if key in last else 0), False
        else:
            now, moved = max(0, v or 0), False
            if key in last and now < last[key]:
                now, moved = last[key] + step, True
        last[key] = now
        out[key, i] = (now, moved)
    return out


@pytest.mark.parametrize(("stretch", "step", "missing"), [(1, 1, False), (3, 1, True), (7, 5, True), (64, 1, False), (10_000, 2, True)])
def test_stretches_are_the_recurrence(spark, stretch, step, missing):
    rng = random.Random(stretch)
    rows = []
    for key, n, rise in ((1, 300, 0), (2, 40, 9), (3, 1, 0), (None, 120, 1), (5, 200, 3)):
        for i in range(n):
            # falls that last for several stretches, and nulls at the edges of some
            v = rng.choice([i * rise + rng.randrange(60), 5, None if rng.random() < 0.7 else 900])
            rows.append((key, i, v))
    df = spark.createDataFrame(rows, "t long, i long, v long").repartition(5)
    got = {(r.t, r.i): (r.v, r.moved) for r in ordered.strict_clamp(df, ["t"], "i", "v", step=step, missing=missing, stretch=stretch).collect()}
    assert got == clamped(rows, step, missing)


def test_stretches_keep_their_state_over_batches(spark):
    rows = [(k, i, (i * 7919 + k * 31) % 997 - 40) for k in range(2) for i in range(2000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = spark.createDataFrame(rows, "t long, i long, v long")
        got = {(r.t, r.i): (r.v, r.moved) for r in ordered.strict_clamp(df, ["t"], "i", "v", stretch=100).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == clamped(rows)


def test_a_long_track_is_spread_and_shuffled_once(spark, tmp_path):
    spark.range(20_000).selectExpr("1L as t", "id as i", "id * 7919 % 9973 as v", "repeat('x', 20) as word").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows would fit one task
    try:
        out = ordered.strict_clamp(df, ["t"], "i", "v", keep=["word"], stretch=500)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(out.collect()) == 20_000
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 20_000 / 2
    assert "ReusedExchange" in plan


def test_empty_tables(spark):
    none = spark.createDataFrame([], "t long, i long, v long")
    assert ordered.strict_clamp(none, ["t"], "i", "v", stretch=4).collect() == []
    assert ordered.sum_before(none, ["i"], "v", "s").collect() == []


def test_sum_before_is_the_running_sum(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(5), i, rng.choice([None, *range(9)])) for i in range(500)]
    got = {(r.a, r.b): r.s for r in ordered.sum_before(spark.createDataFrame(rows, "a long, b long, v long").repartition(6), ["a", "b"], "v", "s").collect()}
    total = 0
    for a, b, v in sorted(rows, key=lambda r: r[:2]):
        assert got[a, b] == total
        total += v or 0


@pytest.mark.parametrize("limit", [0, 700, 2_000, 10**9])
def test_eviction_with_one_access_time_for_most_rows(spark, limit):
    rng = random.Random(limit)
    rows = [(f"{i:04d}", "p", rng.choice([None, 0, 3, 11]), 1, rng.choice([7, 7, 7, 7, 1, None, 10**15]), 1) for i in range(400)]
    kind = "cache_key string, payload string, byte_size long, created_at long, last_access long, schema_version long"
    got = {r.cache_key for r in cache.evict(spark.createDataFrame(rows, kind), limit).collect()}
    left, total = set(), sum(r[2] or 0 for r in rows)
    size = total
    for r in sorted(rows, key=lambda r: (r[4] is not None, r[4] or 0, r[0])):
        if not (total > limit and size > 0.85 * limit):
            left.add(r[0])
        else:
            size -= r[2] or 0
    assert got == left
