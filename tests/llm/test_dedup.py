"""Exact dedup, line dedup, Jaccard join and shards against brute force, with nulls, ties, repeated rows and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from cantabile.llm import exact_dedup, jaccard_join, line_dedup, sharding
from cantabile.llm.components import components
from tests.llm import brute
from tests.llm.conftest import passage


def tuples(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_exact_groups(clashing, cases):
    got = exact_dedup.exact_groups(clashing, hash_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(tuples(got, "doc_id")) == brute.exact_groups(cases)


def test_exact_groups_hash_only_survivors(docs, cases):
    hashed = {r.doc_id for r in exact_dedup.exact_groups(docs).where("text_sha256 is not null").collect()}
    copies = {i for i, _, n, _, _ in brute.exact_groups(cases) if n > 1}
    assert copies <= hashed and 65 not in hashed


def test_exact_groups_are_the_same_beyond_a_broadcast(clashing, monkeypatch):
    few = sorted(map(tuple, exact_dedup.exact_groups(clashing).collect()), key=repr)
    monkeypatch.setattr(exact_dedup, "is_small", lambda df: False)
    assert sorted(map(tuple, exact_dedup.exact_groups(clashing).collect()), key=repr) == few and any(r[-1] is None for r in few)


def test_exact_groups_of_repeated_rows_and_null_ids(spark, nothing):
    rows = spark.createDataFrame([(1, "same"), (1, "same"), (None, "same"), (None, None), (2, "")], "doc_id long, text string")
    got = exact_dedup.exact_groups(rows).collect()
    assert len(got) == 5
    assert sum(r.kept for r in got if r.group_size == 3) == 1 and {r.keep_id for r in got if r.group_size == 3} == {1}
    assert [(r.doc_id, r.kept) for r in got if r.group_size == 2 and r.kept] == [(2, True)]
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_line_dedup(clashing, cases):
    want = brute.line_dedup(cases)
    got = line_dedup.dedup_lines(clashing)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()} == want
    assert set(got.columns) == set(clashing.columns)


def test_line_dedup_of_repeated_rows_and_null_ids(spark, nothing):
    line = "the very same line"
    rows = spark.createDataFrame([(None, line), (1, line), (1, line), (2, f"{line}\nown\n{line} ")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text) for r in line_dedup.dedup_lines(rows).collect())
    assert got == [(0, line), (1, ""), (1, ""), (2, "own")]
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_jaccard_components(clashing, cases):
    got = jaccard_join.similar_components(clashing).select("doc_id", "n_shingles", "component_id")
    assert tuples(got, "doc_id") == brute.components(cases)


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_components_of_families(spark, seed):
    """Families of texts that differ by insertions, deletions and a shared frame, many of them near the threshold."""
    rng = random.Random(seed)
    frame = passage(rng, 40)
    docs, i = [], 0
    for _ in range(12):
        base = passage(rng, rng.randrange(8, 90)).split()
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [rng.choice(["one", "two", "three"])] * rng.randrange(2)
            docs.append((i, " ".join(words) + (" " + frame if rng.random() < 0.3 else "")))
            i += 1
    got = jaccard_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert tuples(got.select("doc_id", "n_shingles", "component_id"), "doc_id") == brute.components(docs)


def test_jaccard_repeated_rows_null_ids_and_nothing(spark, nothing):
    text = "one two three four five six seven"
    rows = spark.createDataFrame([(5, text), (5, text), (None, text), (7, None), (7, text.upper()), (None, "alone here")], "doc_id long, text string")
    got = jaccard_join.similar_components(rows).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.n_shingles == 3) == [(0, 3, 5), (5, 3, 5), (5, 3, 5), (7, 3, 5)]
    assert [(r.doc_id, r.component_id) for r in got if r.n_shingles == 1] == [(None, None)]
    assert [(r.doc_id, r.component_id) for r in got if r.n_shingles == 0] == [(7, 7)]
    assert jaccard_join.similar_components(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(edges.union(edges)).collect()
    assert sorted((r.node, r.root) for r in got) == [(i, 0) for i in range(n)]


def test_shards(clashing, cases, nothing, spark):
    got = sharding.byte_shards(sharding.sized(clashing)).select("doc_id", "size", "text_crc32", "shard", "slot")
    assert tuples(got, "doc_id") == brute.byte_shards(cases)
    assert sharding.byte_shards(sharding.sized(nothing)).count() == 0
    nulls = spark.createDataFrame([(None, "abc")] * 6 + [(1, "abc"), (0, None)], "doc_id long, text string")
    got = [(r.doc_id, r.size, r.shard) for r in sharding.byte_shards(sharding.sized(nulls), 2).orderBy("shard", "slot").collect()]
    assert [i for i, _, _ in got] == [None] * 6 + [0, 1] and [s for _, s, _ in got] == [4] * 6 + [1, 4]
    same = spark.range(1000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("abc").alias("text"))
    counts = sharding.byte_shards(sharding.sized(same), 8).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert sorted((r.shard, r.n, r.last) for r in counts) == [(s, 125, 124) for s in range(8)]


@pytest.mark.parametrize("seed", range(3))
def test_links_between_components_by_blocks_and_derived_answers(spark, seed, monkeypatch):
    """Families around the threshold without hub rounds: all further links must come from block pairs and hubs' answers."""
    monkeypatch.setattr(jaccard_join, "TURNS", 0)
    candidates, asked = [], []
    across, derived = jaccard_join.SetJoin.across, jaccard_join.SetJoin.derived

    def counted(self, *x):
        out = across(self, *x)
        candidates.append(out.count())  # its table is deleted later
        return out

    monkeypatch.setattr(jaccard_join.SetJoin, "across", counted)
    monkeypatch.setattr(jaccard_join.SetJoin, "derived", lambda self, *x: asked.append(1) or derived(self, *x))
    rng = random.Random(seed)
    docs = []
    for family in range(3):
        base = passage(rng, 200).split()
        for branch in range(6):  # branches differ by a few places, their copies by one more
            trunk = list(base)
            for at in range(branch * 9, branch * 9 + 2 + branch % 3):
                trunk[at * 3 % 200] = f"b{family}x{branch}y{at}"
            for copy in range(4):
                words = list(trunk)
                if copy:
                    words[rng.randrange(200)] = f"c{family}x{branch}y{copy}"
                docs.append((len(docs), " ".join(words)))
    got = jaccard_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).select("doc_id", "n_shingles", "component_id")
    assert sorted(tuples(got, "doc_id")) == brute.components(docs)
    assert asked and candidates[0] > 0
