"""Every query of the catalogue against its SQL in DuckDB, and those without SQL against small brute-force versions."""

import math

import duckdb
import pytest

from cantabile.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages conversations labels benchmark".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(df.select(names).collect()) == ordered(got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == {
        "C11_rescue_reasons", "C13_weak_pass", "D6_matrix_run", "F0_repair_lines", "G2_full_match", "G2_topk_similarity", "H3_ctc", "H5_word_spans", "H6_lookahead_used", "H9_line_alignment",
        "H13_boundary_pass", "H14_rescue_variants", "H16_energy_snap", "H18_pass_driver", "H19_sources", "J13_similarity", "J18_romanize", "P9_replay",
    }
