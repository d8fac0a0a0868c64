"""What the fourth review found of the corpus operators."""

import random

from pyspark.sql import functions as F

from cantabile.llm import hard_negatives
from tests.llm.test_mining import VECTORS, best_negatives, mined


def test_blocks_that_meet_are_never_broadcast(spark):
    """The files of the anchors' blocks are small, but each block is there once for each block of rows it meets."""
    df = spark.createDataFrame([(i, [0.5, 1.0 * i], i % 3, 0, 0, 0) for i in range(200)], VECTORS)
    known = hard_negatives.quantised(df, "vec_id", "embedding", F.col("label"), 256).withColumn("row", F.col("id"))
    blocks = hard_negatives.packed(known, F.col("row") % 4, 1).cache()
    blocks.count()
    plan = hard_negatives.partial_tiles(blocks, blocks, range(4), 4, 1, 8)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rounds_of_anchors_give_what_one_round_gives(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1e5) if i % 5 else 1.0 for _ in range(4)], i % 3) for i in range(700)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], VECTORS)
    assert mined(df, sizes=(90, 4, 2, 3), pairs=1) == mined(df, sizes=(90, 4, 2, 3)) == best_negatives(rows)


def test_partial_scores_are_kept_narrow(spark):
    """A tile whose sums fit is sent in 32 bits, one whose sums don't in 64."""
    df = spark.createDataFrame([(i, [0.5, 2.0**20 if i == 3 else 1.0], 0, 0, 0, 0) for i in range(8)], VECTORS)
    known = hard_negatives.quantised(df, "vec_id", "embedding", F.col("label"), 256).withColumn("row", F.col("id"))
    blocks = hard_negatives.packed(known, F.lit(0), 1)
    sizes = sorted(len(r.scores) for r in hard_negatives.partial_tiles(blocks, blocks, range(1), 1, 1, 8).collect())
    assert sizes == [4 * 64, 8 * 64]
