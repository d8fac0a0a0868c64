"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows are range-partitioned by id; each partition's total gives the bytes before it, a running sum
inside the partition gives the bytes before each row, and the row goes to the shard in which the
middle of its bytes falls when all bytes are cut at equal targets. Only ids, sizes and checksums are
shuffled, never a text. Built-in functions only.

Defined results: a null text has size 1 (no bytes, plus 1) and the checksum of nothing; null ids come
first; rows with equal ids stay next to each other, in any order; an empty table gives an empty
result; extra columns are ignored. A row larger than a shard's target leaves that shard, and
perhaps its neighbours, uneven: rows are never split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantabile.llm.common import checkpoint, table

N_SHARDS = 16


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def byte_shards(rows: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", size_col: str = "size") -> DataFrame:
    """Adds shard (0 to n_shards - 1, non-decreasing in id order) and slot (0, 1, ... inside the shard)."""
    ordered = rows.withColumn("_tie", F.monotonically_increasing_id())
    # the row number breaks ties, so an id that many rows share still spreads over partitions
    dealt = checkpoint(ordered.repartitionByRange(F.col(id_col), F.col("_tie")).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.sum(size_col).alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row for each partition, so the bound on what is broadcast is the number of partitions
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(every).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(id_col, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.withColumn("_sum", F.sum(size_col).over(inside))
        .withColumn("_nth", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn("_row", F.col("_rows_before") + F.col("_nth") - 1)
        # twice the middle of the row's bytes, so that whole numbers suffice
        .withColumn("_middle", 2 * (F.col("_bytes_before") + F.col("_sum")) - F.col(size_col))
        .withColumn("shard", F.expr(f"cast(_middle * {n_shards} div (2 * _all) as int)"))
    )
    placed = checkpoint(placed.drop("_part", "_sum", "_nth", "_bytes_before", "_rows_before", "_all", "_middle", "_tie"))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # at most n_shards rows
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_row") - F.col("_first")).drop("_row", "_first")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_shards(sized(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
