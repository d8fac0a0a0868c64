"""Exact duplicates by progressive refinement: length, then a prefix hash, then a full hash.

One scan of the texts notes each row's length and the hash of its first characters. Rows alone in
their length, or in their length and prefix, are settled there. Only the rest are read whole and
hashed with SHA-256; where the prefixes that are still open are too many to broadcast, all rows are hashed in the scan, since that
costs less than a shuffle of whole texts, and the hashes of settled rows are dropped, so the result is the same. With hash_all one scan notes the full hash too, and length and prefix say which
rows are compared by it.

Texts are never shuffled. Groups are made by partial aggregation; what is joined back is written first, so it is broadcast if a count
proves it small, and beyond that joined by exchanges whose hot partitions Spark splits: a group that holds a third of all rows
does not meet in one task. Built-in functions only.

Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest id
stays. Defined results: a null text counts as empty; a null id is smaller than any other; of rows that
agree in text and id exactly one is kept; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantabile.llm.common import ascii_lower, checked_join, checkpoint, is_small, table

PREFIX = 64


def normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, hash_all: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept and text_sha256.

    text_sha256 is null for rows that length or prefix already told apart, unless hash_all asks for it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    length = F.octet_length("_text").alias("_len")
    head = F.xxhash64(ascii_lower(F.substring("_text", 1, prefix))).alias("_head")

    full = F.sha2(normal(F.col("_text")), 256)
    row = F.monotonically_increasing_id().alias("_row")
    if hash_all:
        rows = checkpoint(source.select("doc_id", length, head, full.alias("text_sha256"), row))
        candidates = checked_join(rows, _shared_heads(rows), ["_len", "_head"], "left_semi")
    else:
        heads = _shared_heads(checkpoint(source.select(length, head)))
        scan = source.select("doc_id", "_text", length, head)
        opened = heads.withColumn("_open", F.lit(True))
        if is_small(heads):
            marked = scan.join(F.broadcast(opened), ["_len", "_head"], "left")
            rows = checkpoint(marked.select("doc_id", F.when(F.col("_open"), full).alias("text_sha256"), row))
        else:
            hashed = scan.select("doc_id", "_len", "_head", full.alias("_full"), row)
            rows = checkpoint(hashed.join(opened, ["_len", "_head"], "left").select("doc_id", F.when(F.col("_open"), F.col("_full")).alias("text_sha256"), "_row"))
        candidates = rows.where("text_sha256 is not null")
    groups = candidates.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count("*").alias("group_size")).where("group_size > 1")
    alone = F.col("group_size").isNull()
    return checked_join(rows, checkpoint(groups), "text_sha256", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_keep._row") == F.col("_row"))).alias("kept"),
        "text_sha256",
    )


def _shared_heads(rows: DataFrame) -> DataFrame:
    """(_len, _head) that several rows have: first the lengths that several have, then the prefixes among these."""
    lengths = checkpoint(rows.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len"))
    survivors = checked_join(rows.select("_len", "_head"), lengths, "_len", "left_semi")
    return checkpoint(survivors.groupBy("_len", "_head").agg(F.count("*").alias("_n")).where("_n > 1").select("_len", "_head"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), hash_all=True)
