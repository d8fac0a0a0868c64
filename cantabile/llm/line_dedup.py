"""Lines that many documents share: explode, hash, count documents per hash, drop, reassemble.

Lines travel as two 64-bit hashes of the normalised key with the document's id and the line's
position. Which lines fall is joined back on those hashes, gathered into a list of positions per
document (never longer than the document) and applied to the text by position. Lines and documents that fall
are written before they are joined back: few enough are broadcast, so that no text moves; beyond that the exchanges of these
joins are plain, and Spark splits the partition of a hot line.

A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased. Keys of at
least `min_chars` code points in at least `min_docs` documents lose all their lines but those of the
document with the smallest id that holds them; repeats inside that document stay.

Defined results: a null or empty text is one empty line; rows with equal ids count as one document; a
null id counts as a document and is the smallest; repeated rows each get their result; an empty
table gives an empty result; other columns of docs pass through, save those named n_lines or
n_dropped, which are replaced (with counts=False these pass through too and no count is given).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantabile.llm.common import ascii_lower, checked_join, checkpoint, is_small, row_key, table

MIN_CHARS, MIN_DOCS = 10, 2
#: Positions of lines that may be broadcast, 4 bytes each.
BROADCAST_PLACES = 4_000_000


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\f\r")))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs that loses lines: _row1, _row2 (its key) and _drop (0-based positions)."""
    doc, text = F.col(id_col), F.col(text_col)
    lines = docs.select(doc.alias("_doc"), *row_key(text, doc), F.posexplode(split_lines(text)).alias("_pos", "_line"))
    keys = lines.withColumn("_key", line_key(F.col("_line"))).where(F.length("_key") >= min_chars)
    keys = checkpoint(keys.select("_doc", "_row1", "_row2", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), "_key").alias("_h2")))
    # of each key once per document first: the hot key's documents then meet only as partial counts
    holders = keys.select("_h1", "_h2", F.struct("_doc").alias("_doc")).distinct()
    shared = holders.groupBy("_h1", "_h2").agg(F.count("*").alias("_docs"), F.min("_doc").alias("_first")).where(F.col("_docs") >= min_docs)
    fallen = checked_join(keys, checkpoint(shared.select("_h1", "_h2", "_first")), ["_h1", "_h2"], "inner").where(~F.col("_doc").eqNullSafe(F.col("_first._doc")))
    return fallen.groupBy("_row1", "_row2").agg(F.collect_set("_pos").alias("_drop"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs with the text column cut, and the columns n_lines (before) and n_dropped."""
    dropped = checkpoint(dropped_lines(docs, min_chars, min_docs, id_col, text_col))
    text = F.coalesce(F.col("_in")[text_col], F.lit(""))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_in"), *row_key(F.col(text_col), F.col(id_col)))
    small = is_small(dropped) and (dropped.agg(F.sum(F.size("_drop"))).first()[0] or 0) <= BROADCAST_PLACES
    cut = whole.join(F.broadcast(dropped) if small else dropped, ["_row1", "_row2"], "left").withColumn("_lines", F.split(text, "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(F.transform(places, lambda i: F.element_at(F.col("_lines"), i + 1)), "\n"))
    others = [(kept if c == text_col else F.col("_in")[c]).alias(c) for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_dropped")]
    numbers = [F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped")]
    return cut.select(*others, *(numbers if counts else ()))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
