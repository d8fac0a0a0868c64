"""Tracks back to text: line-timed, word-timed exact, word-timed compatible, and the bundle of all three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantabile.functions.timing import format_time

# Metadata keys that come first in a header, in this order.
FIRST_KEYS = ("ar", "ti", "al", "au", "lr", "length", "by", "re", "ve")


def header(meta: Column) -> Column:
    """Lines of a metadata map: known keys in their order, then the others sorted; offset and empty values are left out."""
    clean = F.filter(F.transform(F.map_entries(meta), lambda e: F.struct(e["key"].alias("key"), F.regexp_replace(e["value"], r"[\r\n]+", " ").alias("value"))), lambda e: (e["key"] != "offset") & (e["value"] != ""))
    known = F.array(*map(F.lit, FIRST_KEYS))
    rank = lambda k: F.when(F.array_contains(known, k), F.array_position(known, k)).otherwise(len(FIRST_KEYS) + 1)
    ordered = F.sort_array(F.transform(clean, lambda e: F.struct(rank(e["key"]).alias("rank"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.array_join(F.transform(ordered, lambda e: F.concat(F.lit("["), e["key"], F.lit(":"), e["value"], F.lit("]"))), "\n")


def line_text(start: Column, text: Column, digits: int = 3) -> Column:
    return F.concat(F.lit("["), format_time(start, digits), F.lit("]"), text)


def word_text(words: Column, digits: int = 3, ends: bool = True) -> Column:
    """`<start>word <end>` for each of array<struct<word, start_ms, end_ms>>; without ends in the compatible form."""
    one = lambda w: F.concat(F.lit("<"), format_time(w["start_ms"], digits), F.lit(">"), w["word"], *([F.lit(" <"), format_time(w["end_ms"], digits), F.lit(">")] if ends else []))
    return F.array_join(F.transform(words, one), " ")


def joined(lines: DataFrame, line: Column, out: str) -> DataFrame:
    """(track_id, out): each track's lines, in order, as one text."""
    rows = lines.select("track_id", F.struct("line_idx", line.alias("text")).alias("_l"))
    return rows.groupBy("track_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_l")), lambda x: x["text"]), "\n").alias(out))


def bundle(lines: DataFrame) -> DataFrame:
    """(track_id, lrc, elrc, elrc_compatible) in one pass over the lines."""
    shown = F.coalesce(F.col("display_ms"), F.col("start_ms")) if "display_ms" in lines.columns else F.col("start_ms")
    timed = F.size("words") > 0
    body = lambda digits, ends: F.when(timed, word_text(F.col("words"), digits, ends)).otherwise(F.col("text"))
    forms = {"lrc": line_text(shown, F.col("text")), "elrc": line_text(shown, body(3, True)), "elrc_compatible": line_text(shown, body(2, False), 2)}
    rows = lines.select("track_id", F.struct("line_idx", *(c.alias(k) for k, c in forms.items())).alias("_l"))
    gathered = rows.groupBy("track_id").agg(F.sort_array(F.collect_list("_l")).alias("_ls"))
    return gathered.select("track_id", *(F.array_join(F.col("_ls")[k], "\n").alias(k) for k in forms))
