"""LRC and ELRC texts to tracks, lines and words.

Times are milliseconds. A text is one row; its lines are exploded, so a folder of texts is read and
parsed in parallel. A line with k leading stamps gives k lines with the same words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantabile.functions.text import strip
from cantabile.functions.timing import parse_time

# What the file format says a stamp, a metadata row and an inline stamp are.
BODY = r"\d{1,4}:[0-5]?\d(?:[.:]\d{1,3})?"
META = r"^\s*\[([A-Za-z][\w-]*):(.*)\]\s*$"
LEADING = rf"^(?:\s*\[{BODY}\])+"
INLINE = rf"[<\[]({BODY})[>\]]"
#: What ends a line, for the tool whose texts these are.
BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def raw_lines(texts: DataFrame, text_col: str = "raw") -> DataFrame:
    """(track_id, pos, line, kind): kind is meta, timed or plain; blank lines are dropped."""
    lines = texts.select("track_id", F.posexplode(F.split(F.regexp_replace(F.coalesce(text_col, F.lit("")), "^﻿", ""), BREAK)).alias("pos", "line")).where(strip(F.col("line")) != "")
    kind = F.when(F.col("line").rlike(META) & ~F.col("line").rlike(LEADING), "meta").when(F.col("line").rlike(LEADING), "timed").otherwise("plain")
    return lines.withColumn("kind", kind)


def metadata(lines: DataFrame) -> DataFrame:
    """(track_id, key, value), the last value of each key; keys in lower case."""
    rows = lines.where("kind = 'meta'").select("track_id", "pos", F.lower(F.regexp_extract("line", META, 1)).alias("key"), strip(F.regexp_extract("line", META, 2)).alias("value"))
    return rows.groupBy("track_id", "key").agg(F.max_by("value", "pos").alias("value"))


def offsets(meta: DataFrame) -> DataFrame:
    """(track_id, offset_ms): how much later all times are."""
    return meta.where("key = 'offset'").select("track_id", F.col("value").try_cast("double").cast("bigint").alias("offset_ms")).where("offset_ms is not null")


def inline_words(body: Column, line_start: Column | None = None) -> Column:
    """array<struct<word, start_ms, end_ms, conf, origin>> of a line's text after its leading stamps.

    Text before the first inline stamp is a word at the line's stamp. A word ends at a stamp that only ends it, else where the next word
    starts; the last word at the line's terminal stamp, or nowhere.
    """
    stamps = F.transform(F.regexp_extract_all(body, F.lit(INLINE), F.lit(1)), parse_time)
    parts = F.transform(F.split(body, INLINE), strip)
    starts = F.concat(F.array(line_start if line_start is not None else F.lit(None).cast("bigint")), stamps)
    pairs = F.zip_with(starts, parts, lambda t, w: F.struct(t.alias("t"), w.alias("w")))
    terminal = terminal_stamp(body)

    rest = lambda x: F.slice(x, F.lit(2), F.size(x))
    closed = lambda p, q: F.struct(p["t"].alias("t"), p["w"].alias("w"), F.when((q["w"] == "") & (q["t"] > p["t"]), q["t"]).alias("closing"))
    kept = F.filter(F.zip_with(pairs, rest(pairs), closed), lambda p: p["w"] != "")

    def one(p: Column, following: Column) -> Column:
        end = F.coalesce(p["closing"], following["t"], F.when(terminal > p["t"], terminal))
        return F.struct(p["w"].alias("word"), p["t"].alias("start_ms"), end.alias("end_ms"), F.lit(1.0).alias("conf"), F.lit("imported_elrc").alias("origin"))

    words = F.filter(F.zip_with(kept, rest(kept), one), lambda w: w["start_ms"].isNotNull())
    return F.when(F.size(stamps) > 0, words).otherwise(F.slice(words, 1, 0))


def terminal_stamp(body: Column) -> Column:
    """The last inline stamp with no text after it; null if there is none."""
    stamps = F.transform(F.regexp_extract_all(body, F.lit(INLINE), F.lit(1)), parse_time)
    parts = F.transform(F.split(body, INLINE), strip)
    bare = F.filter(F.zip_with(stamps, F.slice(parts, F.lit(2), F.size(parts)), lambda t, w: F.struct(t.alias("t"), w.alias("w"))), lambda q: q["w"] == "")
    return F.try_element_at(bare, F.lit(-1))["t"]


def timed_lines(texts: DataFrame, text_col: str = "raw") -> DataFrame:
    """(track_id, line_idx, start_ms, display_ms, end_ms, text, words): lines in order of their acoustic start, which is the earliest of stamp and words.

    display_ms is the stamp of a line with words, end_ms its terminal stamp.
    """
    lines = raw_lines(texts, text_col)
    shift = F.coalesce(F.col("offset_ms"), F.lit(0))
    rows = lines.where("kind = 'timed'").join(offsets(metadata(lines)), "track_id", "left")
    head = F.regexp_extract("line", f"({LEADING})", 1)
    stamps = F.regexp_extract_all(head, F.lit(rf"\[({BODY})\]"), F.lit(1))
    split = rows.select("track_id", "pos", shift.alias("_shift"), F.posexplode(stamps).alias("_nth", "_stamp"), strip(F.regexp_replace("line", LEADING, "")).alias("_body"))
    read = split.withColumn("_on", parse_time(F.col("_stamp"))).withColumn("_words", inline_words(F.col("_body"), F.col("_on")))
    moved = lambda w: F.struct(w["word"].alias("word"), (w["start_ms"] + F.col("_shift")).alias("start_ms"), (w["end_ms"] + F.col("_shift")).alias("end_ms"), w["conf"].alias("conf"), w["origin"].alias("origin"))
    shaped = read.withColumn("words", F.transform("_words", moved)).withColumn("_at", F.col("_on") + F.col("_shift"))
    plain = F.regexp_replace(F.col("_body"), INLINE, "")
    timed_words = F.size("words") > 0
    text = F.when(timed_words, F.array_join(F.transform("words", lambda w: w["word"]), " ")).otherwise(strip(plain))
    start = F.greatest(F.lit(0), F.least(F.col("_at"), F.coalesce(F.array_min(F.transform("words", lambda w: w["start_ms"])), F.col("_at"))))
    timed = shaped.select(
        "track_id", "pos", "_nth", start.alias("start_ms"), F.when(timed_words, F.col("_at")).alias("display_ms"), (terminal_stamp(F.col("_body")) + F.col("_shift")).alias("end_ms"), text.alias("text"), "words"
    )
    # equal starts keep the order of the text
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("start_ms", "pos", "_nth")) - 1
    return timed.select("track_id", place.alias("line_idx"), "start_ms", "display_ms", "end_ms", "text", "words")


def plain_lines(texts: DataFrame, text_col: str = "raw") -> DataFrame:
    """(track_id, lines): a track's lines without a stamp, in order."""
    rows = raw_lines(texts, text_col).where("kind = 'plain'")
    return rows.groupBy("track_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", strip(F.col("line")).alias("l")))), lambda x: x["l"]).alias("lines"))
