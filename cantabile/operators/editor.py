"""What an editor does to tracks, as transformations of all of them: seeding, splitting, shifting, checking. Times in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantabile.functions.text import tokens
from cantabile.functions.timing import parse_time
from cantabile.operators.ordered import by_line, by_track



def seed_words(lines: DataFrame) -> DataFrame:
    """Even word times for lines that have text and no words: up to the line's end, the next line, or 350 ms a word (1 s at least)."""
    named = lines.withColumn("_tokens", tokens(F.col("text"))).withColumn("_next", F.lead("start_ms").over(by_track())).where("size(_tokens) > 0")
    n = F.size("_tokens")
    end = F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms")).when(F.col("_next") > F.col("start_ms"), F.col("_next")).otherwise(F.col("start_ms") + F.greatest(F.lit(1000), 350 * n))
    each = named.withColumn("_span", end - F.col("start_ms")).select("track_id", "line_idx", "start_ms", "_span", n.alias("_n"), F.posexplode("_tokens").alias("word_idx", "word"))
    at = lambda i: F.col("start_ms") + F.expr(f"(_span * ({i})) div _n")
    return each.select("track_id", "line_idx", "word_idx", "word", at("word_idx").alias("_s"), at("word_idx + 1").alias("end_ms")).withColumnRenamed("_s", "start_ms")


def split_line(words: DataFrame, line: Column, word: Column) -> DataFrame:
    """Makes a line of its own of the words from `word` on of line `line`; lines after it move on by one."""
    tail = (F.col("line_idx") == line) & (F.col("word_idx") >= word)
    after = F.col("line_idx") > line
    return words.withColumns({"word_idx": F.when(tail, F.col("word_idx") - word).otherwise(F.col("word_idx")), "line_idx": F.when(tail | after, F.col("line_idx") + 1).otherwise(F.col("line_idx"))})


def delete_line(words: DataFrame, line: Column) -> DataFrame:
    return words.where(F.col("line_idx") != line).withColumn("line_idx", F.when(F.col("line_idx") > line, F.col("line_idx") - 1).otherwise(F.col("line_idx")))


def add_word(words: DataFrame, text: str = "…") -> DataFrame:
    """A word of 400 ms after the last of each line."""
    last = words.groupBy("track_id", "line_idx").agg((F.max("word_idx") + 1).alias("word_idx"), F.max_by("end_ms", "word_idx").alias("start_ms"))
    return words.select("track_id", "line_idx", "word_idx", "word", "start_ms", "end_ms").unionByName(last.select("track_id", "line_idx", "word_idx", F.lit(text).alias("word"), "start_ms", (F.col("start_ms") + 400).alias("end_ms")))


def add_line(lines: DataFrame) -> DataFrame:
    """An empty line of a second, 250 ms after the last of each track."""
    last = lines.groupBy("track_id").agg((F.max("line_idx") + 1).alias("line_idx"), (F.max_by("end_ms", "line_idx") + 250).alias("start_ms"))
    return lines.select("track_id", "line_idx", "start_ms", "end_ms").unionByName(last.select("track_id", "line_idx", "start_ms", (F.col("start_ms") + 1000).alias("end_ms")))


def shift(df: DataFrame, by: Column, columns: list[str]) -> DataFrame:
    """All times later by `by`, none below zero."""
    return df.withColumns({c: F.greatest(F.lit(0), F.col(c) + by) for c in columns})


def set_boundary(words: DataFrame, word: Column, at: Column) -> DataFrame:
    """Sets where word `word` of each line begins; the word before ends there, and neither gets shorter than 10 ms."""
    before, after = F.lag("start_ms").over(by_line()), F.col("end_ms")
    wanted = F.least(F.greatest(at, F.coalesce(before + 10, F.lit(0))), after - 10)
    start = F.when(F.col("word_idx") == word, wanted).otherwise(F.col("start_ms"))
    moved = words.withColumn("_start", start)
    end = F.when(F.lead("word_idx").over(by_line()) == word, F.lead("_start").over(by_line())).otherwise(F.col("end_ms"))
    return moved.withColumn("end_ms", end).withColumn("start_ms", F.col("_start")).drop("_start")


def move_line(lines: DataFrame, start: Column) -> DataFrame:
    """A line's new start; its display start moves by as much."""
    return lines.withColumn("display_ms", F.greatest(F.lit(0), F.col("display_ms") + start - F.col("start_ms"))).withColumn("start_ms", start)


def edit_time(old: Column, typed: Column) -> Column:
    """What was typed, if it is a time, else the old one."""
    return F.coalesce(parse_time(typed), old)


def violations(words: DataFrame) -> DataFrame:
    """(track_id, line_idx, word_idx, issue), word_idx null for a line's: order of lines, empty words, words before their line, bad intervals, order and overlap of words. Needs line_start_ms, word."""
    w = words.withColumn("_next", F.lead("start_ms").over(by_line()))
    tests = {
        "empty": F.trim("word") == "",
        "before_line": F.col("start_ms") < F.col("line_start_ms"),
        "bad_interval": ~(F.col("end_ms") > F.col("start_ms")),
        "word_order": F.col("_next") < F.col("start_ms"),
        "overlap": F.col("end_ms") > F.col("_next"),
    }
    told = F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull())
    of_words = w.select("track_id", "line_idx", "word_idx", F.explode(told).alias("issue"))
    lines = words.groupBy("track_id", "line_idx").agg(F.first("line_start_ms").alias("_s")).withColumn("_before", F.lag("_s").over(by_track()))
    return of_words.unionByName(lines.where("_s < _before").select("track_id", "line_idx", F.lit(None).cast("long").alias("word_idx"), F.lit("line_order").alias("issue")))


def publishable(words: DataFrame) -> bool:
    return violations(words).isEmpty()


def versions(history: DataFrame, keep: int = 100) -> DataFrame:
    """The last `keep` snapshots of each track, newest first as undo 0."""
    place = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("version"))) - 1
    return history.withColumn("undo", place).where(F.col("undo") < keep)


def client_repair(words: DataFrame) -> DataFrame:
    """The editor's own repair of word times: not before the word before, ending by the next start, 300 ms where no end is known."""
    run = by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.max(F.greatest("line_start_ms", F.coalesce("start_ms", "line_start_ms"))).over(run)
    placed = words.withColumn("_start", start).withColumn("_next", F.lead("start_ms").over(by_line()))
    end = F.greatest(F.col("_start") + 1, F.least(F.coalesce("end_ms", F.col("_start") + 300), F.coalesce("_next", F.coalesce("end_ms", F.col("_start") + 300))))
    return placed.withColumn("end_ms", end).withColumn("start_ms", F.col("_start")).drop("_start", "_next")
