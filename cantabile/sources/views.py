"""Timed-text views over event and conversation tables: how the catalogue's queries get tracks, lines and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS_PER_LINE = 6
#: Letters of sung words; a letter's id is its place, 0 is blank.
LETTERS = "aeioumnlrs"
ORIGIN_OF = {"click": "aligned", "view": "aligned_low_confidence", "signup": "adaptive_consensus", "purchase": "tempo_energy_rescue", "error": "interpolated"}


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as a track of words, six to a line: (track_id, seq, line_idx, word_idx, start_us, end_us, k, conf, origin)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seq = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    origin = F.create_map(*[F.lit(x) for kv in ORIGIN_OF.items() for x in kv])[F.col("event_type")]
    base = events.select(F.col("user_id").alias("track_id"), seq.alias("seq"), micros("ts").alias("start_us"), F.round(F.col("value") * 1000000).cast("long").alias("_long"), k.alias("k"), origin.alias("origin"))
    return base.select("track_id", "seq", F.expr(f"seq div {WORDS_PER_LINE}").alias("line_idx"), (F.col("seq") % WORDS_PER_LINE).alias("word_idx"), "start_us", (F.col("start_us") + F.col("_long")).alias("end_us"), "k", (F.col("k") / 100.0).alias("conf"), "origin")


def sung_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words on a dense timeline in milliseconds, some out of order: (track_id, seq, line_idx, word_idx, start_ms, end_ms, k, conf, origin, word)."""
    w = timed_words(spark, sf_dir)
    start = F.col("seq") * 400 + (F.col("k") * 37) % 600
    word = F.translate((F.col("k") * 7919 + 11).cast("string"), "0123456789", "aeioumnlrs")
    return w.select("track_id", "seq", "line_idx", "word_idx", start.alias("start_ms"), (start + 60 + (F.col("k") * 13) % 500).alias("end_ms"), "k", "conf", "origin", word.alias("word"))


def sung_lines(words: DataFrame) -> DataFrame:
    """Lines of sung words: anchor (first word's place before jitter), start, end, confidence and word count."""
    return words.groupBy("track_id", "line_idx").agg(
        (F.min("seq") * 400).alias("anchor_ms"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.round(F.avg("conf"), 9).alias("conf"), F.count("*").alias("n_words")
    )


def lyric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a line-timed text, a turn every 4 s: (track_id, raw)."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ms = F.col("turn") * 4000 + (F.col("turn") * 137) % 1000
    stamp = F.format_string("[%02d:%02d.%03d]", F.expr("bigint(turn * 4000 + (turn * 137) % 1000) div 60000"), F.expr("bigint(turn * 4000 + (turn * 137) % 1000) div 1000 % 60"), ms % 1000)
    line = F.concat(stamp, F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n\x0b\x0c\x1c-\x1e\x85  ]+", " "))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    head = F.concat(F.lit("[ar:Conversation "), F.col("conv_id").cast("string"), F.lit("]\n[offset:"), (F.col("conv_id") % 3 * 250).cast("string"), F.lit("]\n[Verse: 1]\nplain opening\n\n"))
    return turns.groupBy("conv_id").agg(body.alias("_body")).select(F.col("conv_id").alias("track_id"), F.concat(head, "_body").alias("raw"))


def sung_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sung words with anchor and words to align: (track_id, line_idx, anchor_ms, duration_ms, words); letters are ids 1 to 10, every 13th k is a sign without letters."""
    w = sung_words(spark, sf_dir)
    sign = F.col("k") % 13 == 0
    text = F.when(sign, "♪").otherwise(F.substring("word", 1, 4))
    ids = F.when(sign, F.array().cast("array<int>")).otherwise(letter_ids(F.substring("word", 1, 4)))
    row = F.struct("word_idx", text.alias("word"), F.when(sign, "").otherwise(text).alias("normalized"), ids.alias("ids"))
    each = w.groupBy("track_id", "line_idx").agg((F.min("seq") * 400).alias("anchor_ms"), F.max("seq").alias("_last"), F.sort_array(F.collect_list(row)).alias("_w"))
    last = (F.max("_last").over(Window.partitionBy("track_id")) + 1) * 400
    return each.select("track_id", "line_idx", "anchor_ms", last.alias("duration_ms"), F.transform("_w", lambda x: F.struct(x["word"].alias("word"), x["normalized"].alias("normalized"), x["ids"].alias("ids"))).alias("words"))


def letter_ids(word: Column) -> Column:
    return F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(LETTERS)))


def sung_frames(spark: SparkSession, sf_dir: str, lift: float = 0.0) -> DataFrame:
    """Log-probabilities of sung words, a block of ten 40 ms frames to a word: (track_id, block, logp). A letter every other frame, trusted as the word's conf and `lift` say; every 11th k says nothing."""
    w = sung_words(spark, sf_dir)
    known = F.when(F.col("k") % 13 == 0, F.array().cast("array<int>")).otherwise(letter_ids(F.substring("word", 1, 4)))
    p = F.when(F.col("k") % 11 == 5, 1 / (len(LETTERS) + 1)).otherwise(F.least(F.lit(0.97), 0.30 + 0.6 * F.col("conf") + lift))
    said = w.select("track_id", F.col("seq").alias("block"), (F.col("k") % 3).cast("int").alias("_late"), known.alias("_ids"), F.log(p).alias("_hit"), F.log((1 - p) / len(LETTERS)).alias("_miss"))
    place = lambda f: f - F.col("_late")
    token = lambda f: F.when((place(f) >= 0) & (place(f) % 2 == 0), F.coalesce(F.get("_ids", F.floor(place(f) / 2).cast("int")), F.lit(0))).otherwise(0)
    logp = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda f: F.transform(F.sequence(F.lit(0), F.lit(len(LETTERS))), lambda v: F.when(v == token(f), F.col("_hit")).otherwise(F.col("_miss"))))
    return said.select("track_id", "block", logp.alias("logp"))


def sung_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand samples a second of sung words, a block of 400 to a word: (track_id, block, samples). Quiet until the word begins, then louder the more it is trusted."""
    w = sung_words(spark, sf_dir)
    begin = (F.col("k") * 37) % 400
    wave = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: (F.when(i >= begin, 0.1 + F.col("conf")).otherwise(0.01) * F.sin(i * 0.7)).cast("float"))
    return w.select("track_id", F.col("seq").alias("block"), wave.alias("samples"))
