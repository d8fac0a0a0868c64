"""Operators against literals and against small recurrences in plain Python."""

import itertools
import math
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cantabile.functions import text as tx
from cantabile.functions.timing import format_time, parse_time
from cantabile.operators import align, ordered, parse, repair, rescue
from cantabile.plans.catalogue import QUERIES


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("ms", "digits", "text"), [(60000, 3, "01:00.000"), (1240, 2, "00:01.24"), (0, 3, "00:00.000"), (6_000_000, 3, "100:00.000")])
def test_format_time(spark, ms, digits, text):
    assert one(spark, format_time(F.lit(ms).cast("bigint"), digits)) == text


@pytest.mark.parametrize(("text", "ms"), [("00:01.25", 1250), ("1:2.5", 62500), ("00:01", 1000), ("00:61", None), ("x", None)])
def test_parse_time(spark, text, ms):
    assert one(spark, parse_time(F.lit(text))) == ms


def test_parse_keeps_stamps_offsets_and_metadata(spark):
    raw = "﻿[ar:A]\n[offset:-100]\n[Verse: 2]\n[00:01.000][00:05.000]word\n\nplain one\n[00:02.500]<00:02.500>two <00:02.900>words<00:03.100>\n"
    texts = spark.createDataFrame([(1, raw), (2, None), (3, "")], "track_id long, raw string")
    lines = [(r.start_ms, r.text, [(w.word, w.start_ms, w.end_ms) for w in r.words]) for r in parse.timed_lines(texts).orderBy("track_id", "line_idx").collect()]
    assert lines == [(900, "word", []), (2400, "two words", [("two", 2400, 2800), ("words", 2800, 3000)]), (4900, "word", [])]
    meta = {r.key: r.value for r in parse.metadata(parse.raw_lines(texts)).collect()}
    assert meta == {"ar": "A", "offset": "-100", "verse": "2"}
    assert [tuple(r) for r in parse.plain_lines(texts).collect()] == [(1, ["plain one"])]


def random_tracks(seed, n=300):
    rng = random.Random(seed)
    return [(t, i, rng.randrange(0, 40), rng.random()) for t in range(n // 15) for i in range(15)]


def test_strict_clamp_is_the_recurrence(spark):
    rows = random_tracks(1)
    df = spark.createDataFrame(rows, "track_id long, line_idx long, v long, w double")
    got = {(r.track_id, r.line_idx): r.v for r in ordered.strict_clamp(df, ["track_id"], "line_idx", "v").collect()}
    for t, group in itertools.groupby(rows, key=lambda r: r[0]):
        prev = None
        for _, i, v, _ in group:
            prev = prev + 1 if prev is not None and v < prev else v
            assert got[t, i] == prev


def test_maxplus_clamp_is_the_recurrence(spark):
    rows = random_tracks(2)
    df = spark.createDataFrame(rows, "track_id long, line_idx long, v long, w double")
    out = df.select("track_id", "line_idx", ordered.maxplus_clamp(F.col("v"), Window.partitionBy("track_id").orderBy("line_idx"), 3).alias("y"))
    got = {(r.track_id, r.line_idx): r.y for r in out.collect()}
    for t, group in itertools.groupby(rows, key=lambda r: r[0]):
        prev = -math.inf
        for _, i, v, _ in group:
            prev = max(v, prev + 3)
            assert got[t, i] == prev


def test_weighted_median(spark):
    rows = random_tracks(3)
    df = spark.createDataFrame(rows, "track_id long, line_idx long, v long, w double")
    got = {r.track_id: r.m for r in ordered.weighted_median(df, ["track_id"], "v", "w", "m").collect()}
    for t, group in itertools.groupby(rows, key=lambda r: r[0]):
        pairs = sorted((v, max(w, 0.001)) for _, _, v, w in group)
        half, total = sum(w for _, w in pairs) / 2, 0.0
        for v, w in pairs:
            total += w
            if total >= half - 1e-12:
                break
        assert got[t] == v


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    for target in ([1, 2], [1, 1], [2, 1, 2], [1]):
        logp = np.log(rng.dirichlet(np.ones(3), 6))
        states = [0]
        for t in target:
            states += [t, 0]
        best, paths = -math.inf, []
        for path in itertools.product(range(len(states)), repeat=6):
            steps = zip(path, path[1:], strict=False)
            if path[0] > 1 or path[-1] < len(states) - 2:
                continue
            if all(b - a in (0, 1) or (b - a == 2 and states[b] and states[b] != states[a]) for a, b in steps):
                score = sum(logp[i, states[s]] for i, s in enumerate(path))
                if score > best + 1e-12:
                    best, paths = score, path
        want = [([i for i, s in enumerate(paths) if s == 2 * k + 1]) for k in range(len(target))]
        got = align.viterbi(logp, target)
        assert [(s[2], s[3]) for s in got] == [(w[0], w[-1] + 1) for w in want]


def test_viterbi_without_a_path_or_target():
    assert align.viterbi(np.zeros((1, 3)), [1, 2]) is None
    assert align.viterbi(np.zeros((4, 3)), []) == []


def test_reconstruct_keeps_order_and_leaves_stable_words(spark):
    words = [(1, 0, i, 100.0 * i if i != 2 else None, 100.0 * i + 90, 0.2 if i in (1, 2) else 0.9, "aligned", i in (1, 2), 1.0 + i, 0.0, 600.0) for i in range(5)]
    df = spark.createDataFrame(words, "track_id long, line_idx long, word_idx long, start_ms double, end_ms double, conf double, origin string, unstable boolean, units double, line_start_ms double, line_end_ms double")
    got = rescue.reconstruct(df).orderBy("word_idx").collect()
    assert [r.origin for r in got] == ["aligned", "tempo_energy_rescue", "tempo_energy_rescue", "aligned", "aligned"]
    # from 90 to 300 in shares of 2 and 3; the first start is 11 ms after the left end at least
    assert [round(r.start_ms, 6) for r in got] == [0, 101, 174, 300, 400]
    assert [round(r.end_ms, 6) for r in got] == [90, 174, 300, 390, 490]
    assert [round(r.conf, 6) for r in got[1:3]] == [0.304, 0.304]


def test_asof_backward(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 0), (2, 3)], "k long, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 5, "A")], "k long, s long, v string")
    got = {(r.k, r.t): r.v for r in ordered.asof_backward(left, right, ["k"], "t", "s", "v").collect()}
    assert got == {(1, 5): "a", (1, 10): "b", (1, 0): None, (2, 3): None}


def test_text_before_the_first_inline_stamp_is_a_word(spark):
    raw = "[00:01.000]Hello <00:02.000>wide <00:02.500>world <00:03.456>\n[00:04.000]plain line\n[00:05.000]<00:05.100>a <00:05.200><00:05.300>b"
    rows = parse.timed_lines(spark.createDataFrame([(1, raw)], "track_id long, raw string")).orderBy("line_idx").collect()
    words = [[(w.word, w.start_ms, w.end_ms, w.conf, w.origin) for w in r.words] for r in rows]
    own = (1.0, "imported_elrc")
    assert words == [
        [("Hello", 1000, 2000, *own), ("wide", 2000, 2500, *own), ("world", 2500, 3456, *own)], [],
        [("a", 5100, 5200, *own), ("b", 5300, None, *own)],
    ]
    assert [(r.text, r.start_ms, r.display_ms, r.end_ms) for r in rows] == [("Hello wide world", 1000, 1000, 3456), ("plain line", 4000, None, None), ("a b", 5000, 5000, 5200)]


def test_a_display_stamp_later_than_the_first_word(spark):
    """A line that was shown late keeps its acoustic start."""
    rows = parse.timed_lines(spark.createDataFrame([(1, "[00:01.820]<00:01.700>next <00:02.500>")], "track_id long, raw string")).collect()
    assert [(r.start_ms, r.display_ms, r.words[0].end_ms) for r in rows] == [(1700, 1820, 2500)]


def test_missing_word_starts_are_spread_over_the_line(spark):
    rows = [(1, 0, 0, 1000, 0.9, "aligned"), (1, 0, 1, None, 0.9, None), (1, 0, 2, None, 0.05, "kept"), (1, 0, 3, 900, 0.9, None)]
    words = spark.createDataFrame([(*r, 1000, 2000) for r in rows], "track_id long, line_idx long, word_idx long, start_ms long, conf double, origin string, line_start_ms long, line_end_ms long")
    got = [(r.start_ms, r.moved, r.conf, r.origin) for r in repair.word_starts(words).orderBy("word_idx").collect()]
    assert got == [(1000, False, 0.9, "aligned"), (1250, False, 0.12, "interpolated"), (1500, False, 0.05, "kept"), (1501, True, 0.25, "repaired")]


def test_full_width_words_are_uncensored(spark):
    row = spark.createDataFrame([("ｓｈ！ｔ", "a$$")], "a string, b string").select(tx.deobfuscate_word(F.col("a")).alias("a"), tx.deobfuscate_title(F.col("b")).alias("b")).first()
    assert (row.a, row.b) == ("shit", "a$$")


def test_most_similar_turns_against_brute_force(spark):
    """Whole texts, every conversation, with the standard library's ratio."""
    flat = lambda s: re.sub(r"[^\w]+", " ", re.sub(r"\s+", " ", s).strip().lower()).strip()
    talks = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect():
        talks.setdefault(r.conv_id, []).append((r.turn, flat(r.text or "")))
    want = []
    for conv, turns in talks.items():
        (_, asked), *later = sorted(turns)
        scores = sorted((-(0.58 * (SequenceMatcher(None, asked, t).ratio() if asked and t else 0.0) + 0.42 * 0.75), n) for n, t in later)
        want += [(conv, n, round(-s, 6), place) for place, (s, n) in enumerate([x for x in scores if -x[0] >= 0.3][:2], 1)]
    got = [(r.conv_id, r.position, round(r.score, 6), r.place) for r in QUERIES["G2_topk_similarity"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want)


def test_artist_album_and_times_count_in_a_match(spark):
    """Against the standard library's ratio, over whole texts of every conversation."""
    flat = lambda s: re.sub(r"[^\w]+", " ", re.sub(r"\s+", " ", s or "").strip().lower()).strip()
    like = lambda a, b: SequenceMatcher(None, flat(a), flat(b)).ratio() if flat(a) and flat(b) else 0.0
    talks = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect():
        album = (re.search(r"[A-Za-z0-9_]+", r.text or "") or [""])[0] if r.turn % 2 == 0 else None
        talks.setdefault(r.conv_id, []).append((r.turn, r.text or "", r.role, album))
    want = []
    for conv, songs in talks.items():
        (_, *asked), *later = sorted(songs)
        scores = []
        for turn, *song in later:
            title, artist, album = (like(a, b) if a or i == 0 else 0.75 for i, (a, b) in enumerate(zip(asked, song)))
            scores.append((-round(0.58 * title + 0.30 * artist + 0.12 * album + (0.10 if len(song[0]) > 200 else 0.0), 9), turn))
        want += [(conv, turn, -score) for score, turn in sorted(scores)[:1] if -score >= 0.52]
    got = [(r.conv_id, r.position, r.score) for r in QUERIES["G2_full_match"](spark, "/root/testdata/sf0.001").collect()]
    assert got and [(c, t, pytest.approx(s)) for c, t, s in sorted(want)] == sorted(got)


def test_a_match_lacks_what_was_not_asked_for(spark):
    from cantabile.operators import search

    rows = [(1, "one", "one", None, "x", "", "y", None, 0), (1, "one", "one", "a", None, "b", "b", True, 1), (2, "one", "one", "a", "a", "b", "b", True, 0), (2, "one", "one", "a", "a", "b", "b", True, 1)]
    hits = spark.createDataFrame(rows, "q long, asked_title string, title string, asked_artist string, artist string, asked_album string, album string, synced boolean, position long")
    got = [(r.q, r.position, round(r.score, 6)) for r in search.best_match(hits, ["q"], k=2).orderBy("q", "place").collect()]
    assert got == [(1, 0, round(0.58 + 0.42 * 0.75, 6)), (1, 1, round(0.58 + 0.12 + 0.10, 6)), (2, 0, 1.1), (2, 1, 1.1)]


def test_strict_clamp_keeps_its_state_over_batches(spark):
    values = [(k, i, (i * 7919 + k * 31) % 997 - 40) for k in range(3) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.createDataFrame(values, "track_id long, line_idx long, v long")
        got = {(r.track_id, r.line_idx): (r.v, r.moved) for r in ordered.strict_clamp(df, ["track_id"], "line_idx", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {}
    for k, i, v in values:
        now, low = max(0, v), k in last and max(0, v) < last[k]
        last[k] = last[k] + 1 if low else now
        assert got[k, i] == (last[k], low)


def test_words_go_through_a_romanizer(spark):
    from cantabile.functions.text import normalized_words, table_romanizer

    table = table_romanizer({"привет": "privet", "мир": "mir"})
    df = spark.createDataFrame([("Привет мир",), ("sh!t ♪ Ça",), ("",), (None,)], "t string")
    got = [[tuple(w) for w in r.w] for r in df.select(normalized_words(F.col("t"), table).alias("w")).collect()]
    assert got == [[("Привет", "privet"), ("мир", "mir")], [("sh!t", "shit"), ("♪", ""), ("Ça", "ca")], [], []]


def test_cache_makes_only_what_it_lacks(spark):
    from cantabile.operators import cache

    held = spark.createDataFrame([("a", "A", 1, 1, 1, 2), ("b", "old", 1, 1, 1, 1)], "cache_key string, payload string, byte_size long, created_at long, last_access long, schema_version long")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "cache_key string").distinct()
    out, after = cache.through(held, asked, 2, lambda todo: todo.withColumn("payload", F.upper("cache_key")), F.lit(9).cast("long"))
    assert sorted(map(tuple, out.collect())) == [("a", "A", True), ("b", "B", False), ("c", "C", False)]
    assert sorted((r.cache_key, r.payload, r.last_access, r.schema_version) for r in after.collect()) == [("a", "A", 9, 2), ("b", "B", 9, 2), ("c", "C", 9, 2)]
    assert cache.clear(held)[1].collect() == [(2,)]
