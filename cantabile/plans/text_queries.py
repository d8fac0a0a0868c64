"""Queries on texts: parsing, serializing, scalar functions, search, cache, editor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantabile.functions import text as tx
from cantabile.functions import timing
from cantabile.operators import cache, compare, edit_log, editor, mend, parse, search, serialize
from cantabile.plans.ordered_queries import lines
from cantabile.plans.sql import LT, SL, SW, stamp, with_
from cantabile.sources.files import manifest_cases
from cantabile.sources.tags import with_tags
from cantabile.sources.views import lyric_texts, sung_words

QUERIES, ORACLES = {}, {}


def query(name: str, views: str | None = None, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_(views, sql) if views else sql
        return f

    return keep


def turns(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


def said(spark: SparkSession, d: str) -> DataFrame:
    """The text of each turn: the catalogue's titles."""
    return turns(spark, d).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))


SAID = "h AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)"
TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("A1_parse_lrc", LT, "SELECT track_id, line_idx, start_ms, text FROM ln")
def a1(spark, d):
    return parse.timed_lines(lyric_texts(spark, d)).select("track_id", "line_idx", "start_ms", "text")


#: ow: sung words in order, none over the next.
OW = SW + """,
ow AS (SELECT track_id, seq, line_idx, word_idx, seq * 400 + (k * 37) % 300 AS start_ms, seq * 400 + (k * 37) % 300 + 60 + (k * 13) % 40 AS end_ms, word FROM sw)"""

OUTPUTS = OW + f""",
ol AS (SELECT track_id, line_idx, min(start_ms) AS s, max(end_ms) AS e, string_agg(word, ' ' ORDER BY word_idx) AS text, count(*) AS n,
  string_agg('<' || {stamp('start_ms')} || '>' || word || ' <' || {stamp('end_ms')} || '>', ' ' ORDER BY word_idx) AS exact,
  string_agg('<' || {stamp('start_ms', 2)} || '>' || word, ' ' ORDER BY word_idx) AS compat FROM ow GROUP BY track_id, line_idx)"""


def ordered_lines(spark, d):
    """Lines of sung words whose times are in order, their words without end, trust or origin save the end."""
    begin = F.col("seq") * 400 + (F.col("k") * 37) % 300
    row = F.struct("word_idx", "word", begin.alias("start_ms"), (begin + 60 + (F.col("k") * 13) % 40).alias("end_ms"), F.lit(0.9).alias("conf"), F.lit("aligned").alias("origin"))
    g = sung_words(spark, d).groupBy("track_id", "line_idx").agg(F.sort_array(F.collect_list(row)).alias("words"))
    return g.withColumn("start_ms", F.array_min(F.transform("words", lambda w: w["start_ms"])))


@query("B5_outputs", OUTPUTS, f"""SELECT track_id, sha256(h || string_agg('[' || {stamp('s')} || ']' || text, chr(10) ORDER BY line_idx)) AS lrc, sha256(h || string_agg('[' || {stamp('s')} || ']' || exact, chr(10) ORDER BY line_idx)) AS elrc,
  sha256(h || string_agg('[' || {stamp('s', 2)} || ']' || compat, chr(10) ORDER BY line_idx)) AS elrc_compatible, 0 AS issues
  FROM (SELECT *, CASE WHEN track_id % 2 = 1 THEN '[ar:A ' || track_id || ']' || chr(10) || '[zz:y]' || chr(10) || chr(10) ELSE '' END AS h FROM ol) GROUP BY track_id, h""")
def b5_outputs(spark, d):
    """The three texts of each track, mended, with a header where there is metadata, and how many issues there were."""
    rows = ordered_lines(spark, d)
    full = F.create_map(F.lit("zz"), F.lit("y"), F.lit("ar"), F.concat(F.lit("A "), F.col("track_id").cast("string")))
    meta = rows.select("track_id").distinct().withColumn("meta", F.when(F.col("track_id") % 2 == 1, full))
    return mend.outputs(rows, meta).select("track_id", *(F.sha2(c, 256).alias(c) for c in ("lrc", "elrc", "elrc_compatible")), F.size("issues").alias("issues"))


@query("B6_result", OUTPUTS, f"""SELECT track_id, count(*)::VARCHAR AS line_count, sum(n)::VARCHAR AS word_count, count(*) FILTER (nxt - e >= 250) AS breaks,
  sha256('[ar:Artist ' || track_id || ']' || chr(10) || '[ti:Title]' || chr(10) || '[by:cantabile]' || chr(10) || chr(10) || string_agg('[' || {stamp('s')} || ']' || text, chr(10) ORDER BY line_idx)) AS lrc
  FROM (SELECT *, lead(s) OVER (PARTITION BY track_id ORDER BY line_idx) AS nxt FROM ol) GROUP BY track_id""")
def b6_result(spark, d):
    """The whole result of each track as JSON, of which counts, breaks and a hash of the text are shown."""
    rows = ordered_lines(spark, d)
    about = rows.select("track_id").distinct().select("track_id", F.concat(F.lit("Artist "), F.col("track_id").cast("string")).alias("artist"), F.lit("Title").alias("title"), F.lit("").alias("album"))
    told = mend.payload(rows, about, min_gap_ms=250)
    of = lambda path: F.get_json_object("payload", f"$.{path}")
    breaks = F.size(F.from_json(of("breaks"), "array<struct<start_ms:bigint>>")).cast("long")
    return told.select("track_id", of("line_count").alias("line_count"), of("word_count").alias("word_count"), breaks.alias("breaks"), F.sha2(of("lrc"), 256).alias("lrc"))


@query("A3_score_texts", LT, """SELECT track_id, count(*) AS reference_lines, count(*) AS candidate_lines, count(*) FILTER (contains(text, 'the')) AS line_text_mismatches, 0::BIGINT AS reference_words, 0::BIGINT AS matched_words,
  120.0::DOUBLE AS line_onset_mae_ms, NULL::DOUBLE AS word_onset_mae_ms, NULL::DOUBLE AS word_onset_median_ms, NULL::DOUBLE AS word_onset_p95_ms, NULL::DOUBLE AS word_end_mae_ms, NULL::DOUBLE AS word_end_p95_ms,
  0.0::DOUBLE AS within_50_ms, 0.0::DOUBLE AS within_100_ms, 0.0::DOUBLE AS within_200_ms, 0.0::DOUBLE AS word_coverage FROM ln GROUP BY track_id""")
def a3_score_files(spark, d):
    """Each text against a copy of it that comes 120 ms later and is spelled otherwise here and there."""
    texts = lyric_texts(spark, d)
    offset = F.col("track_id") % 3 * 250
    stamp_of = lambda ms: F.concat(F.lit("[offset:"), ms.cast("string"), F.lit("]"))
    other = F.replace(F.replace(F.col("raw"), F.lit("the"), F.lit("thee")), stamp_of(offset), stamp_of(offset + 120))
    return compare.score_files(texts, texts.withColumn("raw", other))


@query("F0_repair_lines")
def f0(spark, d):
    """Sung lines, some out of order, with some words' times, ends and texts missing, mended as whole tracks; what was mended beside them."""
    gone = lambda c, m: F.when(F.col("k") % m != 1, F.col(c)).alias(c)
    text = F.when(F.col("k") % 19 != 3, F.col("word")).otherwise("  ")
    row = F.struct("word_idx", text.alias("word"), gone("start_ms", 7), gone("end_ms", 5), "conf", gone("origin", 3))
    lines_ = sung_words(spark, d).groupBy("track_id", "line_idx").agg(F.sort_array(F.collect_list(row)).alias("words"), F.max_by("start_ms", F.col("k") * 10 + F.col("word_idx")).alias("start_ms"))
    fixed = mend.repair_lines(lines_)
    words = F.array_join(F.transform("words", lambda w: F.format_string("%s:%d-%d:%s", w["word"], w["start_ms"], w["end_ms"], w["origin"])), " ")
    return fixed.select("track_id", "line_idx", "start_ms", "end_ms", words.alias("words"), F.size("issues").alias("issues"))


@query("C1_metadata", LT, "SELECT track_id, key, value FROM lt, LATERAL (VALUES ('ar', 'Conversation ' || track_id), ('offset', (track_id % 3 * 250)::VARCHAR), ('verse', '1')) v(key, value)")
def c1(spark, d):
    return parse.metadata(parse.raw_lines(lyric_texts(spark, d)))


@query("C2_leading_stamps", SL, f"SELECT track_id, line_idx, unnest([anchor_ms, start_ms + 5000]) AS start_ms FROM sl")
def c2(spark, d):
    """A line with two leading stamps gives two lines."""
    two = lines(spark, d).withColumn("raw", F.concat(F.lit("["), timing.format_time(F.col("anchor_ms")), F.lit("]["), timing.format_time(F.col("start_ms") + 5000), F.lit("]la")))
    got = parse.timed_lines(two.select((F.col("track_id") * 1_000_000 + F.col("line_idx")).alias("track_id"), "raw"))
    return got.select(F.expr("track_id div 1000000").alias("track_id"), (F.col("track_id") % 1_000_000).alias("line_idx"), "start_ms")


@query("C3_plain_lines", LT, "SELECT track_id, 'plain opening' AS lines FROM lt")
def c3(spark, d):
    return parse.plain_lines(lyric_texts(spark, d)).select("track_id", F.array_join("lines", "\n").alias("lines"))


@query("C4_blank_words", SW, "SELECT track_id, count(*) FILTER (k % 10 <> 3) AS kept, count(*) FILTER (k % 10 = 3) AS issues FROM sw GROUP BY track_id")
def c4(spark, d):
    from cantabile.operators.repair import without_blank_words

    kept, issues = without_blank_words(sung_words(spark, d).withColumn("word", F.when(F.col("k") % 10 == 3, " \t").otherwise(F.col("word"))))
    both = kept.select("track_id", F.lit(1).alias("k"), F.lit(0).alias("i")).unionByName(issues.select("track_id", F.lit(0).alias("k"), F.lit(1).alias("i")))
    return both.groupBy("track_id").agg(F.sum("k").alias("kept"), F.sum("i").alias("issues"))


@query("C5_non_blank", None, "SELECT conv_id, count(*) AS n FROM conversations WHERE regexp_matches(coalesce(text, ''), '\\S') GROUP BY conv_id")
def c5(spark, d):
    return turns(spark, d).where(tx.strip(F.coalesce("text", F.lit(""))) != "").groupBy("conv_id").agg(F.count("*").alias("n"))


BUNDLE = SW + f""",
wl AS (SELECT track_id, line_idx, min(start_ms) AS s, string_agg(word, ' ' ORDER BY word_idx) AS text, string_agg('<' || {stamp('start_ms')} || '>' || word || ' <' || {stamp('end_ms')} || '>', ' ' ORDER BY word_idx) AS exact,
  string_agg('<' || {stamp('start_ms', 2)} || '>' || word, ' ' ORDER BY word_idx) AS compat FROM sw GROUP BY track_id, line_idx)"""


def word_lines(spark, d):
    w = F.sort_array(F.collect_list(F.struct("word_idx", "word", "start_ms", "end_ms")))
    g = sung_words(spark, d).groupBy("track_id", "line_idx").agg(F.min("start_ms").alias("start_ms"), w.alias("words"))
    return g.withColumn("text", F.array_join(F.transform("words", lambda x: x["word"]), " "))


@query("B1_lrc_text", BUNDLE, f"SELECT track_id, string_agg('[' || {stamp('s')} || ']' || text, chr(10) ORDER BY line_idx) AS lrc FROM wl GROUP BY track_id")
def b1(spark, d):
    return serialize.joined(word_lines(spark, d), serialize.line_text(F.col("start_ms"), F.col("text")), "lrc")


@query("B2_elrc_text", BUNDLE, f"SELECT track_id, string_agg('[' || {stamp('s')} || ']' || exact, chr(10) ORDER BY line_idx) AS elrc FROM wl GROUP BY track_id")
def b2(spark, d):
    return serialize.joined(word_lines(spark, d), serialize.line_text(F.col("start_ms"), serialize.word_text(F.col("words"))), "elrc")


@query("B3_elrc_compatible", BUNDLE, f"SELECT track_id, string_agg('[' || {stamp('s', 2)} || ']' || compat, chr(10) ORDER BY line_idx) AS elrc_compatible FROM wl GROUP BY track_id")
def b3(spark, d):
    return serialize.joined(word_lines(spark, d), serialize.line_text(F.col("start_ms"), serialize.word_text(F.col("words"), 2, False), 2), "elrc_compatible")


@query("B4_header", SL, """SELECT DISTINCT track_id, '[ar:A ' || track_id || ']' || chr(10) || CASE WHEN track_id % 2 = 0 THEN '[ti:T x]' || chr(10) ELSE '' END || '[ve:1]' || chr(10) || '[aa:z]' || chr(10) || '[zz:y]' AS header FROM sl""")
def b4(spark, d):
    pairs = F.create_map(F.lit("zz"), F.lit("y"), F.lit("ve"), F.lit("1"), F.lit("offset"), F.lit("5"), F.lit("ti"), F.when(F.col("track_id") % 2 == 0, "T\nx").otherwise(""), F.lit("aa"), F.lit("z"), F.lit("ar"), F.concat(F.lit("A "), F.col("track_id").cast("string")))
    return lines(spark, d).select("track_id").distinct().select("track_id", serialize.header(pairs).alias("header"))


@query("B5_bundle", BUNDLE, f"""SELECT track_id, sha256(string_agg('[' || {stamp('s')} || ']' || text, chr(10) ORDER BY line_idx)) AS lrc, sha256(string_agg('[' || {stamp('s')} || ']' || exact, chr(10) ORDER BY line_idx)) AS elrc,
  sha256(string_agg('[' || {stamp('s', 2)} || ']' || compat, chr(10) ORDER BY line_idx)) AS elrc_compatible FROM wl GROUP BY track_id""")
def b5(spark, d):
    return serialize.bundle(word_lines(spark, d)).select("track_id", *(F.sha2(c, 256).alias(c) for c in ("lrc", "elrc", "elrc_compatible")))


@query("B6_payload", SL, """SELECT track_id, '{"track_id":' || track_id || ',"lines":' || count(*) || ',"words":' || sum(n_words) || ',"duration_ms":' || max(end_ms) || '}' AS payload FROM sl GROUP BY track_id""")
def b6(spark, d):
    g = lines(spark, d).groupBy("track_id").agg(F.count("*").alias("lines"), F.sum("n_words").alias("words"), F.max("end_ms").alias("duration_ms"))
    return g.select("track_id", F.to_json(F.struct("track_id", "lines", "words", "duration_ms")).alias("payload"))


@query("J1_parse_time", SW, "SELECT track_id, seq, CASE WHEN k % 10 <> 0 THEN start_ms // 10 * 10 END AS ms FROM sw")
def j1(spark, d):
    shown = F.when(F.col("k") % 10 == 0, F.lit("1:99.5x")).when(F.col("k") % 2 == 0, F.regexp_replace(timing.format_time(F.expr("start_ms div 10 * 10"), 2), r"\.", ":")).otherwise(timing.format_time(F.expr("start_ms div 10 * 10"), 3))
    return sung_words(spark, d).select("track_id", "seq", timing.parse_time(shown).alias("ms"))


@query("J2_format_time", SW, f"SELECT track_id, seq, {stamp('start_ms * 37')} AS exact, {stamp('start_ms * 37', 2)} AS short FROM sw")
def j2(spark, d):
    ms = F.col("start_ms") * 37
    return sung_words(spark, d).select("track_id", "seq", timing.format_time(ms).alias("exact"), timing.format_time(ms, 2).alias("short"))


@query("J3_inline", SL, """SELECT track_id, line_idx, word_idx, word, s AS start_ms, coalesce(lead(s) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx), CASE WHEN line_idx % 3 = 0 THEN CASE WHEN end_ms > s THEN end_ms END END) AS end_ms
FROM (SELECT sw.track_id, sw.line_idx, word_idx, word, sl.end_ms, CASE WHEN word_idx = 0 AND sw.line_idx % 2 = 0 THEN anchor_ms ELSE sw.start_ms END AS s FROM sw JOIN sl ON sl.track_id = sw.track_id AND sl.line_idx = sw.line_idx WHERE n_words > 1 OR sw.line_idx % 2 = 1 OR sw.line_idx % 3 = 0)""")
def j3(spark, d):
    """In even lines the first word has no stamp of its own; every third line has a terminal stamp. A line without any is no word-timed line."""
    mark = F.concat(F.lit("<"), timing.format_time(F.col("start_ms")), F.lit(">"), "word")
    shown = F.when((F.col("word_idx") == 0) & (F.col("line_idx") % 2 == 0), F.col("word")).otherwise(mark)
    each = sung_words(spark, d).groupBy("track_id", "line_idx").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", shown.alias("x")))), lambda x: x["x"]), " ").alias("body"), (F.min("seq") * 400).alias("anchor_ms"), F.max("end_ms").alias("end_ms")
    )
    body = F.concat("body", F.when(F.col("line_idx") % 3 == 0, F.concat(F.lit(" <"), timing.format_time(F.col("end_ms")), F.lit(">"))).otherwise(""))
    got = each.select("track_id", "line_idx", F.posexplode(parse.inline_words(body, F.col("anchor_ms"))).alias("word_idx", "w"))
    return got.select("track_id", "line_idx", F.col("word_idx").cast("long").alias("word_idx"), "w.word", "w.start_ms", "w.end_ms")


@query("J4_offset", LT, "SELECT track_id, min(start_ms) AS first_ms, max(start_ms) AS last_ms FROM ln GROUP BY track_id")
def j4(spark, d):
    return parse.timed_lines(lyric_texts(spark, d)).groupBy("track_id").agg(F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"))


@query("J7_norm", None, "SELECT conv_id, turn, regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}'']', '', 'g') AS norm FROM conversations")
def j7(spark, d):
    return turns(spark, d).select("conv_id", "turn", tx.norm_token(F.coalesce("text", F.lit(""))).alias("norm"))


@query("J8_clamp", SW, "SELECT track_id, seq, least(greatest((k - 20) / 60.0, 0.0), 1.0) AS c, round(100 * conf, 2) AS pct FROM sw")
def j8(spark, d):
    return sung_words(spark, d).select("track_id", "seq", timing.clamp01((F.col("k") - 20) / 60.0).alias("c"), timing.percent(F.col("conf")).alias("pct"))


@query("C15_defensive_cast", SW, "SELECT track_id, seq, CASE WHEN k % 4 = 0 THEN k::DOUBLE ELSE -1.0 END AS n FROM sw")
def c15(spark, d):
    raw = F.when(F.col("k") % 4 == 0, F.col("k").cast("string")).when(F.col("k") % 4 == 1, "NaN").when(F.col("k") % 4 == 2, "Infinity").otherwise("12x")
    return sung_words(spark, d).select("track_id", "seq", timing.number(raw, F.lit(-1.0)).alias("n"))


@query("J9_search_text", SAID, r"SELECT conv_id, turn, regexp_replace(regexp_replace(translate(replace(t, 'e', '’'), '’–—', '''--'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM h")
def j9(spark, d):
    return said(spark, d).select("conv_id", "turn", tx.search_text(F.replace("t", F.lit("e"), F.lit("’"))).alias("s"))


@query("J10_deobfuscate", SAID, r"SELECT conv_id, turn, regexp_replace(t, '\bd[@4]mn\b', 'damn', 'gi') || ' shit bitch a$$' AS s FROM h")
def j10(spark, d):
    return said(spark, d).select("conv_id", "turn", tx.deobfuscate_title(F.concat("t", F.lit(" Sh!*t b#tch a$$"))).alias("s"))


@query("J11_strip_notes", SAID, r"SELECT conv_id, turn, regexp_replace('x' || regexp_replace(t, '[()\[\]]', '', 'g'), '^\s+|\s+$', '', 'g') AS s FROM h")
def j11(spark, d):
    noted = F.concat(F.lit("x"), F.regexp_replace("t", r"[()\[\]]", ""), F.lit(" (Official Music Video) [HD] (lyrics video) [Remastered 2011]"))
    return said(spark, d).select("conv_id", "turn", tx.strip_notes(noted).alias("s"))


@query("J12_title_variants", SAID, "SELECT conv_id, count(*) AS n, sum(CASE WHEN turn % 2 = 0 THEN 3 ELSE 1 END) AS variants FROM h GROUP BY conv_id")
def j12(spark, d):
    title = F.concat(F.lit("song "), F.col("turn").cast("string"), F.lit(" "), F.col("t"), F.when(F.col("turn") % 2 == 0, " sh!t [Official Video]").otherwise(""))
    return said(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.size(tx.title_variants(title))).alias("variants"))


@query("J13_similarity")
def j13(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return said(spark, d).withColumn("_p", F.lag("t").over(w)).where("_p is not null").select("conv_id", "turn", F.round(tx.similarity(F.col("t"), F.col("_p")), 9).alias("similarity"))


@query("J14_match_score", SW, "SELECT track_id, seq, round(0.58 * conf + 0.30 * coalesce(CASE WHEN k % 3 <> 0 THEN conf END, 0.75) + 0.12 * 0.75 + CASE WHEN k % 2 = 0 THEN 0.1 ELSE 0 END, 6) AS score FROM sw")
def j14(spark, d):
    artist = F.when(F.col("k") % 3 != 0, F.col("conf"))
    return sung_words(spark, d).select("track_id", "seq", F.round(search.match_score(F.col("conf"), artist, F.lit(None).cast("double"), F.col("k") % 2 == 0), 6).alias("score"))


@query("J15_sentences", None, r"""SELECT conv_id, turn, len(list_filter(CASE WHEN len(l) > 1 THEN l ELSE regexp_split_to_array(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)) END, lambda x: regexp_matches(x, '\S'))) AS n
  FROM (SELECT conv_id, turn, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r]'), lambda x: regexp_matches(x, '\S')) AS l FROM conversations)""")
def j15(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.size(tx.sentences(F.coalesce("text", F.lit("")))).cast("long").alias("n"))


@query("J16_deobfuscate_word", SW, """SELECT track_id, seq, CASE k % 5 WHEN 0 THEN 'shit' WHEN 1 THEN word || 'a' WHEN 2 THEN word || 's' WHEN 3 THEN word ELSE word || 'i' END AS w FROM sw""")
def j16(spark, d):
    k = F.col("k") % 5
    shown = F.when(k == 0, "Sh!T").when(k == 1, F.concat("word", F.lit("@"))).when(k == 2, F.concat(F.upper("word"), F.lit("$"))).when(k == 3, F.concat("word", F.lit("#*"))).otherwise(F.concat("word", F.lit("!")))
    return sung_words(spark, d).select("track_id", "seq", tx.deobfuscate_word(shown).alias("w"))


@query("J17_clean_romanized", None, "SELECT conv_id, turn, regexp_replace(strip_accents(replace(lower(replace(replace(text, '’', ''''), '`', '''')), 'ß', 'ss')), '[^a-z'']', '', 'g') AS s FROM conversations")
def j17(spark, d):
    return turns(spark, d).select("conv_id", "turn", tx.clean_romanized(F.col("text")).alias("s"))


@query("J19_tokens", None, r"""SELECT conv_id, turn, i - 1 AS word_idx, w AS word, (sum(length(w)) OVER (PARTITION BY conv_id, turn ORDER BY i) - length(w))::BIGINT AS token_start FROM
  (SELECT conv_id, turn, unnest(regexp_extract_all(coalesce(text, ''), '\S+')) AS w, generate_subscripts(regexp_extract_all(coalesce(text, ''), '\S+'), 1) AS i FROM conversations)""")
def j19(spark, d):
    t = turns(spark, d).select("conv_id", "turn", F.posexplode(tx.tokens(F.col("text"))).alias("word_idx", "word"))
    run = Window.partitionBy("conv_id", "turn").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.select("conv_id", "turn", F.col("word_idx").cast("long").alias("word_idx"), "word", (F.sum(F.length("word")).over(run) - F.length("word")).alias("token_start"))


@query("J20_iso3", None, "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' END AS code, 'ron' AS other, NULL::VARCHAR AS none FROM documents")
def j20(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.iso3(F.col("lang")).alias("code"), tx.iso3(F.lit(" RUM ")).alias("other"), tx.iso3(F.lit("xx")).alias("none"))


@query("J22_separation_mode", SW, "SELECT track_id, seq, CASE k % 4 WHEN 0 THEN 'on' WHEN 1 THEN 'off' ELSE 'auto' END AS mode FROM sw")
def j22(spark, d):
    k = F.col("k") % 4
    return sung_words(spark, d).select("track_id", "seq", tx.separation_mode(F.when(k == 0, " Yes").when(k == 1, "0").when(k == 2, "adaptive").otherwise("what")).alias("mode"))


@query("J23_footer", SAID, f"SELECT conv_id, turn, {TRIM.format('t')} AS s FROM h")
def j23(spark, d):
    foot = F.when(F.col("turn") % 2 == 0, "\n\n******* not for commercial use").otherwise("\n\n(Source: somewhere)")
    return said(spark, d).select("conv_id", "turn", tx.without_footer(F.concat("t", foot)).alias("s"))


@query("J24_safe_name", None, r"""SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\|?*$`]', '', 'g'), '^\s+|[. ]+$', '', 'g') AS s FROM pages""")
def j24(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tx.safe_name(F.col("url")).alias("s"))


@query("J26_data_uri", None, "SELECT page_id, 'data:image/jpeg;base64,' || base64(encode(url)) AS uri, replace(url || '/100x100.jpg', '100x100', '600x600') AS cover FROM pages")
def j26(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tx.data_uri(F.col("url").cast("binary")).alias("uri"), tx.larger_cover(F.concat("url", F.lit("/100x100.jpg"))).alias("cover"))


@query("J27_json", None, "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def j27(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("H17_units", SW, "SELECT track_id, seq, round(greatest(1.0, length(word) * 0.72 + length(regexp_replace(word, '[^aeiouy]', '', 'g')) * 0.28), 6)::DOUBLE AS units FROM sw")
def h17(spark, d):
    return sung_words(spark, d).select("track_id", "seq", F.round(tx.word_units(F.col("word")), 6).alias("units"))


@query("A7_artist_title", SW, "SELECT track_id, seq, CASE k % 3 WHEN 2 THEN '' ELSE 'Band ' || k END AS artist, word || ' song' AS title FROM sw")
def a7(spark, d):
    mark = F.when(F.col("k") % 3 == 0, F.concat(F.lit("Band "), F.col("k").cast("string"), F.lit(" - "))).when(F.col("k") % 3 == 1, F.concat(F.lit("Band "), F.col("k").cast("string"), F.lit("_-_"))).otherwise("")
    artist, title = tx.artist_title(F.concat(mark, "word", F.lit(" song"), F.when(F.col("k") % 2 == 0, " (live).mp3").otherwise("_SkySound.com.flac")))
    return sung_words(spark, d).select("track_id", "seq", artist.alias("artist"), title.alias("title"))


@query("A13_upload_guard", None, "SELECT doc_id, doc_id % 3 <> 2 AND strlen(coalesce(text, '')) <= 5000 AS allowed FROM documents")
def a13(spark, d):
    name = F.concat(F.lit("f."), F.when(F.col("doc_id") % 3 == 0, "LRC").when(F.col("doc_id") % 3 == 1, "txt").otherwise("exe"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.allowed_upload(name, F.coalesce("text", F.lit("")), 5000).alias("allowed"))


@query("A14_runtime", None, "SELECT 'cantabile' AS engine, 3::BIGINT AS profiles")
def a14(spark, d):
    from cantabile.schema import profiles

    return profiles(spark).agg(F.lit("cantabile").alias("engine"), F.count("*").alias("profiles")).select("engine", "profiles")


@query("A2_manifest", SL, """SELECT 'case ' || track_id AS "case", config FROM (SELECT DISTINCT track_id FROM sl), (VALUES ('mix-fast'), ('mix-balanced'), ('auto-max'), ('vocals-balanced')) m(config)""")
def a2(spark, d):
    one = F.struct(F.concat(F.lit("case "), F.col("track_id").cast("string")).alias("name"), *(F.lit("x").alias(c) for c in ("audio", "lyrics", "reference", "language")))
    manifest = lines(spark, d).select("track_id").distinct().select(F.array(one).alias("cases"), F.array().cast("array<struct<name:string,use_demucs:string,quality_mode:string>>").alias("matrix"))
    return manifest_cases(manifest).select("case", "config")


@query("A3_score_files", LT, "SELECT track_id, count(*) AS matched, round(avg(30 + line_idx % 3 * 10), 6) AS mae FROM ln GROUP BY track_id")
def a3(spark, d):
    """Both texts are parsed and compared line by line; the candidate's lines are 30 to 50 ms late."""
    ref = parse.timed_lines(lyric_texts(spark, d)).select("track_id", "line_idx", F.col("start_ms").alias("_a"))
    late = serialize.joined(ref, F.concat(F.lit("["), timing.format_time(F.col("_a") + 30 + F.col("line_idx") % 3 * 10), F.lit("]x")), "raw")
    cand = parse.timed_lines(late).select("track_id", "line_idx", F.col("start_ms").alias("_b"))
    both = compare.positional(ref, cand, ["track_id", "line_idx"]).withColumn("error", (F.col("_b") - F.col("_a")).cast("double"))
    return compare.error_metrics(both, ["track_id"], "error").select("track_id", "matched", "mae")


def tagged(spark, d):
    """Every turn as the bytes of a sound file: its text is the title, in a tag of version 2 to 4; every fifth plain one has a trailing tag alone."""
    four = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    seven = lambda n: four(reduce(lambda a, i: a.bitwiseOR(F.shiftleft(F.shiftright(n, 7 * i).bitwiseAND(127), 8 * i)), (1, 2, 3), n.bitwiseAND(127)))
    t, version = F.col("t"), 2 + (F.col("conv_id") % 3).cast("int")
    marked = lambda first, text, coding: F.concat(F.lit(first), F.encode(text, coding))
    title = F.when(F.col("turn") % 4 == 1, marked(b"\1\xff\xfe", t, "UTF-16LE")).when(F.col("turn") % 4 == 2, marked(b"\2", t, "UTF-16BE"))
    title = title.when((F.col("turn") % 4 == 3) & F.col("plain"), marked(b"\0", t, "UTF-8")).otherwise(marked(b"\3", t, "UTF-8"))
    artist = marked(b"\3", F.format_string("Conversation %d", "conv_id"), "UTF-8")

    def frame(names, content, n):
        sized = F.when(version == 3, four(n)).otherwise(seven(n))
        return F.when(version == 2, F.concat(F.lit(names[0]), F.substring(four(n), 2, 3), content)).otherwise(F.concat(F.lit(names[1]), sized, F.lit(b"\0\0"), content))

    rows = said(spark, d).withColumn("plain", F.length("t") == F.octet_length("t")).withColumns({"title": title, "artist": artist})
    # a step for each size, as an expression that holds the whole text many times over is too long to be compiled
    rows = rows.withColumns({"title_size": F.octet_length("title"), "artist_size": F.octet_length("artist")})
    rows = rows.withColumns({"title": frame((b"TT2", b"TIT2"), F.col("title"), F.col("title_size")), "artist": frame((b"TP1", b"TPE1"), F.col("artist"), F.col("artist_size"))})
    rows = rows.withColumn("body", F.concat(frame((b"COM", b"COMM"), F.lit(b"\0note"), F.lit(5)), "title", "artist")).withColumn("size", F.octet_length("body"))
    leading = F.concat(F.lit(b"ID3"), F.substring(four(version), 4, 1), F.lit(b"\0\0"), seven(F.col("size")), "body", F.lit(b"\xff\xfb" * 100))
    trailing = F.concat(F.lit(b"\xff\xfb" * 100 + b"TAG"), F.rpad(F.substring(F.encode(t, "UTF-8"), 1, 30), 125, F.lit(b"\0")))
    return rows.select("conv_id", "turn", F.when(F.col("plain") & (F.col("turn") % 5 == 0), trailing).otherwise(leading).alias("content"))


@query("A6_tags", SAID, r"""SELECT conv_id, turn, regexp_replace(CASE WHEN old THEN left(t, 30) ELSE t END, '^\s+|\s+$', '', 'g') AS title, CASE WHEN old THEN '' ELSE 'Conversation ' || conv_id END AS artist, '' AS album
  FROM (SELECT *, strlen(t) = length(t) AND turn % 5 = 0 AS old FROM h)""")
def a6(spark, d):
    return with_tags(tagged(spark, d))


FOUND = SL + """,
pr AS (SELECT track_id, provider, CASE WHEN (track_id + n) % 4 = 0 THEN 3 WHEN (track_id + n) % 4 = 1 THEN 2 ELSE 1 END AS richness, provider || ' text' AS raw, n AS position
  FROM (SELECT DISTINCT track_id FROM sl), (VALUES ('Other', 0), ('BetterLyrics', 1), ('Musixmatch', 2), ('NetEase', 3), ('LRCLIB', 4)) p(provider, n))"""


def found(spark, d):
    p = spark.createDataFrame([("Other", 0), ("BetterLyrics", 1), ("Musixmatch", 2), ("NetEase", 3), ("LRCLIB", 4)], "provider string, position long")
    each = lines(spark, d).select("track_id").distinct().join(F.broadcast(p))
    n = (F.col("track_id") + F.col("position")) % 4
    return each.withColumn("richness", search.richness(F.when(n == 0, 5).otherwise(0), F.when(n <= 1, 5).otherwise(0))).withColumn("raw", F.concat("provider", F.lit(" text")))


@query("G3_provider_rank", FOUND, "SELECT track_id, arg_max(provider, richness * 10 + CASE provider WHEN 'LRCLIB' THEN 4 WHEN 'NetEase' THEN 3 WHEN 'Musixmatch' THEN 2 WHEN 'BetterLyrics' THEN 1 ELSE 0 END) AS provider, max(richness) AS richness FROM pr GROUP BY track_id")
def g3(spark, d):
    return search.best_provider(found(spark, d), ["track_id"]).select("track_id", "provider", "richness")


@query("J21_richness", FOUND, "SELECT track_id, provider, richness FROM pr")
def j21(spark, d):
    return found(spark, d).select("track_id", "provider", "richness")


@query("G4_first_hit", FOUND, "SELECT track_id, arg_min(raw, position) AS raw, min(position)::BIGINT AS position FROM pr WHERE richness > 1 GROUP BY track_id")
def g4(spark, d):
    return search.first_hit(found(spark, d).withColumn("raw", F.when(F.col("richness") > 1, F.col("raw")).otherwise("")), ["track_id"], "raw", "position")


@query("G2_topk_similarity")
def g2(spark, d):
    """Of the first turn of each conversation the two later turns that are most like it."""
    first = said(spark, d).groupBy("conv_id").agg(F.min_by("t", "turn").alias("asked_title"), F.min("turn").alias("_first"))
    hits = said(spark, d).select("conv_id", F.col("turn").alias("position"), F.col("t").alias("title")).join(first, "conv_id").where("position > _first")
    return search.best_match(hits, ["conv_id"], 0.3, 2).select("conv_id", "position", F.round("score", 9).alias("score"), "place")


@query("G2_full_match")
def g2_full(spark, d):
    """Of the first turn of each conversation, said by its speaker about its source, the later turn that is most like it in all of these; long ones count as timed."""
    first = said_by(spark, d).groupBy("conv_id").agg(*(F.min_by(c, "turn").alias(f"asked_{c}") for c in ("title", "artist", "album")), F.min("turn").alias("_first"))
    hits = said_by(spark, d).withColumnRenamed("turn", "position").join(first, "conv_id").where("position > _first").withColumn("synced", F.length("title") > 200)
    return search.best_match(hits, ["conv_id"]).select("conv_id", "position", F.round("score", 9).alias("score"))


def said_by(spark, d):
    """Turns as songs: the text, its speaker, and, for every other one, its first word as the album."""
    album = F.when(F.col("turn") % 2 == 0, F.regexp_extract(F.coalesce("text", F.lit("")), r"\w+", 0))
    return turns(spark, d).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("title"), F.col("role").alias("artist"), album.alias("album"))


@query("K5_progress", SW, "SELECT track_id, seq, CASE WHEN k < 10 THEN 'waiting' WHEN k < 30 THEN 'step1' WHEN k < 70 THEN 'step2' WHEN k < 95 THEN 'step3' ELSE 'done' END AS step FROM sw")
def k5(spark, d):
    return sung_words(spark, d).select("track_id", "seq", timing.progress_step(F.col("k")).alias("step"))


@query("K3_events", SW, "SELECT track_id, count(*) AS n, sum(k)::DOUBLE AS total FROM sw GROUP BY track_id")
def k3(spark, d):
    from cantabile.streaming.progress import parse_events

    frame = F.concat(F.lit('data: {"type": "progress", "percent": '), F.col("k").cast("string"), F.lit(', "message": "'), F.col("track_id").cast("string"), F.lit('"}'))
    frames = sung_words(spark, d).groupBy("track_id", "line_idx").agg(F.array_join(F.collect_list(frame), "\n\n").alias("value"))
    return parse_events(frames).groupBy(F.col("message").cast("long").alias("track_id")).agg(F.count("*").alias("n"), F.sum("percent").alias("total"))


def cached(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.format_string("%08d", "doc_id").alias("cache_key"), F.col("text").alias("payload"), F.col("n_chars").alias("byte_size"), F.col("doc_id").alias("created_at"), ((F.col("doc_id") * 7919) % 100003).alias("last_access"), (F.col("doc_id") % 5).alias("schema_version"))


CACHE = "ca AS (SELECT printf('%08d', doc_id) AS cache_key, text AS payload, n_chars AS byte_size, doc_id AS created_at, doc_id * 7919 % 100003 AS last_access, doc_id % 5 AS schema_version FROM documents)"


@query("L3_lookup", CACHE, "SELECT printf('%08d', doc_id * 2) AS cache_key, payload FROM documents LEFT JOIN (SELECT * FROM ca WHERE schema_version = 2) ca ON ca.cache_key = printf('%08d', doc_id * 2)")
def l3(spark, d):
    keys = spark.read.parquet(f"{d}/documents.parquet").select(F.format_string("%08d", F.col("doc_id") * 2).alias("cache_key"))
    return cache.lookup(cached(spark, d), keys, 2)


@query("L4_misses", CACHE, "SELECT printf('%08d', doc_id * 2) AS cache_key FROM documents WHERE printf('%08d', doc_id * 2) NOT IN (SELECT cache_key FROM ca WHERE schema_version = 2)")
def l4(spark, d):
    keys = spark.read.parquet(f"{d}/documents.parquet").select(F.format_string("%08d", F.col("doc_id") * 2).alias("cache_key"))
    return cache.misses(cached(spark, d), keys, 2)


@query("L5_touch", CACHE, "SELECT cache_key, CASE WHEN created_at % 3 = 0 THEN 999999 ELSE last_access END AS last_access FROM ca")
def l5(spark, d):
    return cache.touch(cached(spark, d), cached(spark, d).where("created_at % 3 = 0"), F.lit(999999).cast("long")).select("cache_key", "last_access")


@query("L6_upsert", CACHE, "SELECT cache_key, created_at, CASE WHEN created_at % 4 = 0 THEN 999999 ELSE last_access END AS last_access, CASE WHEN created_at % 4 = 0 THEN 'new' ELSE payload END AS payload FROM ca")
def l6(spark, d):
    new = cached(spark, d).where("created_at % 4 = 0").withColumns({"payload": F.lit("new"), "last_access": F.lit(999999).cast("long"), "created_at": F.lit(888888).cast("long")})
    return cache.upsert(cached(spark, d), new).select("cache_key", "created_at", "last_access", "payload")


@query("L7_stats", CACHE, "SELECT count(*) AS entries, coalesce(sum(byte_size), 0)::BIGINT AS total_bytes FROM ca")
def l7(spark, d):
    return cache.stats(cached(spark, d))


@query("L8_stale", CACHE, "SELECT cache_key FROM ca WHERE schema_version = 3")
def l8(spark, d):
    return cache.without_stale(cached(spark, d), 3).select("cache_key")


@query("L9_clear", CACHE, "SELECT count(*) AS removed FROM ca")
def l9(spark, d):
    return cache.clear(cached(spark, d))[1]


@query("M3_through_cache", CACHE, "SELECT printf('%08d', doc_id * 2) AS cache_key, coalesce(payload, 'made') AS payload, payload IS NOT NULL AS hit FROM documents LEFT JOIN (SELECT * FROM ca WHERE schema_version = 2) ca ON ca.cache_key = printf('%08d', doc_id * 2)")
def m3(spark, d):
    """A job given its cache: what is there is not made again."""
    asked = spark.read.parquet(f"{d}/documents.parquet").select(F.format_string("%08d", F.col("doc_id") * 2).alias("cache_key"))
    return cache.through(cached(spark, d), asked, 2, lambda todo: todo.withColumn("payload", F.lit("made")), F.lit(0).cast("long"))[0]


@query("M4_providers", None, "SELECT conv_id, CASE WHEN max(turn) >= 3 THEN 'NetEase' ELSE 'LRCLIB' END AS provider FROM conversations GROUP BY conv_id")
def m4(spark, d):
    """Two providers as functions: one finds line times for longer conversations, one plain text for all."""
    asked = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.max("turn").alias("last"))
    timed = lambda q: q.where("last >= 3").select("conv_id", search.richness(F.lit(0), F.lit(1)).alias("richness"), F.lit("[00:01]a").alias("raw"))
    plain = lambda q: q.select("conv_id", search.richness(F.lit(0), F.lit(0)).alias("richness"), F.lit("a").alias("raw"))
    return search.best_provider(search.search_all(asked, [("LRCLIB", plain), ("NetEase", timed)]), ["conv_id"]).select("conv_id", "provider")


@query("J18_romanize")
def j18(spark, d):
    """Words of every turn through a table of romanizations, with where each begins in the line's letters."""
    table = tx.table_romanizer({"the": "de", "and": "end"})
    t = turns(spark, d).select("conv_id", "turn", F.posexplode(tx.normalized_words(F.col("text"), table)).alias("word_idx", "_w"))
    run = Window.partitionBy("conv_id", "turn").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.length("_w.normalized")
    return t.select("conv_id", "turn", "word_idx", "_w.*", F.when(n > 0, F.sum(n).over(run) - n).alias("token_start"))


@query("F19_lru_evict", CACHE, """SELECT cache_key, byte_size FROM (SELECT *, sum(byte_size) OVER () AS total, coalesce(sum(byte_size) OVER (ORDER BY last_access, cache_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ca)
  WHERE NOT (total > 500000 AND total - before > 425000)""")
def f19(spark, d):
    return cache.evict(cached(spark, d), 500_000).select("cache_key", "byte_size")


@query("E17_fingerprint", LT, "SELECT track_id, sha256(string_agg(start_ms || '|' || text, chr(10) ORDER BY line_idx)) AS fingerprint FROM ln GROUP BY track_id")
def e17(spark, d):
    return cache.fingerprint(parse.timed_lines(lyric_texts(spark, d)).withColumnRenamed("start_ms", "anchor_ms"))


@query("E18_issue_distinct", SW, "SELECT track_id, string_agg(x, ',' ORDER BY f) AS issues FROM (SELECT track_id, origin AS x, min(seq) AS f FROM sw GROUP BY track_id, origin) GROUP BY track_id")
def e18(spark, d):
    told = F.transform(F.sort_array(F.collect_list(F.struct("seq", "origin"))), lambda x: x["origin"])
    return sung_words(spark, d).groupBy("track_id").agg(F.array_join(F.array_distinct(told), ",").alias("issues"))


@query("P1_seed_words", LT, r"""SELECT track_id, line_idx, i - 1 AS word_idx, w AS word, start_ms + span * (i - 1) // n AS start_ms, start_ms + span * i // n AS end_ms FROM
  (SELECT *, len(t) AS n, unnest(t) AS w, generate_subscripts(t, 1) AS i, CASE WHEN nxt > start_ms THEN nxt ELSE start_ms + greatest(1000, 350 * len(t)) END - start_ms AS span FROM
  (SELECT *, regexp_extract_all(text, '\S+') AS t, lead(start_ms) OVER (PARTITION BY track_id ORDER BY line_idx) AS nxt FROM ln))""")
def p1(spark, d):
    return editor.seed_words(parse.timed_lines(lyric_texts(spark, d)).withColumn("end_ms", F.lit(None).cast("long"))).withColumns({"word_idx": F.col("word_idx").cast("long"), "line_idx": F.col("line_idx").cast("long")})


@query("P2_add_delete", SW, """SELECT track_id, count(*) AS words, max(end_ms) AS last_ms FROM (SELECT track_id, end_ms FROM sw WHERE line_idx <> 1 UNION ALL SELECT track_id, arg_max(end_ms, word_idx) + 400 FROM sw WHERE line_idx <> 1 GROUP BY track_id, line_idx) GROUP BY track_id""")
def p2(spark, d):
    grown = editor.add_word(editor.delete_line(sung_words(spark, d), F.lit(1)))
    return grown.groupBy("track_id").agg(F.count("*").alias("words"), F.max("end_ms").alias("last_ms"))


@query("P3_split", SW, """SELECT track_id, seq, CASE WHEN line_idx > 2 OR (line_idx = 2 AND word_idx >= 3) THEN line_idx + 1 ELSE line_idx END AS line_idx, CASE WHEN line_idx = 2 AND word_idx >= 3 THEN word_idx - 3 ELSE word_idx END AS word_idx FROM sw""")
def p3(spark, d):
    return editor.split_line(sung_words(spark, d), F.lit(2), F.lit(3)).select("track_id", "seq", "line_idx", "word_idx")


@query("P4_set_boundary", SW, """SELECT track_id, seq, CASE WHEN word_idx = 2 THEN w ELSE start_ms END AS start_ms, CASE WHEN nx = 2 THEN nw ELSE end_ms END AS end_ms FROM
  (SELECT *, lead(word_idx) OVER o AS nx, lead(w) OVER o AS nw FROM (SELECT *, least(greatest(seq * 400 + 33, coalesce(lag(start_ms) OVER o + 10, 0)), end_ms - 10) AS w FROM sw WINDOW o AS (PARTITION BY track_id, line_idx ORDER BY word_idx)) WINDOW o AS (PARTITION BY track_id, line_idx ORDER BY word_idx))""")
def p4(spark, d):
    return editor.set_boundary(sung_words(spark, d), F.lit(2), F.col("seq") * 400 + 33).select("track_id", "seq", "start_ms", "end_ms")


@query("P5_offset", SW, "SELECT track_id, seq, greatest(0, start_ms - 700) AS start_ms, greatest(0, end_ms - 700) AS end_ms FROM sw")
def p5(spark, d):
    return editor.shift(sung_words(spark, d), F.lit(-700), ["start_ms", "end_ms"]).select("track_id", "seq", "start_ms", "end_ms")


@query("P6_nudge", SW, "SELECT track_id, seq, CASE WHEN k % 2 = 0 THEN start_ms + 10 ELSE greatest(0, start_ms - 100) END AS start_ms FROM sw")
def p6(spark, d):
    return editor.shift(sung_words(spark, d), F.when(F.col("k") % 2 == 0, 10).otherwise(-100), ["start_ms"]).select("track_id", "seq", "start_ms")


VIOLATIONS = SW + """,
vw AS (SELECT *, (seq - word_idx) * 400 + 50 AS ls, lead(start_ms) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx) AS nxt, CASE WHEN k % 20 = 3 THEN ' ' ELSE word END AS w FROM sw),
vv AS (SELECT track_id, line_idx, word_idx, 'empty' AS issue FROM vw WHERE w = ' ' UNION ALL SELECT track_id, line_idx, word_idx, 'before_line' FROM vw WHERE start_ms < ls UNION ALL
  SELECT track_id, line_idx, word_idx, 'bad_interval' FROM vw WHERE NOT end_ms > start_ms UNION ALL SELECT track_id, line_idx, word_idx, 'word_order' FROM vw WHERE nxt < start_ms UNION ALL SELECT track_id, line_idx, word_idx, 'overlap' FROM vw WHERE end_ms > nxt)"""


def checked(spark, d):
    w = sung_words(spark, d).withColumn("line_start_ms", (F.col("seq") - F.col("word_idx")) * 400 + 50)
    return editor.violations(w.withColumn("word", F.when(F.col("k") % 20 == 3, " ").otherwise(F.col("word"))))


@query("P7_validation", VIOLATIONS, "SELECT * FROM vv")
def p7(spark, d):
    return checked(spark, d)


@query("P12_publish_gate", VIOLATIONS, "SELECT track_id, count(i) = 0 AS publishable FROM (SELECT DISTINCT track_id FROM sw) LEFT JOIN (SELECT track_id, issue AS i FROM vv) USING (track_id) GROUP BY track_id")
def p12(spark, d):
    bad = checked(spark, d).select("track_id").distinct().withColumn("_bad", F.lit(True))
    return lines(spark, d).select("track_id").distinct().join(bad, "track_id", "left").select("track_id", F.col("_bad").isNull().alias("publishable"))


@query("P8_client_repair", SW, """SELECT track_id, seq, s AS start_ms, greatest(s + 1, least(coalesce(e, s + 300), coalesce(nxt, coalesce(e, s + 300)))) AS end_ms FROM (SELECT *, CASE WHEN k % 5 <> 0 THEN end_ms END AS e,
  max(greatest((seq - word_idx) * 400 + 50, start_ms)) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS s, lead(start_ms) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx) AS nxt FROM sw)""")
def p8(spark, d):
    w = sung_words(spark, d).withColumn("line_start_ms", (F.col("seq") - F.col("word_idx")) * 400 + 50).withColumn("end_ms", F.when(F.col("k") % 5 != 0, F.col("end_ms")))
    return editor.client_repair(w).select("track_id", "seq", "start_ms", "end_ms")


@query("P9_undo", SW, "SELECT track_id, version, undo FROM (SELECT track_id, seq AS version, row_number() OVER (PARTITION BY track_id ORDER BY seq DESC)::INT - 1 AS undo FROM sw) WHERE undo < 20")
def p9(spark, d):
    return editor.versions(sung_words(spark, d).select("track_id", F.col("seq").alias("version")), 20)


def commands(spark, d):
    """Every event as an editor's command on its track."""
    names = F.element_at(F.array(*(F.lit(c) for c in ("undo", "undo", "redo", "nudge", "text", "shift", "begin", "split", "add", "drop_word", "shift"))), (F.col("k") % 11 + 1).cast("int"))
    at = F.when(names == "shift", F.col("k") - 30).when(names == "nudge", 100 - 3 * F.col("k")).otherwise(F.col("start_ms"))
    return sung_words(spark, d).select("track_id", "seq", names.alias("command"), F.expr("line_idx div 2").alias("line"), F.col("word_idx").alias("word"), at.alias("at"), F.upper("word").alias("text"))


@query("P9_history", SW, """SELECT track_id, u.s AS seq, u.state, u.place FROM (SELECT track_id, unnest(list_concat(list_concat(
    list_transform(kept, lambda x, i: {'s': x, 'state': 'kept', 'place': i - 1}), list_transform(done, lambda x, i: {'s': x, 'state': 'undoable', 'place': len(kept) + i - 1})),
    list_transform(list_reverse(undone), lambda x, i: {'s': x, 'state': 'redoable', 'place': len(kept) + len(done) + i - 1}))) AS u
  FROM (SELECT track_id, arg_max(kept, seq) AS kept, arg_max(done, seq) AS done, arg_max(undone, seq) AS undone FROM (
    WITH RECURSIVE st AS (SELECT track_id, -1::BIGINT AS seq, []::BIGINT[] AS kept, []::BIGINT[] AS done, []::BIGINT[] AS undone FROM sw WHERE seq = 0 UNION ALL
      SELECT track_id, seq, CASE WHEN len(d) > 5 THEN list_append(kept, d[1]) ELSE kept END, CASE WHEN len(d) > 5 THEN d[2:] ELSE d END, n FROM (
        SELECT sw.track_id, sw.seq, st.kept,
          CASE WHEN k % 11 <= 1 THEN done[:len(done) - 1] WHEN k % 11 = 2 THEN CASE WHEN len(undone) > 0 THEN list_append(done, undone[len(undone)]) ELSE done END ELSE list_append(done, sw.seq) END AS d,
          CASE WHEN k % 11 <= 1 THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[len(done)]) ELSE undone END WHEN k % 11 = 2 THEN undone[:len(undone) - 1] ELSE [] END AS n
        FROM st JOIN sw ON sw.track_id = st.track_id AND sw.seq = st.seq + 1)) SELECT * FROM st) GROUP BY track_id))""")
def p9_history(spark, d):
    """Which commands hold after all undo and redo, five deep."""
    return edit_log.standing(commands(spark, d), 5).select("track_id", "seq", "state", "place")


@query("P9_replay")
def p9_replay(spark, d):
    """The words as the standing commands leave them."""
    return edit_log.replay(sung_words(spark, d), edit_log.standing(commands(spark, d)))


@query("P10_move_line", SL, "SELECT track_id, line_idx, start_ms + 40 AS start_ms, greatest(0, anchor_ms + 40) AS display_ms FROM sl")
def p10(spark, d):
    return editor.move_line(lines(spark, d).withColumn("display_ms", F.col("anchor_ms")), F.col("start_ms") + 40).select("track_id", "line_idx", "start_ms", "display_ms")


@query("P11_edit_time", SW, "SELECT track_id, seq, CASE WHEN k % 3 = 0 THEN start_ms ELSE 65250 END AS start_ms FROM sw")
def p11(spark, d):
    return sung_words(spark, d).select("track_id", "seq", editor.edit_time(F.col("start_ms"), F.when(F.col("k") % 3 == 0, "soon").otherwise("1:05.25")).alias("start_ms"))
