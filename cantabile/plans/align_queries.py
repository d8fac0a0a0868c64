"""Queries on alignment, scores, selection, tempo, consensus and rescue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantabile.functions.text import tokens, word_units
from cantabile.operators import align, compare, onset, ordered, passes as steps, quality, rescue
from cantabile.operators.ordered import by_line, by_track
from cantabile.plans.ordered_queries import lines
from cantabile.plans.sql import SL, SW, with_
from cantabile.schema import REASONS, profile, profiles
from cantabile.sources.files import manifest_cases
from cantabile.sources.views import sung_frames, sung_samples, sung_texts, sung_words

QUERIES, ORACLES = {}, {}
LINE = ["track_id", "line_idx"]


def query(name: str, views: str | None = None, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_(views, sql) if views else sql
        return f

    return keep


PASSES = SW + ", ps AS (SELECT track_id, seq, line_idx, word_idx, p AS pass_idx, start_ms + (seq * 37 + p * 53) % 400 - 200 AS start_ms, end_ms + (seq * 37 + p * 53) % 400 - 200 AS end_ms, (k + p * 7) % 100 AS kk, ((k + p * 7) % 100) / 100.0 AS conf FROM sw, (VALUES (0), (1), (2)) v(p))"


def passes(spark: SparkSession, d: str) -> DataFrame:
    """Three passes over the same words, shifted by up to 200 ms each."""
    off = (F.col("seq") * 37 + F.col("pass_idx") * 53) % 400 - 200
    each = sung_words(spark, d).withColumn("pass_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return each.select("track_id", "seq", "line_idx", "word_idx", "pass_idx", (F.col("start_ms") + off).alias("start_ms"), (F.col("end_ms") + off).alias("end_ms"), (((F.col("k") + F.col("pass_idx") * 7) % 100) / 100.0).alias("conf"))


@query("E10_consensus", PASSES, """, g AS (SELECT track_id, line_idx, word_idx, count(*) AS n, max(start_ms) - min(start_ms) AS spread_ms, avg(conf) AS m, arg_max({'s': start_ms, 'e': end_ms, 'c': conf}, kk * 10 - pass_idx) AS b FROM ps GROUP BY ALL),
s AS (SELECT track_id, line_idx, word_idx, min(start_ms) FILTER (2 * r >= t) AS ws FROM (SELECT *, sum(1500 + kk * kk) OVER (PARTITION BY track_id, line_idx, word_idx ORDER BY start_ms, kk ROWS UNBOUNDED PRECEDING) AS r, sum(1500 + kk * kk) OVER (PARTITION BY track_id, line_idx, word_idx) AS t FROM ps) GROUP BY ALL),
e AS (SELECT track_id, line_idx, word_idx, min(end_ms) FILTER (2 * r >= t) AS we FROM (SELECT *, sum(1500 + kk * kk) OVER (PARTITION BY track_id, line_idx, word_idx ORDER BY end_ms, kk ROWS UNBOUNDED PRECEDING) AS r, sum(1500 + kk * kk) OVER (PARTITION BY track_id, line_idx, word_idx) AS t FROM ps) GROUP BY ALL)
SELECT track_id, line_idx, word_idx, n, spread_ms, CASE WHEN spread_ms <= 155 THEN ws ELSE b.s END AS start_ms, CASE WHEN spread_ms <= 155 THEN we ELSE b.e END AS end_ms,
  round(CASE WHEN spread_ms <= 155 THEN least(0.97, m + 0.025) ELSE b.c END, 9) AS conf, CASE WHEN spread_ms <= 155 THEN 'adaptive_consensus' ELSE 'adaptive_best_pass' END AS origin FROM g JOIN s USING (track_id, line_idx, word_idx) JOIN e USING (track_id, line_idx, word_idx)""")
def e10(spark, d):
    return rescue.consensus(passes(spark, d))


@query("D5_positional_passes", PASSES, "SELECT track_id, line_idx, word_idx, count(*) AS passes, min(start_ms) AS first_ms, max(start_ms) AS last_ms FROM ps WHERE pass_idx = 0 OR word_idx < 4 GROUP BY track_id, line_idx, word_idx")
def d5(spark, d):
    some = passes(spark, d).where("pass_idx = 0 or word_idx < 4")
    return some.groupBy(*LINE, "word_idx").agg(F.count("*").alias("passes"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"))


@query("G6_best_pass", PASSES, "SELECT track_id, line_idx, arg_max(pass_idx, kk * 10 - pass_idx) AS best FROM (SELECT track_id, line_idx, pass_idx, sum(kk) AS kk FROM ps GROUP BY ALL) GROUP BY track_id, line_idx")
def g6(spark, d):
    score = passes(spark, d).groupBy(*LINE, "pass_idx").agg(F.sum(F.round(F.col("conf") * 100)).cast("long").alias("_s"))
    return score.groupBy(*LINE).agg(F.max_by("pass_idx", F.struct("_s", -F.col("pass_idx"))).alias("best"))


CANDIDATES = PASSES + ", cs AS (SELECT track_id, line_idx, pass_idx AS candidate_idx, sum(kk) // 60 AS score, sum(kk) % 7 AS interpolated_ratio, sum(kk) % 3 AS runtime FROM ps GROUP BY ALL)"


@query("G5_best_candidate", CANDIDATES, "SELECT track_id, line_idx, candidate_idx, score FROM cs QUALIFY row_number() OVER (PARTITION BY track_id, line_idx ORDER BY score DESC, interpolated_ratio, runtime, candidate_idx) = 1")
def g5(spark, d):
    total = F.sum(F.round(F.col("conf") * 100)).cast("long")
    cand = passes(spark, d).groupBy(*LINE, F.col("pass_idx").alias("candidate_idx")).agg(total.alias("_s"))
    cand = cand.select(*LINE, "candidate_idx", F.expr("_s div 60").alias("score"), (F.col("_s") % 7).alias("interpolated_ratio"), (F.col("_s") % 3).alias("runtime"))
    return quality.best_candidate(cand, LINE).select(*LINE, "candidate_idx", "score")


HYST = SL + ", nw AS (SELECT track_id, line_idx, start_ms + 5 AS start_ms, n_words + (line_idx * 7 % 5) * 10 - 20 AS s FROM sl WHERE line_idx % 3 = 1)"


@query("G7_hysteresis", HYST, "SELECT sl.track_id, sl.line_idx, CASE WHEN coalesce(s > n_words + 5, false) THEN nw.start_ms ELSE sl.start_ms END AS start_ms, coalesce(s > n_words + 5, false) AS replaced FROM sl LEFT JOIN nw USING (track_id, line_idx)")
def g7(spark, d):
    base = lines(spark, d).select(*LINE, "start_ms", F.col("n_words").alias("score"))
    again = base.where("line_idx % 3 = 1").select(*LINE, (F.col("start_ms") + 5).alias("start_ms"), (F.col("score") + (F.col("line_idx") * 7 % 5) * 10 - 20).alias("score"))
    return align.keep_better(base, again, LINE, "score", 5).select(*LINE, "start_ms", "replaced")


@query("D4_hybrid_merge", HYST, "SELECT sl.track_id, count(*) AS lines, count(*) FILTER (s > n_words + 0) AS vocal FROM sl LEFT JOIN nw USING (track_id, line_idx) GROUP BY sl.track_id")
def d4(spark, d):
    base = lines(spark, d).select(*LINE, "start_ms", F.col("n_words").alias("score"))
    vocal = base.where("line_idx % 3 = 1").select(*LINE, (F.col("start_ms") + 5).alias("start_ms"), (F.col("score") + (F.col("line_idx") * 7 % 5) * 10 - 20).alias("score"))
    return align.keep_better(base, vocal, LINE, "score", 0.01).groupBy("track_id").agg(F.count("*").alias("lines"), F.sum(F.col("replaced").cast("int")).alias("vocal"))


@query("G1_stable_sort", SW, "SELECT track_id, seq, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seq)::INT AS place FROM sw")
def g1(spark, d):
    return sung_words(spark, d).select("track_id", "seq", F.row_number().over(Window.partitionBy("track_id").orderBy("start_ms", "seq")).alias("place"))


@query("G9_slice", SW, "SELECT track_id, line_idx, array_to_string(list(word ORDER BY word_idx)[1:3], ' ') AS lookahead FROM sw GROUP BY track_id, line_idx")
def g9(spark, d):
    ws = F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"])
    return sung_words(spark, d).groupBy(*LINE).agg(F.array_join(F.slice(ws, 1, 3), " ").alias("lookahead"))


LAST = SL + """,
la AS (SELECT track_id, line_idx, arg_max(conf, word_idx) AS c, arg_max(origin, word_idx) AS o, arg_max(start_ms, word_idx) AS s, arg_max(end_ms, word_idx) AS e, median(conf) AS md, min(conf) AS mn, avg((k < 45)::INT) AS wk, round(avg(conf), 9) AS mean, min(start_ms) - min(seq) * 400 AS delta, max(k) AS mk FROM sw GROUP BY track_id, line_idx),
lb AS (SELECT la.*, lead(sl.anchor_ms) OVER w AS na, CASE WHEN la.line_idx % 4 <> 2 THEN lead(sl.start_ms) OVER w END AS ah FROM la JOIN sl USING (track_id, line_idx) WINDOW w AS (PARTITION BY track_id ORDER BY line_idx))"""


def last_words(spark, d):
    g = sung_words(spark, d).groupBy(*LINE).agg(
        F.max_by("conf", "word_idx").alias("last"), F.max_by("origin", "word_idx").alias("origin"), F.max_by("start_ms", "word_idx").alias("last_start"), F.max_by("end_ms", "word_idx").alias("last_end"),
        F.median("conf").alias("median"), F.min("conf").alias("least"), F.avg((F.col("k") < 45).cast("int")).alias("weak"), F.round(F.avg("conf"), 9).alias("conf"),
        (F.min("start_ms") - F.min("seq") * 400).alias("delta_ms"), (F.min("seq") * 400).alias("anchor_ms"), F.min("start_ms").alias("start_ms"), F.max("k").alias("mk"),
    )
    return g.withColumns({"next_anchor_ms": F.lead("anchor_ms").over(by_track()), "lookahead_ms": F.when(F.col("line_idx") % 4 != 2, F.lead("start_ms").over(by_track()))})


@query("E8_confidence_stats", LAST, "SELECT track_id, line_idx, round(md, 6) AS median_conf, mn AS min_conf, round(wk, 6) AS weak_ratio FROM lb")
def e8(spark, d):
    return last_words(spark, d).select(*LINE, F.round("median", 6).alias("median_conf"), F.col("least").alias("min_conf"), F.round("weak", 6).alias("weak_ratio"))


@query("E12_mean_confidence", LAST, "SELECT track_id, line_idx, round(mean, 6) AS mean_conf FROM lb")
def e12(spark, d):
    return last_words(spark, d).select(*LINE, F.round("conf", 6).alias("mean_conf"))


@query("F8_boundary_deltas", LAST, "SELECT track_id, line_idx, delta AS anchor_delta_ms, na - s AS lead_ms, coalesce(ah, na) - e AS context_gap_ms FROM lb")
def f8(spark, d):
    return last_words(spark, d).select(*LINE, F.col("delta_ms").alias("anchor_delta_ms"), (F.col("next_anchor_ms") - F.col("last_start")).alias("lead_ms"), (F.coalesce("lookahead_ms", "next_anchor_ms") - F.col("last_end")).alias("context_gap_ms"))


@query("H11_candidate_score", LAST, """SELECT track_id, line_idx, round(0.5 * mean + 0.18 * c + 0.2 * md + 0.12 * mn - 0.16 * wk - least(0.22, abs(delta) / 1000 * 0.055) - CASE WHEN na - s < -80 THEN 0.28 WHEN na - s < 30 THEN 0.12 ELSE 0 END
  - CASE WHEN coalesce(ah, na) - e <= 0 THEN 0.3 WHEN coalesce(ah, na) - e < 55 THEN 0.1 ELSE 0 END, 6) AS score FROM lb""")
def h11(spark, d):
    x = last_words(spark, d)
    c = F.col
    score = align.candidate_score(c("conf"), c("last"), c("median"), c("least"), c("weak"), c("delta_ms"), c("next_anchor_ms") - c("last_start"), F.coalesce("lookahead_ms", "next_anchor_ms") - c("last_end"))
    return x.select(*LINE, F.round(score, 6).alias("score"))


LWS = """c - CASE WHEN contains(o, 'low_confidence') OR starts_with(o, 'interpolated') THEN 0.12 ELSE 0 END - CASE WHEN s - na >= 80 THEN 0.52 WHEN s - na >= -30 THEN 0.18 ELSE 0 END
  + CASE WHEN ah - s <= 0 THEN -0.65 WHEN ah - s < 55 THEN -0.16 WHEN ah - s >= 100 THEN least(0.06, (ah - s) / 1000 * 0.03) ELSE 0 END - CASE WHEN e > ah + 50 THEN 0.18 ELSE 0 END - CASE WHEN e - s < 25 THEN 0.05 ELSE 0 END"""


@query("H12_last_word_score", LAST, f"SELECT track_id, line_idx, round({LWS}, 6)::DOUBLE AS score FROM lb")
def h12(spark, d):
    c = F.col
    return last_words(spark, d).select(*LINE, F.round(align.last_word_score(c("last"), c("origin"), c("last_start"), c("last_end"), c("next_anchor_ms"), c("lookahead_ms")), 6).alias("score"))


@query("H13_boundary_rescue", LAST, f"SELECT track_id, line_idx, r > p + 0.015 AS rescued FROM (SELECT track_id, line_idx, {LWS} AS p, {LWS.replace('s - na', 's - 300 - na').replace('ah - s', 'ah - s + 300').replace('e > ah', 'e - 300 > ah')} AS r FROM lb)")
def h13(spark, d):
    """A second pass puts each line's last word 300 ms earlier; it is kept where that is clearly better."""
    c = F.col
    old = align.last_word_score(c("last"), c("origin"), c("last_start"), c("last_end"), c("next_anchor_ms"), c("lookahead_ms"))
    new = align.last_word_score(c("last"), c("origin"), c("last_start") - 300, c("last_end") - 300, c("next_anchor_ms"), c("lookahead_ms"))
    return last_words(spark, d).select(*LINE, (new > old + 0.015).alias("rescued"))


SUSP = "CASE WHEN na IS NULL THEN false ELSE c < 0.54 OR s >= na - 300 OR coalesce(ah - s < 65, false) OR anchor + 3000 - e < 55 END"


@query("C9_suspicious", LAST + ", lc AS (SELECT *, s - s + line_idx * 2400 AS anchor FROM lb)", f"SELECT track_id, line_idx, {SUSP} AS suspicious FROM lc")
def c9(spark, d):
    c = F.col
    return last_words(spark, d).select(*LINE, align.suspicious(c("last"), c("last_start"), c("last_end"), c("next_anchor_ms"), c("lookahead_ms"), c("line_idx") * 2400 + 3000, 0.54, 300).alias("suspicious"))


@query("C10_retry", LAST, "SELECT track_id, line_idx, (mean < 0.5 OR abs(delta) > 250) AND mk > 50 AS retry FROM lb")
def c10(spark, d):
    return last_words(spark, d).select(*LINE, align.retry_wanted(F.col("conf"), F.col("delta_ms"), 0.5, 250, F.col("mk"), F.lit(50)).alias("retry"))


WHY = LAST + f""", lc AS (SELECT *, s - s + line_idx * 2400 AS anchor FROM lb),
cw AS (SELECT track_id, line_idx, bool_or(b) AS consecutive, avg((conf < 0.48)::INT) AS share, bool_or(starts_with(origin, 'interpolated')) AS interpolated FROM (SELECT *, conf < 0.48 AND coalesce(lead(conf < 0.48) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx), false) AS b FROM sw) GROUP BY ALL),
wy AS (SELECT lc.track_id, lc.line_idx, list_filter([CASE WHEN mn < 0.32 THEN 'very_low_word_confidence' END, CASE WHEN share >= 0.18 THEN 'low_confidence_phrase' END, CASE WHEN consecutive THEN 'consecutive_weak_words' END,
  CASE WHEN interpolated THEN 'interpolated_word' END, CASE WHEN mk = 99 THEN 'tempo_outlier' END, CASE WHEN {SUSP} THEN 'boundary' END], lambda x: x IS NOT NULL) AS r FROM lc JOIN cw USING (track_id, line_idx))"""


def why(spark, d):
    w = sung_words(spark, d)
    more = w.groupBy(*LINE).agg(F.avg((F.col("conf") < 0.48).cast("int")).alias("share"), F.bool_or(F.col("origin").startswith("interpolated")).alias("interpolated"))
    x = last_words(spark, d).join(more, LINE).join(rescue.consecutive_weak(w, 0.48), LINE)
    c = F.col
    suspicious = align.suspicious(c("last"), c("last_start"), c("last_end"), c("next_anchor_ms"), c("lookahead_ms"), c("line_idx") * 2400 + 3000, 0.54, 300)
    return x.select(*LINE, align.reasons(None, c("least"), c("share"), c("consecutive"), c("interpolated"), c("mk") == 99, suspicious).alias("r"))


@query("C11_reasons", WHY, "SELECT track_id, line_idx, array_to_string(r, ',') AS reasons FROM wy")
def c11(spark, d):
    return why(spark, d).select(*LINE, F.array_join("r", ",").alias("reasons"))


@query("C12_rescue_gate", WHY, "SELECT track_id, line_idx, len(r) > 0 AND NOT (len(r) = 1 AND r[1] = 'boundary') AS any_mode, len(r) > 0 AND NOT (len(r) = 1 AND r[1] = 'boundary') AND list_has_any(r, ['very_low_word_confidence', 'tempo_outlier']) AS balanced FROM wy")
def c12(spark, d):
    severe = F.arrays_overlap("r", F.array(F.lit(REASONS[1]), F.lit(REASONS[5])))
    return why(spark, d).select(*LINE, align.rescue_gate(F.col("r"), severe, False).alias("any_mode"), align.rescue_gate(F.col("r"), severe, True).alias("balanced"))


@query("C13_weak_lines", LAST, "SELECT track_id, count(*) FILTER (mean < 0.5 OR abs(delta) > 400) AS weak, avg((mean < 0.5 OR abs(delta) > 400)::INT) >= 0.22 AS vocal_pass FROM lb GROUP BY track_id")
def c13(spark, d):
    weak = (F.col("conf") < 0.5) | (F.abs("delta_ms") > 400)
    return last_words(spark, d).groupBy("track_id").agg(F.count(F.when(weak, 1)).alias("weak"), (F.avg(weak.cast("int")) >= 0.22).alias("vocal_pass"))


@query("C14_short_circuit", SW, "SELECT track_id, CASE WHEN track_id % 3 = 0 THEN 'imported' ELSE 'align' END AS path, count(*) AS words FROM sw GROUP BY track_id")
def c14(spark, d):
    """Tracks that come with word times skip alignment: the two kinds part and meet again."""
    w = sung_words(spark, d).withColumn("_has", F.col("track_id") % 3 == 0)
    known, rest = w.where("_has").withColumn("path", F.lit("imported")), w.where("not _has").withColumn("path", F.lit("align"))
    return known.unionByName(rest).groupBy("track_id", "path").agg(F.count("*").alias("words"))


UNITS = SW + """,
un AS (SELECT *, greatest(1.0, length(word) * 0.72 + length(regexp_replace(word, '[^aeiouy]', '', 'g')) * 0.28)::DOUBLE AS units, (k < 42 OR starts_with(origin, 'interpolated') OR starts_with(origin, 'tempo_'))::INT AS bad FROM sw),
lt0 AS (SELECT track_id, line_idx, count(*) AS n, avg(conf) AS c, arg_max(end_ms, word_idx) - arg_min(start_ms, word_idx) AS span, sum(units) AS u, avg(bad) <= 0.25 AS steady FROM un GROUP BY track_id, line_idx),
lt1 AS (SELECT track_id, line_idx, round(CASE WHEN n >= 2 AND c >= 0.45 AND span > 80 AND span / 1000 / u BETWEEN 0.018 AND 0.42 THEN span / 1000 / u END, 9) AS tempo, steady FROM lt0),
pr AS (SELECT *, list_filter(list(CASE WHEN steady THEN tempo END) OVER (PARTITION BY track_id ORDER BY line_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW), lambda x: x IS NOT NULL) AS near, median(tempo) OVER (PARTITION BY track_id) AS every FROM lt1),
pq AS (SELECT track_id, line_idx, tempo, round(CASE WHEN len(near) > 0 THEN list_aggregate(near, 'median') ELSE every END, 9) AS prior FROM pr)"""


def with_units(spark, d):
    return sung_words(spark, d).withColumn("units", word_units(F.col("word")))


@query("F10_line_tempo", UNITS, "SELECT track_id, line_idx, tempo, steady FROM lt1")
def f10(spark, d):
    return rescue.line_tempo(with_units(spark, d))


@query("F11_tempo_prior", UNITS, "SELECT track_id, line_idx, round(prior, 6) AS prior FROM pq")
def f11(spark, d):
    return rescue.tempo_prior(rescue.line_tempo(with_units(spark, d))).select(*LINE, F.round("prior", 6).alias("prior"))


def outliers(spark, d):
    w = with_units(spark, d)
    prior = rescue.tempo_prior(rescue.line_tempo(w)).select(*LINE, "prior")
    return rescue.tempo_outliers(w.join(prior, LINE).withColumn("right_ms", F.lit(None).cast("long")))


@query("F12_outliers", UNITS, """SELECT track_id, seq, CASE WHEN prior IS NULL THEN false ELSE k < 45 AND (r < 0.22 OR r > 3.4) OR k < 62 AND (r < 0.12 OR r > 5) END AS outlier FROM
  (SELECT un.*, prior, (coalesce(lead(start_ms) OVER (PARTITION BY un.track_id, un.line_idx ORDER BY word_idx), end_ms) - start_ms) / 1000 / greatest(0.035, units * prior) AS r FROM un JOIN pq USING (track_id, line_idx))""")
def f12(spark, d):
    return outliers(spark, d).select("track_id", "seq", "outlier")


@query("F13_consecutive", SW, "SELECT track_id, line_idx, bool_or(b) AS consecutive FROM (SELECT *, k < 48 AND coalesce(lead(k < 48) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx), false) AS b FROM sw) GROUP BY track_id, line_idx")
def f13(spark, d):
    return rescue.consecutive_weak(sung_words(spark, d), 0.48)


@query("F9_interpolate", SL, """, m AS (SELECT sw.*, sl.start_ms AS ls, sl.end_ms AS le, CASE WHEN k % 3 <> 0 THEN sw.start_ms END AS s, CASE WHEN k % 3 <> 0 THEN sw.end_ms END AS e FROM sw JOIN sl USING (track_id, line_idx)),
b AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ls) AS l, coalesce(first_value(s IGNORE NULLS) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), le) AS r,
  count(s) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS g FROM m),
c AS (SELECT *, count(*) OVER (PARTITION BY track_id, line_idx, g, s IS NULL) AS n, row_number() OVER (PARTITION BY track_id, line_idx, g, s IS NULL ORDER BY word_idx) - 1 AS i FROM b),
f AS (SELECT *, greatest(30 * n, r - l) AS span FROM c)
SELECT track_id, line_idx, word_idx, coalesce(s, l + span * i // n) AS start_ms, coalesce(e, l + span * (i + 1) // n) AS end_ms, CASE WHEN s IS NULL THEN 0.1 ELSE conf END AS conf, CASE WHEN s IS NULL THEN 'interpolated' ELSE origin END AS origin FROM f""")
def f9(spark, d):
    bounds = lines(spark, d).select(*LINE, F.col("start_ms").alias("line_start_ms"), F.col("end_ms").alias("line_end_ms"))
    timed = F.col("k") % 3 != 0
    w = sung_words(spark, d).withColumns({"start_ms": F.when(timed, F.col("start_ms")), "end_ms": F.when(timed, F.col("end_ms"))})
    return rescue.interpolate_missing(w.join(bounds, LINE))


REBUILT = UNITS + """,
ot AS (SELECT un.*, prior, (coalesce(lead(start_ms) OVER (PARTITION BY un.track_id, un.line_idx ORDER BY word_idx), end_ms) - start_ms) / 1000 / greatest(0.035, units * prior) AS r FROM un JOIN pq USING (track_id, line_idx)),
us AS (SELECT *, k < 36 OR CASE WHEN prior IS NULL THEN false ELSE k < 45 AND (r < 0.22 OR r > 3.4) OR k < 62 AND (r < 0.12 OR r > 5) END AS u, min(start_ms) OVER (PARTITION BY track_id, line_idx) AS ls, max(end_ms) OVER (PARTITION BY track_id, line_idx) AS le FROM ot),
bl AS (SELECT *, count(*) FILTER (NOT u) OVER w AS b, coalesce(last_value(CASE WHEN NOT u THEN end_ms END IGNORE NULLS) OVER w, ls) AS l,
  coalesce(first_value(CASE WHEN NOT u THEN start_ms END IGNORE NULLS) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), le) AS rr FROM us WINDOW w AS (PARTITION BY track_id, line_idx ORDER BY word_idx ROWS UNBOUNDED PRECEDING)),
nb AS (SELECT *, count(*) OVER (PARTITION BY track_id, line_idx, b, u) AS n, row_number() OVER v AS i, sum(units) OVER (PARTITION BY track_id, line_idx, b, u) AS al, sum(units) OVER v - units AS dn FROM bl WINDOW v AS (PARTITION BY track_id, line_idx, b, u ORDER BY word_idx ROWS UNBOUNDED PRECEDING)),
wd AS (SELECT *, greatest(rr, l + 40 * n) AS rt FROM nb),
st AS (SELECT *, least(max(greatest(l + 11, l + dn * (rt - l) / al) - 12 * i) OVER (PARTITION BY track_id, line_idx, b, u ORDER BY word_idx ROWS UNBOUNDED PRECEDING) + 12 * i, rt - 12 * (n - i + 1)) AS s FROM wd)"""


@query("F15_reconstruct", REBUILT, """SELECT track_id, line_idx, word_idx, round(CASE WHEN u THEN s ELSE start_ms END, 3)::DOUBLE AS start_ms, round(CASE WHEN u THEN coalesce(lead(s) OVER (PARTITION BY track_id, line_idx, b, u ORDER BY word_idx), rt) ELSE end_ms END, 3)::DOUBLE AS end_ms,
  round(CASE WHEN u THEN least(0.44, greatest(0.24, 0.72 * conf + 0.16)) ELSE conf END, 6)::DOUBLE AS conf, CASE WHEN u THEN 'tempo_energy_rescue' ELSE origin END AS origin FROM st""")
def f15(spark, d):
    """Words out of tempo are set anew in proportion to their units (H16)."""
    bounds = lines(spark, d).select(*LINE, F.col("start_ms").alias("line_start_ms"), F.col("end_ms").alias("line_end_ms"))
    w = outliers(spark, d).withColumn("unstable", F.col("outlier") | (F.col("conf") < 0.36)).join(bounds, LINE)
    return rescue.reconstruct(w).withColumns({"start_ms": F.round("start_ms", 3), "end_ms": F.round("end_ms", 3), "conf": F.round("conf", 6)})


@query("E11_tempo_median", UNITS, "SELECT track_id, round(median(tempo), 6) AS tempo FROM lt1 GROUP BY track_id")
def e11(spark, d):
    return rescue.line_tempo(with_units(spark, d)).groupBy("track_id").agg(F.round(F.median("tempo"), 6).alias("tempo"))


EMB = "fr AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


def frames(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


@query("E14_novelty", EMB, """, en AS (SELECT vec_id, i // 4 AS frame, ln(sqrt(avg(x * x) + 1e-9) + 1e-6) AS l FROM fr GROUP BY vec_id, i // 4),
ri AS (SELECT *, greatest(0, l - coalesce(lag(l) OVER (PARTITION BY vec_id ORDER BY frame), l)) AS r FROM en),
tp AS (SELECT vec_id, max(r) AS strength, median(r) AS m FROM ri GROUP BY vec_id)
SELECT vec_id, frame, round(strength, 6) AS strength FROM (SELECT tp.*, min(frame) AS frame FROM tp JOIN ri ON ri.vec_id = tp.vec_id AND ri.r = tp.strength GROUP BY ALL) WHERE strength >= m + 0.1""")
def e14(spark, d):
    energy = frames(spark, d).groupBy("vec_id", F.expr("i div 4").alias("frame")).agg(F.sqrt(F.avg(F.col("x") * F.col("x")) + 1e-9).alias("energy"))
    return rescue.novelty_peak(energy, ["vec_id"])


@query("E15_peaks", EMB, "SELECT vec_id, i // 8 AS bucket, round(max(abs(x)), 6) AS peak FROM fr GROUP BY vec_id, i // 8")
def e15(spark, d):
    return frames(spark, d).groupBy("vec_id", F.expr("i div 8").alias("bucket")).agg(F.round(F.max(F.abs("x")), 6).alias("peak"))


def emissions(spark, d):
    """Each vector as 16 frames of 4 log-probabilities, and a target of its label."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(x, i * 4 + 1, F.lit(4)))
    norm = F.transform(rows, lambda r: F.transform(r, lambda v: v - F.log(F.aggregate(r, F.lit(0.0), lambda a, b: a + F.exp(b)))))
    target = F.array((F.col("label") % 3 + 1).cast("int"), (F.expr("label div 3") % 3 + 1).cast("int"))
    return e.select("vec_id", "label", norm.alias("emission"), target.alias("target"))


@query("H3_ctc")
def h3(spark, d):
    return align.token_spans(emissions(spark, d), ["vec_id"]).withColumn("confidence", F.round("confidence", 9))


@query("H5_word_spans")
def h5(spark, d):
    """Word spans of one two-letter word a vector, from its token spans; frames as ms of a 16 s window (H4)."""
    e = emissions(spark, d)
    words = e.select("vec_id", F.lit(0).alias("word_idx"), F.lit(0).alias("token_start"), F.lit(2).alias("token_end"))
    out = align.word_spans(align.token_spans(e, ["vec_id"]), words, ["vec_id"])
    at = lambda c: align.frame_time(F.col(c), F.lit(16), F.lit(0), F.lit(16000))
    return out.select("vec_id", at("start_frame").alias("start_ms"), at("end_frame").alias("end_ms"), "confidence", "origin")


@query("H6_backoff", SL, "SELECT track_id, line_idx, max(kk) AS used FROM sl, (VALUES (0), (1), (2), (3)) v(kk) WHERE kk = 0 OR n_words + kk * 2 <= 10 - line_idx % 3 GROUP BY track_id, line_idx")
def h6(spark, d):
    """The most words of lookahead with which a line still fits its frames."""
    each = lines(spark, d).select(*LINE, "n_words").withColumn("used", F.explode(F.array(*map(F.lit, range(4)))))
    return align.longest_feasible(each, LINE, "used", (F.col("used") == 0) | (F.col("n_words") + F.col("used") * 2 <= 10 - F.col("line_idx") % 3)).select(*LINE, "used")


@query("H7_lookahead", SW, "SELECT track_id, line_idx - 1 AS line_idx, arg_min(start_ms, word_idx) AS lookahead_start, arg_min(conf, word_idx) AS lookahead_conf FROM sw WHERE k > 15 AND line_idx > 0 GROUP BY track_id, line_idx")
def h7(spark, d):
    ok = sung_words(spark, d).where("k > 15 and line_idx > 0")
    first = ok.groupBy(*LINE).agg(F.min_by("start_ms", "word_idx").alias("lookahead_start"), F.min_by("conf", "word_idx").alias("lookahead_conf"))
    return first.select("track_id", (F.col("line_idx") - 1).alias("line_idx"), "lookahead_start", "lookahead_conf")


@query("H8_boundary_cap", SW, "SELECT track_id, seq, CASE WHEN end_ms > l THEN greatest(start_ms + 10, l) ELSE end_ms END AS end_ms, CASE WHEN end_ms > l THEN least(conf, 0.35) ELSE conf END AS conf, CASE WHEN end_ms > l THEN 'repaired_boundary_context_cap' ELSE origin END AS origin FROM (SELECT *, (line_idx + 1) * 2400 AS l FROM sw)")
def h8(spark, d):
    limit = (F.col("line_idx") + 1) * 2400
    cap = align.capped(F.col("end_ms"), F.col("start_ms"), limit, F.col("conf"), F.col("origin"))
    return sung_words(spark, d).select("track_id", "seq", *(v.alias(k) for k, v in cap.items()))


@query("H10_even_split", SL, """SELECT track_id, line_idx, i - 1 AS word_idx, anchor_ms + span * (i - 1) // 3 AS start_ms, anchor_ms + span * i // 3 AS end_ms FROM (SELECT *, coalesce(lead(anchor_ms) OVER (PARTITION BY track_id ORDER BY line_idx) - anchor_ms, 1500) AS span FROM sl), range(1, 4) r(i)""")
def h10(spark, d):
    return align.even_split(lines(spark, d), tokens(F.lit("♪ ♪ ♪"))).select(*LINE, F.col("word_idx").cast("long").alias("word_idx"), "start_ms", "end_ms")


@query("D2_greedy_match", None, r"""WITH RECURSIVE t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(coalesce(text, ''), '\S+'), lambda w: regexp_replace(lower(w), '[^\p{L}\p{N}'']', '', 'g')) AS r FROM conversations),
u AS (SELECT conv_id, turn, r, list_filter(r, lambda w, i: i % 7 <> 4) AS c FROM t),
g AS (SELECT conv_id, turn, r, c, 0 AS i, 1 AS cur, 0 AS n FROM u UNION ALL
  SELECT conv_id, turn, r, c, i + 1, CASE WHEN h > 0 THEN cur + h ELSE cur END, CASE WHEN h > 0 THEN n + 1 ELSE n END FROM (SELECT *, CASE WHEN r[i + 1] = '' THEN 0 ELSE coalesce(list_position(c[cur:cur + 4], r[i + 1]), 0) END AS h FROM g WHERE i < len(r)))
SELECT conv_id, turn, n::INT AS matched FROM g WHERE i = len(r)""")
def d2(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet").withColumn("r", F.transform(tokens(F.col("text")), lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}']", "")))
    both = t.withColumn("c", F.filter("r", lambda w, i: (i + 1) % 7 != 4))
    return both.select("conv_id", "turn", F.size(compare.greedy_match(both, "r", "c")).alias("matched"))


def heard(spark, d):
    """Lines of sung words with what follows them, and their frames."""
    texts = sung_texts(spark, d)
    known = steps.with_next(texts, F.col("duration_ms"))
    return known, steps.Sound(sung_frames(spark, d), 40, 10)


def told(lines: DataFrame) -> DataFrame:
    """Aligned lines flat enough to print and compare."""
    words = F.array_join(F.transform("words", lambda w: F.format_string("%s:%d-%d:%s", w["word"], w["start_ms"], w["end_ms"], w["origin"])), " ")
    return lines.select(*LINE, "variant", "start_ms", "end_ms", F.round("conf", 4).alias("conf"), "lookahead_ms", "used", F.round("score", 6).alias("score"), words.alias("aligned"))


SCORED = SW + """,
cs AS (SELECT track_id, line_idx, word_idx, CASE WHEN k % 17 = 5 THEN word || 'x' ELSE word END AS word, start_ms + (k * 17) % 300 - 150 AS start_ms, end_ms + (k * 17) % 300 - 150 AS end_ms FROM sw WHERE seq % 7 <> 3 AND line_idx % 11 <> 10),
rl AS (SELECT track_id, line_idx, min(start_ms) AS s, list({'t': word, 's': start_ms, 'e': end_ms} ORDER BY word_idx) AS w FROM sw GROUP BY ALL),
cl AS (SELECT track_id, line_idx, min(start_ms) AS s, list({'t': word, 's': start_ms, 'e': end_ms} ORDER BY word_idx) AS w FROM cs GROUP BY ALL),
bl AS (SELECT track_id, line_idx, rl.s AS rs, cl.s AS c_s, rl.w AS rw, cl.w AS cw FROM rl FULL JOIN cl USING (track_id, line_idx)),
gm AS (SELECT track_id, line_idx, rw, cw, 0 AS i, 1::BIGINT AS cur, []::STRUCT(i BIGINT, j BIGINT)[] AS m FROM bl WHERE rw IS NOT NULL AND cw IS NOT NULL UNION ALL
  SELECT track_id, line_idx, rw, cw, i + 1, CASE WHEN h > 0 THEN cur + h ELSE cur END, CASE WHEN h > 0 THEN list_append(m, {'i': (i + 1)::BIGINT, 'j': (cur + h - 1)::BIGINT}) ELSE m END
  FROM (SELECT *, coalesce(list_position(list_transform(cw[cur:cur + 4], lambda x: x.t), rw[i + 1].t), 0) AS h FROM gm WHERE i < len(rw))),
pm AS (SELECT track_id, rw, cw, unnest(m) AS m FROM gm WHERE i = len(rw)),
em AS (SELECT track_id, abs(cw[m.j].s - rw[m.i].s)::DOUBLE AS s, abs(cw[m.j].e - rw[m.i].e)::DOUBLE AS e FROM pm),
ea AS (SELECT track_id, count(*) AS n, avg(s) AS mae, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.95) AS p95, avg(e) AS emae, quantile_cont(e, 0.95) AS ep95, avg((s <= 50)::INT) AS w50, avg((s <= 100)::INT) AS w100, avg((s <= 200)::INT) AS w200 FROM em GROUP BY track_id),
la AS (SELECT track_id, count(rs) AS rl, count(c_s) AS cl, count(*) FILTER (rs IS NULL OR c_s IS NULL OR list_transform(rw, lambda x: x.t) <> list_transform(cw, lambda x: x.t)) AS other, coalesce(sum(len(rw)), 0)::BIGINT AS words, avg(abs(c_s - rs)) AS mae FROM bl GROUP BY track_id)"""


@query("E3_score_lines", SCORED, """SELECT track_id, rl AS reference_lines, cl AS candidate_lines, other AS line_text_mismatches, words AS reference_words, coalesce(n, 0) AS matched_words, round(la.mae, 2) AS line_onset_mae_ms,
  round(ea.mae, 2) AS word_onset_mae_ms, round(p50, 2) AS word_onset_median_ms, round(p95, 2) AS word_onset_p95_ms, round(emae, 2) AS word_end_mae_ms, round(ep95, 2) AS word_end_p95_ms,
  round(coalesce(w50, 0), 4) AS within_50_ms, round(coalesce(w100, 0), 4) AS within_100_ms, round(coalesce(w200, 0), 4) AS within_200_ms, round(coalesce(n / words, 0), 4) AS word_coverage FROM la LEFT JOIN ea USING (track_id)""")
def e3_lines(spark, d):
    """Sung lines against a candidate that lacks words and lines, spells some otherwise and is up to 150 ms off."""
    w = sung_words(spark, d)
    off = (F.col("k") * 17) % 300 - 150
    other = F.when(F.col("k") % 17 == 5, F.concat("word", F.lit("x"))).otherwise(F.col("word"))
    late = w.where("seq % 7 <> 3 and line_idx % 11 <> 10").withColumns({"word": other, "start_ms": F.col("start_ms") + off, "end_ms": F.col("end_ms") + off})

    def gathered(words):
        g = words.groupBy(*LINE).agg(F.min("start_ms").alias("start_ms"), F.sort_array(F.collect_list(F.struct("word_idx", "word", "start_ms", "end_ms"))).alias("words"))
        return g.withColumn("text", F.array_join(F.transform("words", lambda x: x["word"]), " "))

    return compare.score_lines(gathered(w), gathered(late), ["track_id"])


ANEW = UNITS + """,
ot AS (SELECT un.*, prior, (coalesce(lead(start_ms) OVER (PARTITION BY un.track_id, un.line_idx ORDER BY word_idx), end_ms) - start_ms) / 1000 / greatest(0.035, units * prior) AS r FROM un JOIN pq USING (track_id, line_idx)),
us AS (SELECT *, prior IS NOT NULL AND (k < 36 OR k < 45 AND (r < 0.22 OR r > 3.4) OR k < 62 AND (r < 0.12 OR r > 5)) AS u, min(start_ms) OVER (PARTITION BY track_id, line_idx) AS ls, max(end_ms) OVER (PARTITION BY track_id, line_idx) AS le FROM ot),
bl AS (SELECT *, count(*) FILTER (NOT u) OVER w AS b, last_value(CASE WHEN NOT u THEN end_ms END IGNORE NULLS) OVER w AS lw,
  first_value(CASE WHEN NOT u THEN start_ms END IGNORE NULLS) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rw FROM us WINDOW w AS (PARTITION BY track_id, line_idx ORDER BY word_idx ROWS UNBOUNDED PRECEDING)),
nb AS (SELECT *, count(*) OVER (PARTITION BY track_id, line_idx, b, u) AS n, row_number() OVER v - 1 AS i, sum(units) OVER (PARTITION BY track_id, line_idx, b, u) AS al, sum(units) OVER v - units AS dn, coalesce(lw, ls)::DOUBLE AS l, coalesce(rw, le)::DOUBLE AS rt, 1000 * prior AS tempo
  FROM bl WINDOW v AS (PARTITION BY track_id, line_idx, b, u ORDER BY word_idx ROWS UNBOUNDED PRECEDING)),
sc AS (SELECT *, l + dn * CASE WHEN lw IS NOT NULL AND rw IS NOT NULL OR greatest(20 * n, rt - l) < greatest(40 * n, al * tempo) THEN greatest(20 * n, rt - l) / al ELSE tempo END AS pred FROM nb),
wn AS (SELECT *, CASE WHEN i = 0 THEN greatest(l + 11, least(pred, rt - 12 * (n - i))) ELSE least(pred, rt - 12 * (n - i)) END AS want FROM sc),
st AS (SELECT *, CASE WHEN u THEN round(max(want - 12 * i) OVER (PARTITION BY track_id, line_idx, b, u ORDER BY word_idx ROWS UNBOUNDED PRECEDING) + 12 * i)::BIGINT ELSE start_ms END AS s FROM wn)"""


def unstable_words(spark, d):
    bounds = lines(spark, d).select(*LINE, F.col("start_ms").alias("line_start_ms"), F.col("end_ms").alias("right_ms"))
    w = outliers(spark, d).drop("right_ms").withColumn("unstable", F.col("prior").isNotNull() & (F.col("outlier") | (F.col("conf") < 0.36)))
    return w.join(bounds, LINE)


@query("H16_reconstruct", ANEW, """SELECT track_id, line_idx, word_idx, s AS start_ms, CASE WHEN u THEN greatest(s + 10, coalesce(lead(s) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx), round(rt)::BIGINT)) ELSE end_ms END AS end_ms,
  CASE WHEN u THEN round(least(0.44, greatest(0.24, 0.72 * conf + 0.16)), 4) ELSE conf END::DOUBLE AS conf, CASE WHEN u THEN 'tempo_energy_rescue' ELSE origin END AS origin, CASE WHEN u THEN start_ms END AS rescue_previous_start_ms FROM st""")
def h16(spark, d):
    """Words out of tempo set anew between their neighbours, or by tempo at a free end."""
    return onset.rebuild(unstable_words(spark, d))


@query("H16_energy_snap")
def h16_snap(spark, d):
    """The same, moved to where the sound rises."""
    return onset.rebuild(unstable_words(spark, d), onset.Audio(sung_samples(spark, d), 1000, 400))


def first_pass(spark, d, name="balanced"):
    """Lines with their profile, their sound, and what the first pass gave."""
    known, sound = heard(spark, d)
    known, p = steps.settled(steps.profiled(known, profile(name))), steps.of_profile
    now = steps.align_lines(steps.request(known, "first", p("pre"), p("post"), p("last_window"), p("lookahead")), sound, True)
    return known, sound, steps.settled(now)


@query("H6_lookahead_used")
def h6_used(spark, d):
    """How many words of the next line each line was heard with, and why it has its times."""
    _, _, now = first_pass(spark, d)
    return now.select(*LINE, "used", "method", "lookahead_ms", F.round("lookahead_conf", 4).alias("lookahead_conf"))


@query("H13_boundary_pass")
def h13_pass(spark, d):
    """Last words before and after they were aligned again in a short window."""
    known, sound, now = first_pass(spark, d)
    after = steps.boundary_rescued(known, now, sound)
    last = lambda name: F.element_at("words", -1)["start_ms"].alias(name)
    return now.select(*LINE, last("before_ms")).join(after.select(*LINE, last("after_ms"), F.col("variant").endswith("+boundary").alias("rescued")), LINE)


@query("C11_rescue_reasons")
def c11_reasons(spark, d):
    """Why lines of the first pass should be looked at again, and whether they are (C12)."""
    _, _, now = first_pass(spark, d)
    tempos = rescue.tempo_prior(rescue.line_tempo(steps.word_rows(now, []))).select(*LINE, "prior")
    why = steps.reasons(now, tempos)
    severe = F.arrays_overlap("reasons", F.array(*map(F.lit, steps.SEVERE)))
    return why.select(*LINE, F.array_join("reasons", ",").alias("reasons"), align.rescue_gate(F.col("reasons"), severe, True).alias("rescued"))


@query("C13_weak_pass")
def c13_pass(spark, d):
    """Lines of the first pass that another source may mend, and lines the other source mends (D4, G7)."""
    known, sound, now = first_pass(spark, d)
    weak = steps.settled(steps.weak_lines(now))
    p = steps.of_profile
    asked = steps.request(known.join(weak.where("weak").select(*LINE), LINE, "left_semi"), "first", p("pre"), p("post"), p("last_window"), p("lookahead"))
    again = steps.align_lines(asked, steps.Sound(sung_frames(spark, d, 0.25), 40, 10))
    return weak.join(steps.hybrid(now, again).select(*LINE, F.col("replaced").alias("mended")), LINE)


@query("D6_matrix_run")
def d6_run(spark, d):
    """Every track under two configurations of a manifest of its own, scored against the lines as they were sung."""
    texts = sung_texts(spark, d).withColumn("case", F.col("track_id").cast("string"))
    each = F.array(F.struct(F.col("case").alias("name"), F.lit("").alias("audio"), F.lit("").alias("lyrics"), F.lit("").alias("reference"), F.lit("eng").alias("language")))
    one = texts.select("case").distinct().select(each.alias("cases"))
    own = F.array(*(F.struct(F.lit(a).alias("name"), F.lit(b).alias("use_demucs"), F.lit(c).alias("quality_mode")) for a, b, c in (("own-fast", "off", "fast"), ("own-vocals", "on", "fast"))))
    cases = manifest_cases(one.withColumn("matrix", own))
    w = sung_words(spark, d).withColumn("case", F.col("track_id").cast("string")).withColumn("word", F.substring("word", 1, 4))
    reference = w.groupBy("case", "line_idx").agg(F.min("start_ms").alias("start_ms"), F.sort_array(F.collect_list(F.struct("word_idx", "word", "start_ms", "end_ms"))).alias("words"))
    reference = reference.withColumn("text", F.array_join(F.transform("words", lambda x: x["word"]), " "))
    named = lambda lift: steps.Sound(sung_frames(spark, d, lift).withColumn("track_id", F.col("track_id").cast("string")), 40, 10)
    out = steps.run_matrix(cases, profiles(spark), texts.drop("track_id"), reference, named(0.0), named(0.25))
    return compare.matrix_report(out)


@query("H9_line_alignment")
def h9(spark, d):
    """One pass over all lines in the windows of the balanced profile."""
    known, sound = heard(spark, d)
    p = profile("balanced")
    return told(steps.align_lines(steps.request(steps.settled(known), "first", p["pre"], p["post"], p["last_window"], p["lookahead"]), sound, True))


@query("H14_rescue_variants")
def h14(spark, d):
    """Every line in the three other windows of the best profile."""
    known, sound = heard(spark, d)
    known = steps.settled(known)
    now = known.select(*LINE, F.col("anchor_ms").alias("start_ms"))
    return told(steps.align_lines(steps.variants(steps.profiled(known, profile("max")), now), sound, True))


@query("H18_pass_driver")
def h18(spark, d):
    known, sound = heard(spark, d)
    out = steps.align_tracks(known, sound, profile("max"))
    return told(out).join(out.select(*LINE, F.array_join("reasons", ",").alias("reasons")), LINE)


@query("H19_sources")
def h19(spark, d):
    """The mix, and a second source with clearer frames for what came out weak."""
    known, sound = heard(spark, d)
    out = steps.best_of_sources(known, sound, steps.Sound(sung_frames(spark, d, 0.25), 40, 10), profile("balanced"))
    return told(out).join(out.select(*LINE, "candidate", "display_ms"), LINE)


@query("I1_union", SW, "SELECT track_id, source, count(*) AS n FROM (SELECT track_id, 'a' AS source FROM sw WHERE k < 50 UNION ALL SELECT track_id, 'b' FROM sw WHERE k >= 30) GROUP BY ALL")
def i1(spark, d):
    w = sung_words(spark, d)
    a, b = w.where("k < 50").select("track_id", "conf", F.lit("a").alias("source")), w.where("k >= 30").select("track_id", F.lit("b").alias("source"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("track_id", "source").agg(F.count("*").alias("n"))


@query("I2_index_union", SW, "SELECT track_id, line_idx, array_to_string(list_sort(list_distinct(list_concat(coalesce(list(word_idx) FILTER (k < 30), []), coalesce(list(word_idx) FILTER (k % 7 = 1), [])))), ',') AS unstable FROM sw GROUP BY track_id, line_idx")
def i2(spark, d):
    some = lambda c: F.collect_list(F.when(c, F.col("word_idx")))
    g = sung_words(spark, d).groupBy(*LINE).agg(some(F.col("k") < 30).alias("a"), some(F.col("k") % 7 == 1).alias("b"))
    return g.select(*LINE, F.array_join(F.sort_array(F.array_union("a", "b")).cast("array<string>"), ",").alias("unstable"))


@query("I3_case_dedup", None, r"""SELECT conv_id, count(*) AS variants FROM (SELECT DISTINCT conv_id, lower(w) FROM (SELECT conv_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS w FROM conversations)) GROUP BY conv_id""")
def i3(spark, d):
    """The first of the spellings that differ in case only."""
    w = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))).alias("i", "w"))
    first = w.groupBy("conv_id", F.lower("w").alias("_l")).agg(F.min_by("w", F.struct("turn", "i")).alias("w"))
    return first.groupBy("conv_id").agg(F.count("w").alias("variants"))
