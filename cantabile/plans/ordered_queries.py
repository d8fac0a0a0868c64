"""Queries on breaks, bounds, clamps, islands, medians, lookups and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantabile.operators import compare, gaps, ordered, quality, repair
from cantabile.operators.ordered import by_track
from cantabile.plans.sql import SL, SW, TW, with_
from cantabile.schema import profiles
from cantabile.sources.views import sung_lines, sung_words, timed_words

FOUR_HOURS = 14_400_000_000
PROFILE_ROWS = "(VALUES ('fast', 650, 450, 9000), ('balanced', 950, 850, 11000), ('max', 1250, 1200, 13000)) p(name, pre, post, last)"

QUERIES, ORACLES = {}, {}


def query(name: str, views: str | None = None, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_(views, sql)
        return f

    return keep


def lines(spark: SparkSession, d: str) -> DataFrame:
    return sung_lines(sung_words(spark, d))


def rounded(spark: SparkSession, d: str) -> DataFrame:
    """The candidate timeline: starts off by -100 to 100 ms, every seventh word missing."""
    w = sung_words(spark, d).where("seq % 7 <> 3")
    return w.withColumn("start_ms", F.col("start_ms") + (F.col("seq") % 11 - 5) * 20)


CAND = SW + ", cd AS (SELECT * REPLACE (start_ms + (seq % 11 - 5) * 20 AS start_ms) FROM sw WHERE seq % 7 <> 3)"


@query("F7_breaks", TW, f"""SELECT track_id, line_idx, line_end AS break_start, nxt AS break_end FROM (SELECT *, lead(line_start) OVER (PARTITION BY track_id ORDER BY line_idx) AS nxt
  FROM (SELECT track_id, line_idx, min(start_us) AS line_start, max(end_us) AS line_end FROM tw GROUP BY ALL)) WHERE nxt - line_end >= {FOUR_HOURS}""")
def f7(spark, d):
    return gaps.breaks(gaps.line_bounds(timed_words(spark, d), "start_us", "end_us"), F.lit(FOUR_HOURS).cast("bigint"))


@query("E13_line_bounds", TW, "SELECT track_id, line_idx, min(start_us) AS line_start, max(end_us) AS line_end, count(*) AS n_words FROM tw GROUP BY track_id, line_idx")
def e13(spark, d):
    return gaps.line_bounds(timed_words(spark, d), "start_us", "end_us")


@query("D7_adjacent", SL, """SELECT track_id, line_idx, nxt AS next_line, s - end_ms AS gap_ms FROM (SELECT *, lead(line_idx) OVER w AS nxt, lead(start_ms) OVER w AS s FROM sl WINDOW w AS (PARTITION BY track_id ORDER BY line_idx)) WHERE nxt IS NOT NULL""")
def d7(spark, d):
    pairs = lines(spark, d).withColumns({"next_line": F.lead("line_idx").over(by_track()), "gap_ms": F.lead("start_ms").over(by_track()) - F.col("end_ms")})
    return pairs.where("next_line is not null").select("track_id", "line_idx", "next_line", "gap_ms")


@query("F3_line_end", SL, """SELECT track_id, line_idx, start_ms, CASE WHEN nxt IS NULL THEN greatest(start_ms + 1, coalesce(e, start_ms + 4000)) ELSE least(greatest(start_ms + 1, coalesce(e, nxt)), greatest(start_ms + 1, nxt)) END AS end_ms
  FROM (SELECT *, CASE WHEN line_idx % 3 <> 0 THEN end_ms END AS e, lead(start_ms) OVER (PARTITION BY track_id ORDER BY line_idx) AS nxt FROM sl)""")
def f3(spark, d):
    some = lines(spark, d).withColumn("end_ms", F.when(F.col("line_idx") % 3 != 0, F.col("end_ms")))
    return repair.line_ends(some).select("track_id", "line_idx", "start_ms", "end_ms")


@query("F18_last_word", SW, """SELECT track_id, line_idx, arg_min(word, word_idx) FILTER (k > 20) AS first_word, arg_max(word, word_idx) FILTER (k > 20) AS last_word FROM sw GROUP BY track_id, line_idx""")
def f18(spark, d):
    timed = sung_words(spark, d).withColumn("_i", F.when(F.col("k") > 20, F.col("word_idx")))
    return timed.groupBy("track_id", "line_idx").agg(F.min_by("word", "_i").alias("first_word"), F.max_by("word", "_i").alias("last_word"))


STATS = SW + """,
fl AS (SELECT *, (start_ms < coalesce(max(start_ms) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(start_ms) OVER (PARTITION BY track_id, line_idx)))::INT AS back,
  starts_with(origin, 'interpolated') AS i, starts_with(origin, 'tempo_') AS t, starts_with(origin, 'repaired') AS r FROM sw),
st AS (SELECT track_id, line_idx, count(*) AS words, round(avg(conf), 4) AS mean_conf, min(conf) AS min_conf, arg_max(conf, word_idx) AS last_conf, sum(conf) AS sum_conf, sum(back) AS non_monotonic,
  sum((end_ms <= start_ms)::INT) AS invalid, sum((NOT (i OR t OR r))::INT) AS aligned, sum(i::INT) AS interpolated, sum((t OR r)::INT) AS repaired, sum(t::INT) AS tempo_rescued,
  min(start_ms) AS "start", max(end_ms) AS "end", min(seq) * 400 AS anchor, arg_max(start_ms, word_idx) AS last_start, arg_max(end_ms, word_idx) AS last_end FROM fl GROUP BY track_id, line_idx),
bd AS (SELECT *, nxt - last_start AS lead_ms, nxt - last_end AS context_gap_ms, coalesce(nxt - last_start < 25 OR nxt - last_end < 45, false) AS boundary_warning
  FROM (SELECT *, lead(anchor) OVER (PARTITION BY track_id ORDER BY line_idx) AS nxt FROM st))"""

LINE_COLUMNS = ["track_id", "line_idx", "words", "mean_conf", "min_conf", "last_conf", "non_monotonic", "invalid", "aligned", "interpolated", "repaired", "tempo_rescued", "lead_ms", "context_gap_ms", "boundary_warning"]


@query("E2_line_diag", STATS, f"SELECT {', '.join(LINE_COLUMNS)} FROM bd")
def e2(spark, d):
    return quality.track_lines(sung_words(spark, d)).select(*LINE_COLUMNS)


@query("E2_line_report", STATS, """SELECT track_id, line_idx, line_idx + 1 AS line, text, round(c, 4) AS confidence, n AS words, coalesce(al, 0) AS aligned_words, coalesce(ip, 0) AS interpolated_words,
    coalesce(m, 0) AS mean_conf, coalesce(l, 0) AS last_conf, CASE WHEN tempo_rescued > 0 THEN 'tempo' ELSE 'unknown' END AS method, ("start" - anchor)::DOUBLE AS anchor_delta_ms, lead_ms::DOUBLE AS lead_ms,
    context_gap_ms::DOUBLE AS context_gap_ms, boundary_warning AS boundary_rescue, repaired > 0 AS adaptive_rescue, list_filter([CASE WHEN repaired > 0 THEN 'repaired' END, CASE WHEN invalid > 0 THEN 'invalid' END], lambda x: x IS NOT NULL) AS reasons,
    tempo_rescued::BIGINT AS tempo_words, CASE WHEN lead_ms > 0 THEN words ELSE 0 END AS lookahead_used, coalesce(CASE WHEN line_idx % 3 > 0 THEN anchor END, "start") AS display_ms, 0.0::DOUBLE AS shift_ms, NULL::DOUBLE AS disagreement_ms, boundary_warning
  FROM (SELECT bd.*, t.text, b.c, coalesce(w.n, 0) AS n, w.al, w.ip, w.m, w.l FROM bd JOIN (SELECT track_id, line_idx, string_agg(word, ' ' ORDER BY word_idx) AS text FROM sw GROUP BY ALL) t USING (track_id, line_idx)
    JOIN (SELECT track_id, line_idx, CASE WHEN line_idx % 4 = 1 THEN 0 ELSE min_conf END AS c FROM st) b USING (track_id, line_idx)
    LEFT JOIN (SELECT track_id, line_idx, count(*) AS n, sum((NOT (i OR t OR r))::INT) AS al, sum(i::INT) AS ip, round(avg(conf), 4) AS m, round(arg_max(conf, word_idx), 4) AS l FROM fl WHERE line_idx % 5 <> 2 GROUP BY ALL) w USING (track_id, line_idx))""")
def e2_report(spark, d):
    """All fields of a line; every fifth line has lost its words, every fourth says nothing of its confidence."""
    words = sung_words(spark, d)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ")
    told = quality.track_lines(words).join(words.groupBy("track_id", "line_idx").agg(text.alias("text")), ["track_id", "line_idx"]).select(
        "track_id", "line_idx", "text", F.when(F.col("line_idx") % 4 != 1, F.col("min_conf")).alias("conf"), F.when(F.col("tempo_rescued") > 0, "tempo").alias("method"), "anchor_delta_ms", "lead_ms", "context_gap_ms",
        F.col("boundary_warning").alias("boundary_rescue"), (F.col("repaired") > 0).alias("adaptive_rescue"),
        F.filter(F.array(F.when(F.col("repaired") > 0, "repaired"), F.when(F.col("invalid") > 0, "invalid")), lambda x: x.isNotNull()).alias("reasons"),
        F.col("tempo_rescued").alias("tempo_words"), F.when(F.col("lead_ms") > 0, F.col("words")).alias("lookahead_used"), F.col("start").alias("start_ms"), F.when(F.col("line_idx") % 3 > 0, F.col("anchor")).alias("display_ms"),
    )
    return quality.diagnostics(told, words.where("line_idx % 5 <> 2"))


REPORT = STATS + """,
lt AS (SELECT *, ("start" < coalesce(max("start") OVER (PARTITION BY track_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))::INT AS late FROM bd),
tt AS (SELECT track_id, count(*) AS lines, sum(words) AS words, sum(late) + sum(non_monotonic) AS non_monotonic, sum(invalid) AS invalid, sum(aligned) AS aligned, sum(interpolated) AS interpolated,
  sum(repaired) AS repaired, sum(tempo_rescued) AS tempo_rescued, sum(boundary_warning::INT) AS boundary_warnings, sum(sum_conf) / sum(words) AS w, avg(sum_conf / words) FILTER (sum_conf > 0) AS l,
  avg(last_conf) AS z, avg(abs("start" - anchor)) / 1000 AS a FROM lt GROUP BY track_id),
sc AS (SELECT *, least(greatest(0.34 * aligned / words + 0.24 * w + 0.16 * coalesce(l, 0) + 0.12 * z + 0.14 * coalesce(exp(-a / 2), 0.75) - least(0.35, 0.035 * non_monotonic + 0.02 * invalid)
  - least(0.38, 0.55 * interpolated / words + 0.18 * repaired / words + 0.28 * tempo_rescued / words) - least(0.18, 0.24 * boundary_warnings / greatest(1, lines)), 0), 1) AS s FROM tt),
gr AS (SELECT *, CASE WHEN s >= 0.9 AND interpolated / words <= 0.08 THEN 'excellent' WHEN s >= 0.8 AND interpolated / words <= 0.18 THEN 'good' WHEN s >= 0.68 THEN 'usable' ELSE 'reject' END AS grade FROM sc)"""


@query("E1_quality", REPORT, """SELECT track_id, lines, words, non_monotonic, invalid, aligned, interpolated, repaired, tempo_rescued, boundary_warnings, round(w, 6) AS mean_word_conf, round(s, 6) AS score, grade,
  grade IN ('excellent', 'good') AND non_monotonic = 0 AND invalid = 0 AS publishable FROM gr""")
def e1(spark, d):
    return quality.report(quality.track_lines(sung_words(spark, d)))


@query("E7_counts", SW, "SELECT track_id, count(DISTINCT line_idx) AS line_count, count(*) AS word_count FROM sw GROUP BY track_id")
def e7(spark, d):
    return lines(spark, d).groupBy("track_id").agg(F.count("*").alias("line_count"), F.sum("n_words").alias("word_count"))


@query("C6_all_anchored", SL, "SELECT track_id, bool_and(line_idx % 40 <> 17) AS all_anchored FROM sl GROUP BY track_id")
def c6(spark, d):
    some = lines(spark, d).withColumn("anchor_ms", F.when(F.col("line_idx") % 40 != 17, F.col("anchor_ms")))
    return some.groupBy("track_id").agg(F.coalesce(F.bool_and(F.col("anchor_ms").isNotNull()), F.lit(False)).alias("all_anchored"))


@query("C7_missing_anchors", SL, """SELECT track_id, count(*) AS missing, array_to_string(list(line_idx + 1 ORDER BY line_idx)[1:8], ',') AS first_missing FROM sl WHERE line_idx % 5 = 2 GROUP BY track_id""")
def c7(spark, d):
    some = lines(spark, d).withColumn("anchor_ms", F.when(F.col("line_idx") % 5 != 2, F.col("anchor_ms"))).where("anchor_ms is null")
    first = F.array_join(F.slice(F.sort_array(F.collect_list(F.col("line_idx") + 1)), 1, 8).cast("array<string>"), ",")
    return some.groupBy("track_id").agg(F.count("*").alias("missing"), first.alias("first_missing"))


@query("C8_anchor_coalesce", SL, "SELECT track_id, line_idx, CASE WHEN line_idx % 5 = 2 THEN start_ms ELSE anchor_ms END AS anchor_ms FROM sl")
def c8(spark, d):
    return lines(spark, d).select("track_id", "line_idx", F.coalesce(F.when(F.col("line_idx") % 5 != 2, F.col("anchor_ms")), F.col("start_ms")).alias("anchor_ms"))


@query("D1_positional_outer", SL, """SELECT track_id, line_idx, a.start_ms AS ref_ms, b.start_ms AS cand_ms, CASE WHEN b.line_idx IS NULL THEN 'reference' WHEN a.line_idx IS NULL THEN 'candidate' ELSE 'both' END AS side
  FROM (SELECT * FROM sl WHERE line_idx % 9 <> 4) a FULL JOIN (SELECT track_id, line_idx, start_ms + 30 AS start_ms FROM sl WHERE line_idx % 7 <> 2) b USING (track_id, line_idx)""")
def d1(spark, d):
    base = lines(spark, d)
    ref = base.where("line_idx % 9 <> 4").select("track_id", "line_idx", F.col("start_ms").alias("ref_ms"))
    cand = base.where("line_idx % 7 <> 2").select("track_id", "line_idx", (F.col("start_ms") + 30).alias("cand_ms"))
    return compare.positional(ref, cand, ["track_id", "line_idx"])


@query("E3_error_metrics", CAND, """SELECT track_id, count(x) AS matched, round(avg(x), 6) AS mae, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95,
  round(coalesce(avg((x <= 50)::INT), 0), 6) AS within_50, round(coalesce(avg((x <= 100)::INT), 0), 6) AS within_100, round(coalesce(avg((x <= 200)::INT), 0), 6) AS within_200
  FROM (SELECT a.track_id, abs(b.start_ms - a.start_ms)::DOUBLE AS x FROM sw a JOIN cd b USING (track_id, seq)) GROUP BY track_id""")
def e3(spark, d):
    w, c = sung_words(spark, d), rounded(spark, d)
    both = w.select("track_id", "seq", F.col("start_ms").alias("_a")).join(c.select("track_id", "seq", F.col("start_ms").alias("_b")), ["track_id", "seq"])
    return compare.error_metrics(both.withColumn("error", (F.col("_b") - F.col("_a")).cast("double")), ["track_id"], "error")


@query("E4_percentiles", SW, "SELECT track_id, round(quantile_cont((end_ms - start_ms)::DOUBLE, 0.5), 6) AS p50, round(quantile_cont((end_ms - start_ms)::DOUBLE, 0.9), 6) AS p90 FROM sw GROUP BY track_id")
def e4(spark, d):
    length = (F.col("end_ms") - F.col("start_ms")).cast("double")
    return sung_words(spark, d).groupBy("track_id").agg(F.round(F.percentile(length, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(length, F.lit(0.9)), 6).alias("p90"))


@query("E5_rate_under", CAND, "SELECT line_idx % 10 AS bucket, round(avg((abs(b.start_ms - a.start_ms) <= 60)::INT), 6) AS rate FROM sw a JOIN (SELECT track_id, seq, start_ms FROM cd) b USING (track_id, seq) GROUP BY bucket")
def e5(spark, d):
    w, c = sung_words(spark, d), rounded(spark, d)
    both = w.join(c.select("track_id", "seq", F.col("start_ms").alias("_b")), ["track_id", "seq"])
    return both.groupBy((F.col("line_idx") % 10).alias("bucket")).agg(F.round(compare.rate_under(F.abs(F.col("_b") - F.col("start_ms")), 60), 6).alias("rate"))


@query("D3_next_timed", SL, """SELECT track_id, line_idx, nxt AS next_line, na AS next_anchor_ms FROM (SELECT *, first_value(t IGNORE NULLS) OVER w AS nxt, first_value(CASE WHEN t IS NOT NULL THEN anchor_ms END IGNORE NULLS) OVER w AS na
  FROM (SELECT *, CASE WHEN line_idx % 4 <> 1 THEN line_idx END AS t FROM sl) WINDOW w AS (PARTITION BY track_id ORDER BY line_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""")
def d3(spark, d):
    timed = F.col("line_idx") % 4 != 1
    nxt = lambda c: ordered.next_with(F.col(c), timed, ["track_id"], "line_idx")
    return lines(spark, d).select("track_id", "line_idx", nxt("line_idx").alias("next_line"), nxt("anchor_ms").alias("next_anchor_ms"))


@query("H1_windows", SL, f"""SELECT track_id, line_idx, name, ws AS window_start_ms, greatest(ws + 200, CASE WHEN nxt > anchor_ms + 50 THEN least(1500000, nxt + post) ELSE least(1500000, anchor_ms + last) END) AS window_end_ms
  FROM (SELECT *, greatest(0, anchor_ms - pre) AS ws FROM (SELECT *, lead(anchor_ms) OVER (PARTITION BY track_id ORDER BY line_idx) AS nxt FROM sl), {PROFILE_ROWS})""")
def h1(spark, d):
    from cantabile.operators.align import windows

    return windows(lines(spark, d), profiles(spark), F.lit(1_500_000)).select("track_id", "line_idx", "name", "window_start_ms", "window_end_ms")


@query("D8_profile_lookup", SW, """SELECT track_id, coalesce(p.name, 'max') AS profile, coalesce(p.pre, 1250) AS pre_ms FROM (SELECT DISTINCT track_id, CASE track_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' WHEN 2 THEN 'max' ELSE 'unknown' END AS asked FROM sw) t
  LEFT JOIN (VALUES ('fast', 650), ('balanced', 950), ('max', 1250)) p(name, pre) ON p.name = asked""")
def d8(spark, d):
    asked = F.when(F.col("track_id") % 4 == 0, "fast").when(F.col("track_id") % 4 == 1, "balanced").when(F.col("track_id") % 4 == 2, "max").otherwise("unknown")
    known = profiles(spark).select("name", F.round(F.col("pre") * 1000).cast("int").alias("_pre"))
    found = lines(spark, d).select("track_id").distinct().withColumn("name", asked).join(F.broadcast(known), "name", "left")
    return found.select("track_id", F.when(F.col("_pre").isNull(), "max").otherwise(F.col("name")).alias("profile"), F.coalesce("_pre", F.lit(1250)).alias("pre_ms"))


CASES = SW + """, rs AS (SELECT track_id AS c, config, CASE WHEN (track_id + n) % 5 <> 0 THEN round(avg((k * n) % 97), 6) END AS mae, round(avg(conf) * n, 6) AS runtime
  FROM sw, (VALUES ('auto-max', 3), ('mix-balanced', 2), ('mix-fast', 1), ('vocals-balanced', 4)) m(config, n) GROUP BY track_id, config, n)"""


def results(spark, d):
    configs = spark.createDataFrame([("mix-fast", 1), ("mix-balanced", 2), ("auto-max", 3), ("vocals-balanced", 4)], "config string, n long")
    each = sung_words(spark, d).join(F.broadcast(configs))  # every case by every configuration
    agg = each.groupBy("track_id", "config", "n").agg(F.round(F.avg((F.col("k") * F.col("n")) % 97), 6).alias("mae"), F.round(F.avg("conf") * F.first("n"), 6).alias("runtime"))
    return agg.withColumn("mae", F.when((F.col("track_id") + F.col("n")) % 5 != 0, F.col("mae")))


@query("D6_case_matrix", CASES, "SELECT c AS track_id, config, mae, runtime FROM rs")
def d6(spark, d):
    return results(spark, d).select("track_id", "config", "mae", "runtime")


@query("E6_config_agg", CASES, "SELECT config, count(*) AS cases, round(avg(mae), 6) AS mae, round(avg(runtime), 6) AS runtime FROM rs GROUP BY config")
def e6(spark, d):
    return compare.by_config(results(spark, d))


@query("G8_config_rank", CASES, "SELECT config, mae, row_number() OVER (ORDER BY mae NULLS LAST, config)::INT AS place FROM (SELECT config, round(avg(mae), 6) AS mae FROM rs GROUP BY config)")
def g8(spark, d):
    order = Window.orderBy(F.col("mae").asc_nulls_last(), "config")  # one row for each configuration
    return compare.by_config(results(spark, d)).select("config", "mae", F.row_number().over(order).alias("place"))


CLOCK = SL + ", ck AS (SELECT track_id, line_idx AS tick, line_idx * 2300 + 111 AS t_ms FROM sl)"


def clock(spark, d):
    return lines(spark, d).select("track_id", F.col("line_idx").alias("tick"), (F.col("line_idx") * 2300 + 111).alias("t_ms"))


@query("D9_active_line_asof", CLOCK, "SELECT ck.track_id, tick, t_ms, line_idx FROM ck ASOF LEFT JOIN (SELECT track_id, anchor_ms AS s, line_idx FROM sl) l ON ck.track_id = l.track_id AND ck.t_ms >= l.s")
def d9(spark, d):
    return gaps.active_lines(lines(spark, d).select("track_id", "line_idx", F.col("anchor_ms").alias("start_ms")), clock(spark, d)).select("track_id", "tick", "t_ms", "line_idx")


@query("D10_word_state", CLOCK, """SELECT ck.track_id, tick, sum((start_ms <= t_ms AND e > t_ms)::INT) AS current, sum((e <= t_ms)::INT) AS done, sum((start_ms > t_ms)::INT) AS idle
  FROM ck JOIN (SELECT *, CASE WHEN k % 9 <> 0 THEN end_ms ELSE start_ms + 1000 END AS e FROM sw) w ON w.track_id = ck.track_id GROUP BY ck.track_id, tick""")
def d10(spark, d):
    some = sung_words(spark, d).withColumn("end_ms", F.when(F.col("k") % 9 != 0, F.col("end_ms")))
    return gaps.word_states(some, clock(spark, d)).select("track_id", F.col("tick"), "current", "done", "idle")


@query("D11_window_prune", SL, "SELECT a.track_id, a.line_idx, count(*) AS inside FROM sl a JOIN sw w ON w.track_id = a.track_id AND w.line_idx BETWEEN a.line_idx - 1 AND a.line_idx + 1 AND w.start_ms BETWEEN a.anchor_ms - 500 AND a.anchor_ms + 1500 GROUP BY ALL")
def d11(spark, d):
    # a word can only lie in the windows of its own line and its neighbours': an equi-join on these, then the range
    asked = lines(spark, d).select("track_id", F.col("line_idx").alias("_line"), "anchor_ms", F.explode(F.expr("array(line_idx - 1, line_idx, line_idx + 1)")).alias("line_idx"))
    hit = asked.join(sung_words(spark, d), ["track_id", "line_idx"]).where("start_ms between anchor_ms - 500 and anchor_ms + 1500")
    return hit.groupBy("track_id", F.col("_line").alias("line_idx")).agg(F.count("*").alias("inside"))


@query("D12_anti_missing", CAND, "SELECT track_id, line_idx, count(*) AS missing FROM sw ANTI JOIN cd USING (track_id, seq) GROUP BY track_id, line_idx")
def d12(spark, d):
    gone = sung_words(spark, d).join(rounded(spark, d).select("track_id", "seq"), ["track_id", "seq"], "left_anti")
    return gone.groupBy("track_id", "line_idx").agg(F.count("*").alias("missing"))


@query("E9_weighted_median", SW, """SELECT track_id, min(start_ms) FILTER (2 * run >= total) AS median_ms FROM (SELECT *, sum(greatest(k, 1)) OVER (PARTITION BY track_id ORDER BY start_ms, k ROWS UNBOUNDED PRECEDING) AS run,
  sum(greatest(k, 1)) OVER (PARTITION BY track_id) AS total FROM sw) GROUP BY track_id""")
def e9(spark, d):
    return ordered.weighted_median(sung_words(spark, d), ["track_id"], "start_ms", "k", "median_ms", 1)


@query("F1_line_clamp", SL, """, js AS (SELECT track_id, line_idx, anchor_ms + (anchor_ms // 400 * 7919) % 5003 AS s FROM sl),
rc AS (SELECT track_id, line_idx, s AS start_ms, false AS moved FROM js WHERE line_idx = 0 UNION ALL
  SELECT js.track_id, js.line_idx, CASE WHEN js.s < rc.start_ms THEN rc.start_ms + 1 ELSE js.s END, js.s < rc.start_ms FROM rc JOIN js ON js.track_id = rc.track_id AND js.line_idx = rc.line_idx + 1)
SELECT * FROM rc""")
def f1(spark, d):
    jittered = lines(spark, d).withColumn("start_ms", F.col("anchor_ms") + F.expr("(anchor_ms div 400 * 7919) % 5003"))
    return repair.line_starts(jittered)


@query("F2_display_clamp", SL, """SELECT track_id, line_idx, CASE WHEN v IS NOT NULL THEN greatest(max(coalesce(v, anchor_ms) - c) OVER w + c, c - 1) END AS display_ms
  FROM (SELECT *, count(v) OVER (PARTITION BY track_id ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, CASE WHEN line_idx % 3 <> 1 THEN anchor_ms + (anchor_ms // 400 * 7919) % 5003 END AS v FROM sl))
  WINDOW w AS (PARTITION BY track_id ORDER BY line_idx ROWS UNBOUNDED PRECEDING)""")
def f2(spark, d):
    shown = F.when(F.col("line_idx") % 3 != 1, F.col("anchor_ms") + F.expr("(anchor_ms div 400 * 7919) % 5003"))
    base = lines(spark, d).withColumn("start_ms", F.col("anchor_ms")).withColumn("display_ms", shown)
    return repair.display_starts(base).select("track_id", "line_idx", "display_ms")


@query("F4_word_clamp", SL, """, js AS (SELECT track_id, line_idx, word_idx, k, conf, origin,
  greatest(seq * 400 - word_idx * 400 + 100, coalesce(CASE WHEN k % 4 <> 1 THEN start_ms END, seq * 400 - word_idx * 400 + 100 + round(greatest(40 * count(*) OVER (PARTITION BY track_id, line_idx), 2400) * word_idx / count(*) OVER (PARTITION BY track_id, line_idx))::BIGINT)) AS s FROM sw),
rc AS (SELECT track_id, line_idx, word_idx, s AS start_ms, false AS moved FROM js WHERE word_idx = 0 UNION ALL
  SELECT js.track_id, js.line_idx, js.word_idx, CASE WHEN js.s < rc.start_ms THEN rc.start_ms + 1 ELSE js.s END, js.s < rc.start_ms FROM rc JOIN js ON js.track_id = rc.track_id AND js.line_idx = rc.line_idx AND js.word_idx = rc.word_idx + 1)
SELECT track_id, line_idx, word_idx, rc.start_ms, moved, least(conf, CASE WHEN moved THEN 0.25 ELSE 1 END, CASE WHEN k % 4 = 1 THEN 0.12 ELSE 1 END) AS conf,
  CASE WHEN k % 3 <> 0 THEN origin WHEN moved THEN 'repaired' WHEN k % 4 = 1 THEN 'interpolated' END AS origin FROM rc JOIN js USING (track_id, line_idx, word_idx)""")
def f4(spark, d):
    w = sung_words(spark, d).withColumn("line_start_ms", (F.col("seq") - F.col("word_idx")) * 400 + 100).withColumn("line_end_ms", F.col("line_start_ms") + 2400)
    return repair.word_starts(w.withColumns({"start_ms": F.when(F.col("k") % 4 != 1, F.col("start_ms")), "origin": F.when(F.col("k") % 3 != 0, F.col("origin"))}))


@query("F5_word_end", SW, """SELECT track_id, line_idx, word_idx, least(greatest(start_ms + 1, nxt), greatest(start_ms + 1, coalesce(e, nxt))) AS end_ms, CASE WHEN e IS NULL THEN least(conf, 0.12) ELSE conf END AS conf FROM
  (SELECT *, CASE WHEN k % 5 <> 0 THEN end_ms END AS e, coalesce(lead(start_ms) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx), greatest(seq * 400 + 900, start_ms + 40)) AS nxt FROM sw)""")
def f5(spark, d):
    w = sung_words(spark, d).withColumn("line_end_ms", F.col("seq") * 400 + 900).withColumn("end_ms", F.when(F.col("k") % 5 != 0, F.col("end_ms")))
    return repair.word_ends(w).select("track_id", "line_idx", "word_idx", "end_ms", "conf")


@query("F6_import_ends", SW, """SELECT track_id, line_idx, word_idx, coalesce(lead(start_ms) OVER (PARTITION BY track_id, line_idx ORDER BY word_idx), CASE WHEN k % 2 = 0 THEN end_ms END) AS end_ms FROM sw""")
def f6(spark, d):
    terminal = F.when(F.col("k") % 2 == 0, F.col("end_ms"))
    return sung_words(spark, d).select("track_id", "line_idx", "word_idx", F.coalesce(F.lead("start_ms").over(ordered.by_line()), terminal).alias("end_ms"))


@query("F14_islands", SW, """SELECT track_id, line_idx, min(word_idx) AS first, max(word_idx) AS last, count(*) AS length FROM (SELECT *, word_idx - row_number() OVER (PARTITION BY track_id, line_idx ORDER BY word_idx) AS g FROM sw WHERE conf < 0.45) GROUP BY track_id, line_idx, g""")
def f14(spark, d):
    return ordered.islands(sung_words(spark, d).where("conf < 0.45"), ["track_id", "line_idx"], "word_idx")


@query("F16_post_clamp", SW, """SELECT track_id, line_idx, word_idx, max(start_ms - n) OVER w + n AS start_ms FROM (SELECT *, row_number() OVER (PARTITION BY track_id, line_idx ORDER BY word_idx) AS n FROM sw) WINDOW w AS (PARTITION BY track_id, line_idx ORDER BY word_idx ROWS UNBOUNDED PRECEDING)""")
def f16(spark, d):
    return sung_words(spark, d).select("track_id", "line_idx", "word_idx", repair.post_clamp(F.col("start_ms"), ordered.by_line()).alias("start_ms"))


SWITCH = SL + """,
s0 AS (SELECT track_id, line_idx, min(start_ms) AS a, max(end_ms) AS e, round(avg(conf), 9) AS c, max(seq) * 400 + 400 + (max(k) * 29) % 500 - 250 AS ah, min(k) / 50.0 AS cl FROM sw GROUP BY track_id, line_idx),
s1 AS (SELECT *, lag(e) OVER w AS p, CASE WHEN line_idx % 5 <> 1 THEN lag(ah) OVER w END AS l, lag(cl) OVER w AS pc FROM s0 WINDOW w AS (PARTITION BY track_id ORDER BY line_idx)),
s2 AS (SELECT *, CASE WHEN l IS NULL THEN a WHEN abs(a - l) <= 180 THEN CASE WHEN 2 * (CASE WHEN a <= l THEN 0.2 + c * c ELSE 0.2 + pc * pc END) >= (0.2 + c * c) + (0.2 + pc * pc) THEN least(a, l) ELSE greatest(a, l) END
  WHEN pc >= c + 0.06 THEN l WHEN a < p - 25 AND l >= p - 35 THEN l ELSE a END AS d FROM s1),
s3 AS (SELECT *, CASE WHEN p IS NOT NULL AND p - d > 25 AND NOT (c >= 0.84 AND coalesce(pc, 0) >= 0.84 AND p - d <= 160) THEN p + 12 ELSE d END AS x, row_number() OVER (PARTITION BY track_id ORDER BY line_idx) AS n FROM s2),
s4 AS (SELECT *, x <> d AND x > a + 10 AS delayed, max(x - n) OVER (PARTITION BY track_id ORDER BY line_idx ROWS UNBOUNDED PRECEDING) + n AS display_ms FROM s3)"""


@query("F17_switches", SWITCH, "SELECT track_id, line_idx, display_ms, delayed, abs(display_ms - a) >= 20 AS reconciled FROM s4")
def f17(spark, d):
    g = sung_words(spark, d).groupBy("track_id", "line_idx").agg(
        F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_end_ms"), F.round(F.avg("conf"), 9).alias("conf"), (F.max("seq") * 400 + 400 + (F.max("k") * 29) % 500 - 250).alias("_ahead"), (F.min("k") / 50.0).alias("lookahead_conf")
    )
    known = g.withColumn("lookahead_ms", F.when((F.col("line_idx") + 1) % 5 != 1, F.col("_ahead")))
    return gaps.switch_displays(known).select("track_id", "line_idx", "display_ms", "delayed", "reconciled")
