"""Consensus of several passes, interpolation of missing words, tempo, and reconstruction of unstable words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantabile.operators.ordered import maxplus_clamp

LINE = ["track_id", "line_idx"]
WORD = [*LINE, "word_idx"]


def _lower_median(observed: Column, value: str) -> Column:
    """The value, in order, at which half of the weight .15 + conf^2 of the observations is reached."""
    ordered = F.sort_array(F.transform(observed, lambda o: F.struct(o[value].alias("v"), (0.15 + o["conf"] * o["conf"]).alias("w"))))
    half = F.aggregate(ordered, F.lit(0.0), lambda run, x: run + x["w"]) / 2 - 1e-12
    none = F.lit(None).cast("double")
    reached = F.aggregate(
        ordered, F.struct(F.lit(0.0).alias("run"), none.alias("v")),
        lambda s, x: F.struct((s["run"] + x["w"]).alias("run"), F.coalesce(s["v"], F.when(s["run"] + x["w"] >= half, x["v"].cast("double"))).alias("v")),
    )
    return reached["v"].cast("bigint")


def consensus(passes: DataFrame, most_spread_ms: int = 155, keys: list[str] = WORD) -> DataFrame:
    """A row for each word from its observations in several passes (pass_idx, start_ms, end_ms, conf; origin if there is one).

    Weighted medians of starts and ends where at least two observations lie within the spread, the most
    confident observation, of equal ones the first, where not. A word's observations are as many as passes, so they
    are gathered once.
    """
    origin = F.col("origin") if "origin" in passes.columns else F.lit(None).cast("string")
    g = passes.where("start_ms is not null").groupBy(*keys).agg(F.collect_list(F.struct("start_ms", "end_ms", "conf", "pass_idx", origin.alias("origin"))).alias("_o"))
    of = lambda c: F.transform("_o", lambda o: o[c])
    best = F.array_max(F.transform("_o", lambda o: F.struct(o["conf"].alias("conf"), (-o["pass_idx"]).alias("pass_idx"), o["start_ms"].alias("start_ms"), o["end_ms"].alias("end_ms"), o["origin"].alias("origin"))))
    told = g.select(
        *keys, F.size("_o").cast("long").alias("n"), (F.array_max(of("start_ms")) - F.array_min(of("start_ms"))).alias("spread_ms"), best.alias("_best"),
        (F.aggregate(of("conf"), F.lit(0.0), lambda a, x: a + x) / F.size("_o")).alias("_mean"), _lower_median(F.col("_o"), "start_ms").alias("_start"), _lower_median(F.col("_o"), "end_ms").alias("_end"),
    )
    agree = (F.col("n") >= 2) & (F.col("spread_ms") <= most_spread_ms)
    return told.select(
        *keys, "n", "spread_ms",
        F.when(agree, F.col("_start")).otherwise(F.col("_best.start_ms")).alias("start_ms"),
        F.when(agree, F.col("_end")).otherwise(F.col("_best.end_ms")).alias("end_ms"),
        F.round(F.when(agree, F.least(F.lit(0.97), F.col("_mean") + 0.025)).otherwise(F.col("_best.conf")), 9).alias("conf"),
        F.when(agree, "adaptive_consensus").otherwise(F.coalesce("_best.origin", F.lit("adaptive_best_pass"))).alias("origin"),
    )


def interpolate_missing(words: DataFrame, keys: list[str] = LINE, origin: str = "interpolated", keep: list[str] | None = None) -> DataFrame:
    """Words without a start share the room between their timed neighbours, or the line's ends, equally: 30 ms each at least, confidence .10. keep: further columns to carry."""
    order = Window.partitionBy(*keys).orderBy("word_idx")
    timed = F.col("start_ms").isNotNull()
    left = F.last(F.when(timed, F.col("end_ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(F.col("start_ms"), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    block = F.sum(timed.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = words.withColumns({"_left": F.coalesce(left, F.col("line_start_ms")), "_right": F.coalesce(right, F.col("line_end_ms")), "_block": block, "_timed": timed})
    inside = Window.partitionBy(*keys, "_block", "_timed")
    placed = marked.withColumns({"_n": F.count("*").over(inside), "_i": F.row_number().over(inside.orderBy("word_idx")) - 1})
    placed = placed.withColumn("_span", F.greatest(30 * F.col("_n"), F.col("_right") - F.col("_left")))
    at = lambda i: F.col("_left") + F.expr(f"(_span * ({i})) div _n")
    return placed.select(
        *keys, "word_idx", *(keep or []),
        F.coalesce("start_ms", at("_i")).alias("start_ms"),
        F.when(F.col("_timed"), F.col("end_ms")).otherwise(at("_i + 1")).alias("end_ms"),
        F.when(F.col("_timed"), F.col("conf")).otherwise(0.10).alias("conf"),
        F.when(F.col("_timed"), F.col("origin")).otherwise(origin).alias("origin"),
    )


def nine_places(x: Column) -> Column:
    """x to nine places: billionths rounded to the next whole number, as SQL rounds a double. Spark alone rounds the decimals that x prints as, so what lies by a half may go the other way."""
    return F.round(x * 1e9) / 1e9


def line_tempo(words: DataFrame) -> DataFrame:
    """(track_id, line_idx, tempo, steady): seconds per unit of pronunciation, null where a line says too little; steady: whether at most a quarter of its words are bad. Needs units."""
    bad = (F.col("conf") < 0.42) | F.col("origin").startswith("interpolated") | F.col("origin").startswith("tempo_")
    g = words.groupBy(*LINE).agg(
        F.count("start_ms").alias("_n"), F.min_by("start_ms", "word_idx").alias("_first"), F.max_by("end_ms", "word_idx").alias("_right"),
        F.sort_array(F.collect_list(F.struct("word_idx", "conf", "units"))).alias("_w"), F.avg(bad.cast("int")).alias("_bad"),
    )
    # sums in word order: in another a mean may fall on the other side of a limit
    total = lambda c: F.aggregate("_w", F.lit(0.0), lambda a, w: a + F.coalesce(w[c], F.lit(0.0)))
    counted = F.size(F.filter("_w", lambda w: w["conf"].isNotNull()))
    g = g.withColumns({"_conf": F.when(counted > 0, total("conf") / counted), "_units": total("units")})
    span = F.col("_right") - F.col("_first")
    value = span / 1000 / F.col("_units")
    ok = (F.col("_n") >= 2) & (F.col("_conf") >= 0.45) & (span > 80) & value.between(0.018, 0.42)
    return g.select(*LINE, nine_places(F.when(ok, value)).alias("tempo"), (F.col("_bad") <= 0.25).alias("steady"))


def tempo_prior(tempos: DataFrame, radius: int = 3) -> DataFrame:
    """Adds prior: the median tempo of steady lines within `radius`, the line itself left out, or of all the track's lines."""
    order = Window.partitionBy("track_id").orderBy("line_idx")
    local = F.when(F.col("steady"), F.col("tempo"))
    near = F.concat(F.collect_list(local).over(order.rowsBetween(-radius, -1)), F.collect_list(local).over(order.rowsBetween(1, radius)))
    s, n = F.sort_array(near), F.size(near)
    middle = (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2
    every = F.median("tempo").over(Window.partitionBy("track_id"))
    return tempos.withColumn("prior", nine_places(F.when(n > 0, middle).otherwise(every)))


def tempo_outliers(words: DataFrame) -> DataFrame:
    """Adds outlier: whether a word's length is far from what the tempo asks for and little trusted; needs units, prior (null: none) and right_ms, where the line must end."""
    following = F.lead("start_ms").over(Window.partitionBy(*LINE).orderBy("word_idx"))
    ratio = (F.coalesce(following, "right_ms", "end_ms") - F.col("start_ms")) / 1000 / F.greatest(F.lit(0.035), F.col("units") * F.col("prior"))
    weak = (F.col("conf") < 0.45) & ((ratio < 0.22) | (ratio > 3.40))
    wild = (F.col("conf") < 0.62) & ((ratio < 0.12) | (ratio > 5.00))
    return words.withColumn("outlier", F.when(F.col("prior").isNull(), False).when(F.col("start_ms").isNull(), True).otherwise(F.coalesce(weak | wild, F.lit(False))))


def consecutive_weak(words: DataFrame, least: float) -> DataFrame:
    """(track_id, line_idx, consecutive): whether two words in a row are below `least`."""
    low = F.col("conf") < least
    both = low & F.coalesce(F.lead(low).over(Window.partitionBy(*LINE).orderBy("word_idx")), F.lit(False))
    return words.select(*LINE, both.alias("_b")).groupBy(*LINE).agg(F.bool_or("_b").alias("consecutive"))


def reconstruct(words: DataFrame) -> DataFrame:
    """Unstable words (unstable) of each block are set anew in proportion to their units between the neighbours.

    Every start lies 12 ms after the one before and leaves 12 ms for each word to come. The upper bound rises by the same 12 ms
    as the lower, so a running maximum, cut at the bound, gives the recurrence. Needs line_start_ms, line_end_ms.
    """
    order = Window.partitionBy(*LINE).orderBy("word_idx")
    stable = ~F.col("unstable")
    block = F.sum(stable.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # neighbours in the whole line: a block lies between two stable words
    edges = {"_block": block, "_left": F.coalesce(F.last(F.when(stable, F.col("end_ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.first("line_start_ms").over(order))}
    edges["_right"] = F.coalesce(F.first(F.when(stable, F.col("start_ms")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), F.first("line_end_ms").over(order))
    inside = Window.partitionBy(*LINE, "_block", "unstable")
    inner = inside.orderBy("word_idx")
    run = inner.rowsBetween(Window.unboundedPreceding, -1)
    sized = words.withColumns(edges).withColumns({"_n": F.count("*").over(inside), "_i": F.row_number().over(inner) - 1, "_all": F.sum("units").over(inside), "_done": F.coalesce(F.sum("units").over(run), F.lit(0.0))})
    sized = sized.withColumn("_right", F.greatest("_right", F.col("_left") + 40 * F.col("_n")))
    wanted = F.greatest(F.col("_left") + 11.0, F.col("_left") + F.col("_done") * (F.col("_right") - F.col("_left")) / F.col("_all"))
    placed = sized.withColumn("_wanted", wanted).withColumn("_set", F.least(maxplus_clamp(F.col("_wanted"), inner, 12), F.col("_right") - 12.0 * (F.col("_n") - F.col("_i"))))
    following = F.coalesce(F.lead("_set").over(inner), F.col("_right").cast("double"))
    anew = lambda new, old: F.when(F.col("unstable"), new).otherwise(F.col(old).cast("double"))
    return placed.select(
        *WORD, anew(F.col("_set"), "start_ms").alias("start_ms"), anew(following, "end_ms").alias("end_ms"),
        anew(F.least(F.lit(0.44), F.greatest(F.lit(0.24), 0.72 * F.col("conf") + 0.16)), "conf").alias("conf"), F.when(F.col("unstable"), "tempo_energy_rescue").otherwise(F.col("origin")).alias("origin"),
    )


def novelty_peak(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, strength): where log energy rises most, if by .10 more than the median rise. frames: (keys, frame, energy)."""
    order = Window.partitionBy(*keys).orderBy("frame")
    level = F.log(F.col("energy") + 1e-6)
    rise = frames.withColumn("_level", level).withColumn("_rise", F.greatest(F.lit(0.0), F.col("_level") - F.coalesce(F.lag("_level").over(order), F.col("_level"))))
    top = rise.groupBy(*keys).agg(F.max_by(F.struct("frame", "_rise"), F.struct("_rise", -F.col("frame"))).alias("_top"), F.median("_rise").alias("_middle"), F.count("*").alias("_n"))
    return top.where("_n >= 3 and _top._rise >= _middle + 0.10").select(*keys, "_top.frame", F.round("_top._rise", 6).alias("strength"))
