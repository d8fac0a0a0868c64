"""Alignment of known words to frame log-probabilities: windows, CTC Viterbi, word spans, candidate scores.

The network that makes the log-probabilities is outside; they come as a column
array<array<double>>, frames by vocabulary, with id 0 for blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantabile.operators.ordered import next_with

SPAN = ("token_index", "token_id", "start_frame", "end_frame", "confidence")


def windows(lines: DataFrame, profiles: DataFrame, duration_ms: Column) -> DataFrame:
    """Search window of each line under each profile (three rows, broadcast): window_start_ms and window_end_ms, at least 200 ms apart. Needs anchor_ms, null where a line has none."""
    following = next_with(F.col("anchor_ms"), F.col("anchor_ms").isNotNull(), ["track_id"], "line_idx")
    each = lines.withColumn("next_anchor_ms", following).withColumn("_duration", duration_ms).where("anchor_ms is not null").join(F.broadcast(profiles.select("name", "pre", "post", "last_window")))
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    start = F.greatest(F.lit(0), F.col("anchor_ms") - ms("pre"))
    bounded = F.when(F.col("next_anchor_ms") > F.col("anchor_ms") + 50, F.least(F.col("_duration"), F.col("next_anchor_ms") + ms("post"))).otherwise(F.least(F.col("_duration"), F.col("anchor_ms") + ms("last_window")))
    return each.withColumn("window_start_ms", start).withColumn("window_end_ms", F.greatest(bounded, F.col("window_start_ms") + 200)).drop("pre", "post", "last_window", "_duration")


def feasible(frames: int, vocabulary: int, target: list[int]) -> bool:
    """Whether the ids are known and the frames hold them, with a blank between equal neighbours."""
    return bool(target) and min(target) >= 0 and max(target) < vocabulary and frames >= len(target) + sum(a == b for a, b in zip(target, target[1:]))


#: Frames by states by rows that are worked through at once.
AT_ONCE = 1 << 21


def viterbi_all(logps: list[np.ndarray], targets: list[list[int]], blank: int = 0) -> list[list[tuple[int, int, int, int, float]] | None]:
    """viterbi of many rows: rows of like size side by side, all states of a frame at once."""
    out: list = [[] if not t else None for t in targets]
    todo = [i for i, t in enumerate(targets) if len(logps[i]) and feasible(*logps[i].shape, t)]
    todo.sort(key=lambda i: (len(logps[i]), len(targets[i])))
    while todo:
        n, most = 0, 0
        while n < len(todo):
            most = max(most, 2 * len(targets[todo[n]]) + 1)
            if n and (n + 1) * most * len(logps[todo[n]]) > AT_ONCE:
                break
            n += 1
        some, todo = todo[:n], todo[n:]
        for i, found in zip(some, _side_by_side([logps[i] for i in some], [targets[i] for i in some], blank), strict=True):
            out[i] = found
    return out


def _side_by_side(logps: list[np.ndarray], targets: list[list[int]], blank: int) -> list[list[tuple[int, int, int, int, float]] | None]:
    rows, frames = len(logps), np.array([len(x) for x in logps])
    longest, wide = int(frames.max()), 2 * max(map(len, targets)) + 1
    states = np.full((rows, wide), blank)
    sizes = np.array([2 * len(t) + 1 for t in targets])
    for i, t in enumerate(targets):
        states[i, 1 : sizes[i] : 2] = t
    inside = np.arange(wide) < sizes[:, None]
    may_skip = np.zeros((rows, wide), bool)
    may_skip[:, 2:] = (states[:, 2:] != blank) & (states[:, 2:] != states[:, :-2])
    heard = np.full((longest, rows, wide), -np.inf)
    for i, x in enumerate(logps):
        heard[: len(x), i] = x[:, states[i]]
    heard[:, ~inside] = -np.inf
    score = np.full((rows, wide), -np.inf)
    score[:, :2] = heard[0, :, :2]
    came = np.zeros((longest, rows, wide), np.int8)
    one, two = np.full((rows, wide), -np.inf), np.full((rows, wide), -np.inf)
    for t in range(1, longest):
        one[:, 1:] = score[:, :-1]
        two[:, 2:] = np.where(may_skip[:, 2:], score[:, :-2], -np.inf)
        best, step = score, came[t]
        better = one > best
        best = np.where(better, one, best)
        step[better] = 1
        better = two > best
        best = np.where(better, two, best)
        step[better] = 2
        best = best + heard[t]
        on = t < frames
        score = np.where(on[:, None], best, score)
        if not on.all():
            step[~on] = 0
    row = np.arange(rows)
    last, before = score[row, sizes - 1], score[row, np.maximum(sizes - 2, 0)]
    state = np.where((before > last) & (sizes > 1), sizes - 2, sizes - 1)
    found = np.isfinite(score[row, state])
    path = np.zeros((longest, rows), int)
    for t in range(longest - 1, -1, -1):
        path[t] = state
        state = state - came[t, row, state]
    out: list = []
    for i, target in enumerate(targets):
        if not found[i]:
            out.append(None)
            continue
        p = path[: frames[i], i]
        on = np.flatnonzero(p % 2 == 1)
        token = p[on] // 2
        edges = np.searchsorted(token, np.arange(len(target) + 1))
        sure = np.concatenate(([0.0], np.cumsum(np.exp(logps[i][on, np.asarray(target)[token]]))))
        out.append([(k, int(v), int(on[a]), int(on[b - 1]) + 1, float((sure[b] - sure[a]) / (b - a))) for k, (v, a, b) in enumerate(zip(target, edges[:-1].tolist(), edges[1:].tolist()))])
    return out


def viterbi(logp: np.ndarray, target: list[int], blank: int = 0) -> list[tuple[int, int, int, int, float]] | None:
    """Best path of a target through frames, as (token_index, token_id, start_frame, end_frame, confidence); None if there is none.

    Of equal scores staying wins, then a step of one, then of two; the last state wins over the one before it unless that is better.
    """
    return viterbi_all([logp], [target], blank)[0]


def token_spans(df: DataFrame, keys: list[str], emission: str = "emission", target: str = "target") -> DataFrame:
    """(keys, token_index, token_id, start_frame, end_frame, confidence): the spans of each row's target in its emission; none if it can't be reached or either is null."""

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *key, e, t in pdf.itertuples(index=False, name=None):
                if e is not None and t is not None and len(e):
                    rows += [(*key, *span) for span in viterbi(np.stack(e), list(t)) or []]
            yield pd.DataFrame(rows, columns=[*keys, *SPAN])

    source = df.select(*keys, emission, target)
    kinds = [f"{k} {source.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} {'double' if c == 'confidence' else 'int'}" for c in SPAN]
    return source.mapInPandas(spans, ", ".join(kinds))


def longest_feasible(df: DataFrame, keys: list[str], k: str, feasible: Column) -> DataFrame:
    """Of the variants of a row with k words of lookahead the one with most words that can be aligned."""
    return df.where(feasible).groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.col(k)).alias("_best")).select(*keys, "_best.*")


def word_spans(spans: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Words (token_start, token_end) with the frames and mean confidence of their tokens; origin says whether it is low."""
    inside = words.withColumn("_i", F.explode(F.sequence("token_start", F.col("token_end") - 1)))
    joined = inside.join(spans.select(*keys, F.col("token_index").alias("_i"), "start_frame", "end_frame", "confidence"), [*keys, "_i"])
    out = joined.groupBy(*keys, "word_idx").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.round(F.avg("confidence"), 9).alias("confidence"))
    return out.withColumn("origin", F.when(F.col("confidence") < 0.25, "aligned_low_confidence").otherwise("aligned"))


def frame_time(frame: Column, frames: Column, window_start: Column, window_end: Column) -> Column:
    return window_start + frame * (window_end - window_start) / frames


def capped(end: Column, start: Column, limit: Column, conf: Column, origin: Column) -> dict[str, Column]:
    """A word that runs past the next line's start: cut there, with little confidence and its own origin."""
    over = end > limit
    return {"end_ms": F.when(over, F.greatest(start + 10, limit)).otherwise(end), "conf": F.when(over, F.least(conf, F.lit(0.35))).otherwise(conf), "origin": F.when(over, "repaired_boundary_context_cap").otherwise(origin)}


def even_split(lines: DataFrame, words: Column) -> DataFrame:
    """Words of a line that can't be aligned: equal shares of anchor to next anchor, or of 1.5 s; confidence .10."""
    following = F.lead("anchor_ms").over(Window.partitionBy("track_id").orderBy("line_idx"))
    span = F.coalesce(following - F.col("anchor_ms"), F.lit(1500))
    each = lines.select("track_id", "line_idx", "anchor_ms", span.alias("_span"), words.alias("_words")).select("*", F.posexplode("_words").alias("word_idx", "word"), F.size("_words").alias("_n"))
    at = lambda i: F.col("anchor_ms") + F.expr(f"(_span * ({i})) div _n")
    return each.select("track_id", "line_idx", "word_idx", "word", at("word_idx").alias("start_ms"), at("word_idx + 1").alias("end_ms"), F.lit(0.10).alias("conf"), F.lit("interpolated_unsupported_token").alias("origin"))


def candidate_score(conf: Column, last: Column, median: Column, least: Column, weak: Column, delta_ms: Column, lead_ms: Column, gap_ms: Column) -> Column:
    """How good an aligned line is: its mean, last, median and weakest words, less what is off at its edges."""
    lead = F.when(lead_ms < -80, 0.28).when(lead_ms < 30, 0.12).otherwise(0.0)
    gap = F.when(gap_ms <= 0, 0.30).when(gap_ms < 55, 0.10).otherwise(0.0)
    return 0.50 * conf + 0.18 * last + 0.20 * median + 0.12 * least - 0.16 * weak - F.least(F.lit(0.22), F.abs(delta_ms) / 1000 * 0.055) - lead - gap


def last_word_score(conf: Column, origin: Column, start_ms: Column, end_ms: Column, next_anchor_ms: Column, lookahead_ms: Column) -> Column:
    """How plausible a line's last word is, given the next line's anchor and what was foreseen of it."""
    weak = F.when(F.contains(origin, F.lit("low_confidence")) | origin.startswith("interpolated"), 0.12).otherwise(0.0)
    past = start_ms - next_anchor_ms
    late = F.when(past >= 80, 0.52).when(past >= -30, 0.18).otherwise(0.0)
    gap = lookahead_ms - start_ms
    room = F.when(gap <= 0, -0.65).when(gap < 55, -0.16).when(gap >= 100, F.least(F.lit(0.06), gap / 1000 * 0.03)).otherwise(0.0)
    over = F.when(end_ms > lookahead_ms + 50, 0.18).otherwise(0.0)
    short = F.when(end_ms - start_ms < 25, 0.05).otherwise(0.0)
    return conf - weak - late + room - over - short


def suspicious(conf: Column, start_ms: Column, end_ms: Column, next_anchor_ms: Column, lookahead_ms: Column, window_end_ms: Column, least_conf: Column | float, danger_ms: Column | int) -> Column:
    """Whether a line's end may be wrong; false without a next anchor, true without a timed word."""
    signs = (conf < least_conf) | (start_ms >= next_anchor_ms - danger_ms) | F.coalesce(lookahead_ms - start_ms < 65, F.lit(False)) | (window_end_ms - end_ms < 55)
    return F.when(next_anchor_ms.isNull(), False).when(start_ms.isNull(), True).otherwise(signs)


def retry_wanted(conf: Column, delta_ms: Column, weak: float, most_delta_ms: int, retry_margin: Column, margin: Column) -> Column:
    return ((conf < weak) | (F.abs(delta_ms) > most_delta_ms)) & (retry_margin > margin)


def keep_better(old: DataFrame, new: DataFrame, keys: list[str], score: str, least: float, equal: bool = False) -> DataFrame:
    """Of two passes the new row where it is better by more than `least` (equal: by that much), else the old; rows without a new one stay."""
    names = [c for c in old.columns if c not in keys]
    both = old.join(new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in names)), keys, "left")
    new, bar = F.col(f"_new_{score}"), F.col(score) + least
    wins = F.coalesce(new >= bar if equal else new > bar, F.lit(False))
    return both.select(*keys, *(F.when(wins, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in names), wins.alias("replaced"))


def reasons(low: Column, least: Column, share: Column, consecutive: Column, interpolated: Column, outlier: Column, boundary: Column, top: Column | bool = True) -> Column:
    """Why a line should be looked at again, in their order. top: whether the profile is the best."""
    by = lambda a, b: F.when(top if isinstance(top, Column) else F.lit(top), a).otherwise(b)
    told = [
        (least < by(0.32, 0.26), "very_low_word_confidence"), (share >= by(0.18, 0.28), "low_confidence_phrase"),
        (consecutive, "consecutive_weak_words"), (interpolated, "interpolated_word"), (outlier, "tempo_outlier"), (boundary, "boundary"),
    ]
    return F.filter(F.array(*(F.when(test, F.lit(name)) for test, name in told)), lambda x: x.isNotNull())


def rescue_gate(why: Column, severe: Column, balanced: Column | bool) -> Column:
    """Whether reasons lead to a rescue: some, not the boundary alone, and in the balanced profile a severe one."""
    some = (F.size(why) > 0) & ~((F.size(why) == 1) & (F.element_at(why, 1) == "boundary"))
    return some & (severe | ~(balanced if isinstance(balanced, Column) else F.lit(balanced)))
