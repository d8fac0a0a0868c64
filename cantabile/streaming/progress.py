"""Streams: progress events parsed and bucketed, and breaks found as words arrive."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cantabile.functions.timing import progress_step

EVENT = "type string, percent double, message string"


def parse_events(frames: DataFrame, column: str = "value") -> DataFrame:
    """Server-sent frames (blocks of `data:` lines, blank lines between) as rows (type, percent, message, step). Works on batches and streams."""
    blocks = frames.select(F.explode(F.split(F.col(column), r"\n\s*\n")).alias("block"))
    data = F.array_join(F.transform(F.filter(F.split("block", "\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, F.lit(6), F.length(x)))), "\n")
    rows = blocks.select(F.from_json(data, EVENT).alias("e")).where("e.type is not null").select("e.*")
    return rows.withColumn("step", progress_step(F.col("percent")))


def break_sessions(words: DataFrame, gap: str = "4 seconds", late: str = "1 minute") -> DataFrame:
    """Stretches of words without a break of `gap`, as words (track_id, start timestamp, end timestamp) arrive.

    An extension for streams: overlapping lines are bridged, where the batch operator compares neighbours only.
    """
    watched = words.withWatermark("start", late)
    return watched.groupBy("track_id", F.session_window("start", F.expr(f"concat(cast(unix_micros(end) - unix_micros(start) + {_micros(gap)} as string), ' microseconds')"))).agg(F.count("*").alias("words")).select("track_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "words")


def _micros(gap: str) -> int:
    n, unit = gap.split()
    return int(float(n) * {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}[unit.rstrip("s")])


def playback(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """What line is active at each tick of a track's clock, while its lines may still change: (track_id, ts, at_ms, line_idx) as ticks arrive.

    events: (track_id, ts timestamp, kind, line_idx, at_ms), kind is line (a line begins at at_ms, in place of what was known of it), gone (it is no more) or
    tick (the clock stands at at_ms). Of a micro-batch events count in the order of ts, changes before ticks. A tick before the first line has line null.
    A track's state is its lines alone, as many as it has. Events later than the watermark are dropped; after a restart from the checkpoint the lines are known.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            return
        lines = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(batches), ignore_index=True)
        rows = rows.assign(_tick=rows["kind"] == "tick").sort_values(["ts", "_tick", "line_idx", "at_ms"], kind="stable")
        order, out = sorted((at, i) for i, at in lines.items()), []
        for ts, kind, line, at in rows[["ts", "kind", "line_idx", "at_ms"]].itertuples(index=False, name=None):
            if kind == "tick":
                n = bisect_right(order, (at, float("inf")))
                out.append((key[0], ts, at, order[n - 1][1] if n else None))
                continue
            if kind == "gone":
                lines.pop(int(line), None)
            else:
                lines[int(line)] = int(at)
            order = sorted((at, i) for i, at in lines.items())
        state.update((list(lines), list(lines.values())))
        yield pd.DataFrame(out, columns=["track_id", "ts", "at_ms", "line_idx"]).astype({"line_idx": "Int64"})

    watched = events.select("track_id", "ts", "kind", "line_idx", "at_ms").withWatermark("ts", late)
    kind = events.schema["track_id"].dataType.simpleString()
    return watched.groupBy("track_id").applyInPandasWithState(
        follow, f"track_id {kind}, ts timestamp, at_ms long, line_idx long", "lines array<long>, starts array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
