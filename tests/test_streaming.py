"""Streams over several micro-batches and a restart: playback with changing lines and late ticks, breaks, progress events."""

from datetime import datetime, timedelta

from cantabile.streaming.progress import break_sessions, parse_events, playback

BEGIN = datetime(2024, 5, 1, 12)
EVENT = "track_id long, ts timestamp, kind string, line_idx long, at_ms long"


def at(seconds):
    return BEGIN + timedelta(seconds=seconds)


def put(spark, rows, schema, folder):
    """One file of the source."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def drained(stream, root, name):
    """Runs a stream over what is there, a file at a time, into a folder."""
    stream.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination(240)


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_playback_over_micro_batches_and_a_restart(spark, tmp_path):
    folder = f"{tmp_path}/in"
    put(spark, [(1, at(0), "line", 0, 1000), (1, at(0), "line", 1, 5000), (2, at(0), "line", 0, 100), (1, at(1), "tick", None, 500), (1, at(2), "tick", None, 1000), (2, at(2), "tick", None, 99)], EVENT, folder)
    put(spark, [(1, at(60), "tick", None, 6000), (1, at(61), "line", 1, 7000), (1, at(62), "tick", None, 6000), (3, at(62), "tick", None, 1)], EVENT, folder)
    drained(playback(source(spark, folder, EVENT)), tmp_path, "out")
    # a new query on the same checkpoint: lines of the first run are known; the tick of second 5 is later than the watermark
    put(spark, [(1, at(100), "tick", None, 7000), (1, at(5), "tick", None, 1234), (2, at(101), "gone", 0, None), (2, at(102), "tick", None, 5000), (1, at(103), "line", 2, 2000), (1, at(103), "tick", None, 2500)], EVENT, folder)
    drained(playback(source(spark, folder, EVENT)), tmp_path, "out")
    got = sorted((r.track_id, r.ts, r.at_ms, r.line_idx) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = [(1, 1, 500, None), (1, 2, 1000, 0), (1, 60, 6000, 1), (1, 62, 6000, 0), (1, 100, 7000, 1), (1, 103, 2500, 2), (2, 2, 99, None), (2, 102, 5000, None), (3, 62, 1, None)]
    assert got == [(t, at(s), ms, line) for t, s, ms, line in want]


def test_breaks_end_sessions_as_the_watermark_passes(spark, tmp_path):
    folder, schema = f"{tmp_path}/in", "track_id long, start timestamp, end timestamp"
    put(spark, [(1, at(0), at(1)), (1, at(3), at(4)), (1, at(20), at(21)), (2, at(0), at(10))], schema, folder)
    put(spark, [(1, at(22), at(23)), (2, at(13), at(14)), (1, at(400), at(401))], schema, folder)
    put(spark, [(1, at(800), at(801))], schema, folder)
    drained(break_sessions(source(spark, folder, schema)), tmp_path, "out")
    got = sorted((r.track_id, r.start, r.end, r.words) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # the end of a session is its last word's end and the gap
    assert got[:3] == [(1, at(0), at(8), 2), (1, at(20), at(27), 2), (1, at(400), at(405), 1)] and got[3] == (2, at(0), at(18), 2)


def test_progress_events_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    folder, schema = f"{tmp_path}/in", "value string"
    frames = ['data: {"type": "progress", "percent": 5, "message": "a"}\n\ndata: {"type": "progress",\ndata: "percent": 71}\n\n: beat\n\n', 'data: {"type": "result", "percent": 100}\n\nevent: x\ndata: nothing\n\n']
    for f in frames:
        put(spark, [(f,)], schema, folder)
    drained(parse_events(source(spark, folder, schema)), tmp_path, "out")
    rows = lambda df: sorted((r.type, r.percent, r.message or "", r.step) for r in df.collect())
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert got == rows(parse_events(spark.createDataFrame([(f,) for f in frames], schema))) == [("progress", 5.0, "a", "waiting"), ("progress", 71.0, "", "step3"), ("result", 100.0, "", "done")]
