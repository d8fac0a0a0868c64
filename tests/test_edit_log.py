"""The editor's log against a plain editor that keeps whole copies on its stacks."""

import random

import pytest

from cantabile.operators import edit_log

WORDS = "track_id long, line_idx long, word_idx long, word string, start_ms long, end_ms long"
LOG = "track_id long, seq long, command string, line long, word long, at long, text string"


def edited(lines, command, i, j, at, text):
    """lines: lists of [word, start, end]; changed in place."""
    line = lines[i] if i is not None and 0 <= i < len(lines) else None
    word = line[j] if line is not None and j is not None and 0 <= j < len(line) else None
    if command == "shift":
        for w in (w for x in lines for w in x):
            w[1], w[2] = max(0, w[1] + at), max(0, w[2] + at)
    elif command == "nudge" and word:
        word[1], word[2] = max(0, word[1] + at), max(0, word[2] + at)
    elif command == "begin" and word:
        word[1] = at
        if not word[2] > at:
            word[2] = at + 50
        if j and line[j - 1][2] > at:
            line[j - 1][2] = at
    elif command == "text" and word:
        word[0] = text
    elif command == "split" and word:
        lines.insert(i + 1, line[j:])
        del line[j:]
    elif command == "add" and line is not None and j <= len(line):
        line.insert(j, [text, at, at + 400])
    elif command == "drop_word" and word:
        del line[j]
    elif command == "drop_line" and line is not None:
        del lines[i]


def plain(lines, log, depth):
    lines, undo, redo = [[list(w) for w in x] for x in lines], [], []
    copy = lambda: [[list(w) for w in x] for x in lines]
    for command, *args in log:
        if command == "undo":
            if undo:
                redo.append(copy())
                lines = undo.pop()
        elif command == "redo":
            if redo:
                undo.append(copy())
                lines = redo.pop()
        else:
            undo.append(copy())
            if len(undo) > depth:
                undo.pop(0)
            redo = []
            edited(lines, command, *args)
    return lines, len(undo), len(redo)


def track(rng, n):
    """Lines and a log whose commands name places that exist, as an editor's would."""
    lines = [[[f"w{i}{j}", i * 1000 + j * 200, i * 1000 + j * 200 + 150] for j in range(rng.randrange(2, 6))] for i in range(4)]
    log = []
    for _ in range(n):
        now = plain(lines, log, 7)[0]
        full = [i for i, x in enumerate(now) if len(x) > 1]
        command = rng.choice([*edit_log.COMMANDS, "undo", "undo", "undo", "redo", "redo"])
        if command in ("undo", "redo") or not full:
            log.append((rng.choice(["undo", "redo"]), None, None, None, None))
        else:
            i = rng.choice(full)
            j = rng.randrange(1, len(now[i])) if command == "split" else len(now[i]) if command == "add" else rng.randrange(len(now[i]))
            log.append((command, i, j, rng.randrange(-300, 900) if command in ("shift", "nudge") else rng.randrange(5000), f"t{len(log)}"))
    return lines, log


@pytest.fixture(scope="module")
def tracks():
    rng = random.Random(6)
    return {t: track(rng, n) for t, n in enumerate([0, 5, 30, 60, 60, 60, 90, 200])}


def frames(spark, tracks, first=0, last=None):
    words = [(t, i, j, *w) for t, (lines, _) in tracks.items() for i, x in enumerate(lines) for j, w in enumerate(x)]
    log = [(t, n, *row) for t, (_, rows) in tracks.items() for n, row in enumerate(rows) if n >= first and (last is None or n < last)]
    return spark.createDataFrame(words, WORDS), spark.createDataFrame(log, LOG).repartition(3)


def as_rows(lines):
    return [(i, j, *w) for i, x in enumerate(lines) for j, w in enumerate(x)]


def of_track(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.track_id, []).append((r.line_idx, r.word_idx, r.word, r.start_ms, r.end_ms))
    return {t: sorted(rows) for t, rows in out.items()}


def test_replay_is_what_an_editor_with_copies_gets(spark, tracks):
    words, log = frames(spark, tracks)
    state = edit_log.standing(log, 7).cache()
    got = of_track(edit_log.replay(words, state, batch=25))
    steps = {(r.track_id, r.state): r["count"] for r in state.groupBy("track_id", "state").count().collect()}
    for t, (lines, rows) in tracks.items():
        want, undo, redo = plain(lines, rows, 7)
        assert got[t] == as_rows(want), t
        assert (steps.get((t, "undoable"), 0), steps.get((t, "redoable"), 0)) == (undo, redo)


def test_a_replay_may_start_from_a_snapshot(spark, tracks):
    words, head = frames(spark, tracks, last=40)
    _, tail = frames(spark, tracks, first=40)
    state = edit_log.standing(head, 7).cache()
    saved = edit_log.replay(words, state, ("kept",))
    later = edit_log.standing(edit_log.resumed(state, tail), 7)
    got = of_track(edit_log.replay(saved, later))
    for t, (lines, rows) in tracks.items():
        assert got[t] == as_rows(plain(lines, rows, 7)[0]), t


def test_state_is_kept_over_batches(spark, tracks):
    _, log = frames(spark, tracks)
    whole = sorted(edit_log.standing(log, 7).collect(), key=repr)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        assert sorted(edit_log.standing(log, 7).collect(), key=repr) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_logs_of_nothing(spark):
    log = spark.createDataFrame([(1, 0, "undo", None, None, None, None), (1, 1, "redo", None, None, None, None), (1, 2, None, 0, 0, 5, "x"), (None, 0, "shift", None, None, 5, None), (2, 0, "text", 9, 9, None, "x")], LOG)
    words = spark.createDataFrame([(1, 0, 0, "a", 1, 2), (2, 0, 0, None, None, None)], WORDS)
    state = edit_log.standing(log)
    assert [(r.track_id, r.state) for r in state.orderBy("track_id").collect()] == [(None, "undoable"), (2, "undoable")]
    assert of_track(edit_log.replay(words, state)) == {1: [(0, 0, "a", 1, 2)], 2: [(0, 0, None, None, None)]}
    none = spark.createDataFrame([], LOG)
    assert edit_log.standing(none).collect() == []
    assert len(edit_log.replay(words, edit_log.standing(none)).collect()) == 2
