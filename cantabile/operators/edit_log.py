"""A log of an editor's commands over words, with undo and redo, replayed for all tracks at once. Times in milliseconds.

Two steps. `standing` runs each track's log as a machine with a stack of `DEPTH` edits, in one pass over sorted rows, and says which edits
hold in the end; edits too deep to be undone leave the stack at once, so memory doesn't grow with a log. `replay` then applies what holds to the words:
each command changes a word by what the word itself holds, so words need not meet and a long track spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantabile.operators.ordered import settled

#: How many edits can be undone.
DEPTH = 100
#: Commands of a track that are applied to its words at once.
ROUND = 500
#: What a command needs of line, word, at and text; undo and redo need none.
COMMANDS = {
    "shift": "all times of the track later by at",
    "nudge": "a word's times later by at",
    "begin": "a word begins at `at`; it lasts 50 ms if it would end before, and the word before ends by then",
    "text": "a word reads text",
    "split": "the line's words from word on become a line of their own",
    "add": "a word of text at place word, from at on for 400 ms",
    "drop_word": "a word goes",
    "drop_line": "a line goes with its words",
}
ARGS = {"command": "string", "line": "bigint", "word": "bigint", "at": "bigint", "text": "string"}


def standing(log: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(track_id, seq, command, line, word, at, text, state, place) of the edits that still count, from a log with these columns but the last two.

    state: `kept` can't be undone any more, `undoable`, or `redoable` (undone, and no edit came after). place numbers the first two in the order
    of their effect, from 0, and goes on with the redoable ones, the next to be redone first. An undo or redo without an edit to take does nothing,
    a null command neither. seq must be unique in a track.
    """
    kind = log.schema["track_id"].dataType.simpleString()
    rows = log.select("track_id", F.col("seq").cast("bigint").alias("seq"), *(F.col(c).cast(t).alias(c) for c, t in ARGS.items())).where("command is not null")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, done, undone, place = None, [], [], 0

        def rest() -> list[tuple]:
            left = [(row, "undoable") for row in done] + [(row, "redoable") for row in reversed(undone)]
            return [(*row, state, place + i) for i, (row, state) in enumerate(left)]

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if (row[0],) != here:
                    out += rest()
                    here, done, undone, place = (row[0],), [], [], 0
                if row[2] == "undo":
                    if done:
                        undone.append(done.pop())
                elif row[2] == "redo":
                    if undone:
                        done.append(undone.pop())
                else:
                    done.append(row)
                    undone = []
                    if len(done) > depth:
                        out.append((*done.pop(0), "kept", place))
                        place += 1
            if out:
                yield table(out, batch)
            schema_of = batch
        if here is not None and (out := rest()):
            yield table(out, schema_of)

    def table(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        types = [*(c.type for c in like.columns), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [*names, "state", "place"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in ARGS.items())
    return rows.repartition("track_id").sortWithinPartitions("track_id", "seq").mapInArrow(run, f"track_id {kind}, seq bigint, {kinds}, state string, place bigint")


def resumed(state: DataFrame, log: DataFrame) -> DataFrame:
    """A log that goes on from where `standing` ended: words saved after its kept edits, replayed with this, are as the whole log makes them.

    state: what standing gave; log: the commands that came after. What could be redone is done and undone again, so it can be redone still.
    """
    held = state.where("state <> 'kept'").select("track_id", F.lit(0).alias("_turn"), "place", *ARGS)
    again = state.where("state = 'redoable'").select("track_id", F.lit(1).alias("_turn"), "place", F.lit("undo").alias("command"))
    after = log.select("track_id", F.lit(2).alias("_turn"), F.col("seq").cast("bigint").alias("place"), *ARGS)
    every = held.unionByName(again, allowMissingColumns=True).unionByName(after)
    seq = F.row_number().over(Window.partitionBy("track_id").orderBy("_turn", "place"))
    return every.select("track_id", seq.cast("bigint").alias("seq"), *ARGS)


def replay(words: DataFrame, state: DataFrame, of: tuple[str, ...] = ("kept", "undoable"), batch: int = ROUND) -> DataFrame:
    """(track_id, line_idx, word_idx, word, start_ms, end_ms) after the edits of `standing` whose state is in `of`.

    Commands go to the words in rounds of `batch` a track: an array of so many is joined to each word and folded over it. A track with many words is
    one that the engine may split in the join; a track with many commands takes more rounds. Commands on a place without a word do nothing.
    """
    held = settled(state.where(F.col("state").isin(*of)).withColumn("_round", F.expr(f"place div {batch}")))  # read once for each round and twice more
    kinds = {"line_idx": "bigint", "word_idx": "bigint", "word": "string", "start_ms": "bigint", "end_ms": "bigint"}
    born = held.where("command = 'add'").select("track_id", F.col("line").alias("line_idx"), F.col("word").alias("word_idx"), F.col("text").alias("word"), F.col("at").alias("start_ms"), (F.col("at") + 400).alias("end_ms"), F.col("place").alias("_born"))
    now = words.select("track_id", *(F.col(c).cast(t).alias(c) for c, t in kinds.items()), F.lit(-1).cast("bigint").alias("_born")).unionByName(born)
    command = F.struct("place", *ARGS)
    rounds = held.groupBy("track_id", "_round").agg(F.sort_array(F.collect_list(command)).alias("_commands"))
    last = held.agg(F.max("_round")).first()[0]
    word = now.select("track_id", F.struct(*kinds, "_born", F.lit(False).alias("gone")).alias("w"))
    for i in range(0 if last is None else last + 1):
        folded = F.when(F.col("_commands").isNull() | F.col("w.gone"), F.col("w")).otherwise(F.aggregate("_commands", F.col("w"), _after))
        word = word.join(rounds.where(F.col("_round") == i).select("track_id", "_commands"), "track_id", "left").select("track_id", folded.alias("w"))
    return word.where("not w.gone").select("track_id", *(f"w.{c}" for c in kinds))


def _after(w: Column, c: Column) -> Column:
    """What command c leaves of word w; a word added later than c isn't touched by it."""
    named, same_line = c["command"], w["line_idx"] == c["line"]
    here, behind = same_line & (w["word_idx"] == c["word"]), same_line & (w["word_idx"] >= c["word"])
    is_ = lambda name: named == name
    late = F.when(is_("shift") | (is_("nudge") & here), c["at"]).otherwise(0)
    start, end = (F.when(w[t] + late < 0, 0).otherwise(w[t] + late) for t in ("start_ms", "end_ms"))
    begins, before = is_("begin") & here, is_("begin") & same_line & (w["word_idx"] == c["word"] - 1)
    places = {
        "line_idx": [(is_("split") & (behind | (w["line_idx"] > c["line"])), w["line_idx"] + 1), (is_("drop_line") & (w["line_idx"] > c["line"]), w["line_idx"] - 1)],
        "word_idx": [(is_("split") & behind, w["word_idx"] - c["word"]), (is_("add") & behind, w["word_idx"] + 1), (is_("drop_word") & behind & ~here, w["word_idx"] - 1)],
        "word": [(is_("text") & here, c["text"])],
        "start_ms": [(begins, c["at"]), (F.lit(True), start)],
        "end_ms": [(begins & ~F.coalesce(end > c["at"], F.lit(False)), c["at"] + 50), (before & (end > c["at"]), c["at"]), (F.lit(True), end)],
    }
    told = lambda name, cases: reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), w[name])
    gone = w["gone"] | F.coalesce((is_("drop_word") & here) | (is_("drop_line") & same_line), F.lit(False))
    changed = F.struct(*(told(name, cases).alias(name) for name, cases in places.items()), w["_born"].alias("_born"), gone.alias("gone"))
    return F.when(w["gone"] | (c["place"] <= w["_born"]), w).otherwise(changed)
