"""Hard negatives of anchors: scores by a block matrix multiply in two dimensions, then the best of each tile merged.

Rows are packed into blocks of about ROWS rows, anchors into blocks of ANCHORS, and both are cut into chunks of CHUNK dimensions. An anchor
block and a row block meet for each chunk in a task of their own and make a partial tile of scores; partial tiles are shuffled in strips of STRIP anchors
and added up as 64-bit integers. The strips are written once and read twice: for the best rows of an anchor's own label in
each strip, merged into its positives, and for the best rows of other labels in the window of each of these positives. What is merged is a
few rows for each strip and anchor, cut again by Spark before it is shuffled. No task holds more than a block of rows or a strip, and the driver holds no block.

The work is anchors times rows times dimensions, as all anchors are asked against all rows; nothing is left out. It goes by rounds of anchor blocks, each of them
against all rows, so that what lies on disk at once is tiles of PAIRS scores, or those of one anchor block, not of all. Products are computed in floating point where the block's
largest numbers show that every sum stays exact (under 2**53), else in integers.

Defined results: rows with a null label, vector or component, or a component that isn't finite, take no part; shorter vectors count as filled up with
zeros; a scaled component beyond 2**26 becomes that bound, so that sums fit in 64 bits for up to 2**11 dimensions; equal rows are
different rows: copies of an anchor are its positives, and each is an anchor too; of equal scores a null id comes last, and a null id is no anchor; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantabile.llm.common import Shelf, bounded_batches, checkpoint, is_small, release, remove, shared_path, table

ROWS, ANCHORS, CHUNK, STRIP = 2048, 512, 32, 64
#: Scores of one round of anchor blocks.
PAIRS = 1 << 29
#: Strips' worth of positives that may be broadcast; each has a few hundred small rows at most.
BROADCAST_STRIPS = 2000
BOUND = 1 << 26
NO_ID = np.iinfo(np.int64).max


class Mining(NamedTuple):
    """Which rows are anchors, how many positives and negatives they get, and the window: percent of the positive's score."""

    positives: int = 5
    negatives: int = 3
    least_percent: int = 50
    most_percent: int = 95
    scale: int = 256


def quantised(rows: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """id, label and floor(scale * x) of the rows that take part."""
    v = F.col(f"`{vec_col}`")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(F.greatest(F.lit(-2.0 * BOUND), F.least(F.lit(2.0 * BOUND), x.cast("double") * scale))).cast("int")))
    known = rows.where(v.isNotNull() & label.isNotNull() & ~F.coalesce(odd, F.lit(False)))
    return known.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, whole).alias("vec"))


HEAD = ["rows", "ids", "labels"]
PACKED = "block int, chunk int, rows array<long>, ids array<long>, labels array<long>, matrix binary"


def packed(rows: DataFrame, block: Column, chunk: int) -> DataFrame:
    """A row for each block and chunk of dimensions: its matrix (row-major int32), and in chunk 0 the rows' numbers, ids and labels."""

    def pack(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        lengths = part["vec"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        wide = max(1, -(-int(lengths.max(initial=0)) // chunk)) * chunk
        m = np.zeros((len(part), wide), np.int32)
        m[np.arange(wide) < lengths[:, None]] = part["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        n = wide // chunk
        head = [pa.array([part[c].to_pylist(), *[None] * (n - 1)], pa.list_(pa.int64())) for c in ("row", "id", "label")]
        cuts = pa.array([m[:, i * chunk : (i + 1) * chunk].tobytes() for i in range(n)], pa.binary())
        return pa.table([pa.array(part["block"][:1].to_pylist() * n, pa.int32()), pa.array(range(n), pa.int32()), *head, cuts], names=["block", "chunk", *HEAD, "matrix"])

    return rows.select(block.cast("int").alias("block"), "row", "id", "label", "vec").groupBy("block").applyInArrow(pack, PACKED)


TILE = "i int, j int, strip int, a array<struct<row:long,id:long,label:long>>, b array<struct<row:long,id:long,label:long>>, scores binary"


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x times y transposed, exact in 64-bit integers."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def narrow(scores: np.ndarray) -> np.ndarray:
    """The same in 32 bits, if they fit."""
    return scores.astype(np.int32) if np.abs(scores).max(initial=0) < 1 << 31 else scores


def wide(raw: pa.Buffer, n: int) -> np.ndarray:
    """n scores of 32 or 64 bits."""
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * n else np.int64)


def partial_tiles(anchors: DataFrame, rows: DataFrame, anchor_blocks: range, n_row_blocks: int, chunk: int, strip: int) -> DataFrame:
    """(i, j, strip, a, b, scores): each of these anchor blocks against each row block, for each chunk of dimensions."""
    mine = anchors.where(F.col("block").between(anchor_blocks[0], anchor_blocks[-1]))
    a = mine.select(F.col("block").alias("i"), "chunk", F.arrays_zip(*HEAD).alias("a"), F.col("matrix").alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(n_row_blocks - 1))).alias("j"))
    every = F.explode(F.sequence(F.lit(anchor_blocks[0]), F.lit(anchor_blocks[-1]))).alias("i")
    b = rows.select(F.col("block").alias("j"), "chunk", F.arrays_zip(*HEAD).alias("b"), F.col("matrix").alias("_y"), every)
    # a side's files are small, but a block is there once for each block it meets: Spark must not broadcast it by the size of its files, nor put its tiles into a few tasks
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = ["i", "j", "chunk"]
    # a chunk that one side hasn't got is zero there; chunk 0 is on both sides and brings the heads
    pairs = a.repartition(parts, *met).join(b.repartition(parts, *met).hint("merge"), met)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                x, y = (np.frombuffer(row[c][0].as_buffer(), np.int32).reshape(-1, chunk) for c in ("_x", "_y"))
                head_a, head_b = ((row[c][0].values if row[c][0].is_valid else None) for c in ("a", "b"))
                for s in range(0, len(x), strip):
                    scores = narrow(product(x[s : s + strip], y))
                    yield pa.RecordBatch.from_arrays(
                        [
                            row["i"], row["j"], pa.array([s // strip], pa.int32()), lists(None if head_a is None else head_a.slice(s, strip)), lists(head_b),
                            pa.array([scores.tobytes()], pa.binary()),
                        ],
                        names=["i", "j", "strip", "a", "b", "scores"],
                    )

    return pairs.select("i", "j", "a", "b", "_x", "_y").mapInArrow(multiply, TILE)


PART = pa.struct([("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64())])


def lists(values: pa.StructArray | None) -> pa.ListArray:
    """One list of these values, or one null."""
    if values is None:
        return pa.array([None], pa.list_(PART))
    named = pa.StructArray.from_arrays([values.field(k).cast(pa.int64()) for k in range(3)], fields=list(PART))
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), named)


def added(partial: DataFrame) -> DataFrame:
    """Partial tiles added up; a sum that fits is kept in 32 bits."""

    def add(parts: pa.Table) -> pa.Table:
        head = next(i for i in range(len(parts)) if parts["a"][i].is_valid)
        total = np.zeros(len(parts["a"][head]) * len(parts["b"][head]), np.int64)
        for s in parts["scores"]:
            total += wide(s.as_buffer(), len(total))
        scores = pa.chunked_array([pa.array([narrow(total).tobytes()], pa.binary())])
        return parts.slice(head, 1).set_column(parts.schema.get_field_index("scores"), "scores", scores)

    return partial.groupBy("i", "j", "strip").applyInArrow(add, TILE)


class Strip(NamedTuple):
    """A strip of a tile: anchors' and rows' numbers, ids (null: the largest number), labels, and scores, anchors by rows."""

    a: tuple[np.ndarray, ...]
    b: tuple[np.ndarray, ...]
    scores: np.ndarray


def read_strip(batch: pa.RecordBatch, at: int) -> Strip:
    def head(c: str) -> tuple[np.ndarray, ...]:
        v = batch[c][at].values
        return tuple(v.field(k).fill_null(NO_ID).to_numpy(zero_copy_only=False) for k in range(3))

    a, b = head("a"), head("b")
    scores = wide(batch["scores"][at].as_buffer(), len(a[0]) * len(b[0]))
    return Strip(a, b, scores.reshape(len(a[0]), len(b[0])).astype(np.int64))


def best(scores: np.ndarray, ids: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of `among`: higher scores first, then smaller ids."""
    if len(among) > k:
        least = np.partition(scores[among], len(among) - k)[len(among) - k]
        sure, tied = among[scores[among] > least], among[scores[among] == least]
        if len(tied) > (room := k - len(sure)):  # of many ties only the smallest ids can be taken
            tied = tied[np.argpartition(ids[tied], room - 1)[:room]]
        among = np.concatenate((sure, tied))
    return among[np.lexsort((ids[among], -scores[among]))]


FOUND = "anchor long, anchor_id long, i int, strip int, spot int, positive long, positive_id long, positive_score long, found long, found_id long, score long"
NAMES = [x.split()[0] for x in FOUND.split(", ")]


def found_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"i": pa.int32(), "strip": pa.int32(), "spot": pa.int32()}
    columns = list(zip(*rows)) if rows else [[] for _ in NAMES]
    ids = {"anchor_id", "positive_id", "found_id"}
    return pa.RecordBatch.from_arrays([pa.array([None if n in ids and x == NO_ID else x for x in c], kinds.get(n, pa.int64())) for n, c in zip(NAMES, columns)], names=NAMES)


def own_label(strips: DataFrame, k: int) -> DataFrame:
    """The k best other rows of its label that each anchor has in each strip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (rows, ids, labels), (others, other_ids, other_labels), scores = read_strip(batch, at)
                i, strip, out = batch["i"][at].as_py(), batch["strip"][at].as_py(), []
                for spot in range(len(rows)):
                    among = np.flatnonzero((other_labels == labels[spot]) & (others != rows[spot]))
                    for p in best(scores[spot], other_ids, among, k):
                        out.append((rows[spot], ids[spot], i, strip, spot, None, None, None, others[p], other_ids[p], scores[spot, p]))
                yield found_batch(out)

    return strips.mapInArrow(run, FOUND)


def in_windows(asked: DataFrame, m: Mining) -> DataFrame:
    """The best rows of other labels in the window of each anchor and positive, in each strip. asked: strips with wanted, what the strip's anchors look for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (rows, ids, labels), (others, other_ids, other_labels), scores = read_strip(batch, at)
                i, strip, out, spot = batch["i"][at].as_py(), batch["strip"][at].as_py(), [], -1
                for w in sorted(batch["wanted"][at].as_py(), key=lambda w: w["spot"]):
                    if w["spot"] != spot:
                        spot = w["spot"]
                        strange = np.flatnonzero(other_labels != labels[spot])
                        hundred = 100 * scores[spot, strange]
                    among = strange[(hundred >= m.least_percent * w["score"]) & (hundred <= m.most_percent * w["score"])]
                    for p in best(scores[spot], other_ids, among, m.negatives):
                        out.append((rows[spot], ids[spot], i, strip, spot, w["found"], w["found_id"], w["score"], others[p], other_ids[p], scores[spot, p]))
                yield found_batch(out)

    return asked.mapInArrow(run, FOUND)


def top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each group; Spark cuts to k before the shuffle too."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, mining: Mining = Mining(), sizes: tuple[int, int, int, int] = (ROWS, ANCHORS, CHUNK, STRIP), pairs: int = PAIRS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: quantised; is_anchor: over its id; pairs: scores of one round."""
    spark = rows.sparkSession
    bounded_batches(spark)
    n_rows, n_anchors, chunk, strip = sizes
    known = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    anchors = known.where(is_anchor)
    count = known.agg(F.count("*"), F.count_if(F.coalesce(is_anchor, F.lit(False)))).first()
    blocks, anchor_blocks = max(1, -(-count[0] // n_rows)), max(1, -(-count[1] // n_anchors))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    shelf = Shelf(spark)
    b = shelf.put(packed(known, deal(blocks), chunk))
    a = shelf.put(packed(anchors, deal(anchor_blocks), chunk))
    at_once = max(1, pairs // max(1, count[0] * n_anchors))
    found = shared_path(spark, "negatives")
    for first in range(0, anchor_blocks, at_once):
        some = range(first, min(first + at_once, anchor_blocks))
        strips = shelf.put(added(partial_tiles(a, b, some, blocks, chunk, strip)))
        positives = checkpoint(top(own_label(strips, mining.positives), ["anchor"], mining.positives).drop("rank"))
        wanted = checkpoint(positives.groupBy("i", "strip").agg(F.collect_list(F.struct("spot", "found", "found_id", "score")).alias("wanted")))
        asked = strips.join(F.broadcast(wanted) if is_small(wanted, BROADCAST_STRIPS) else wanted, ["i", "strip"])
        negatives = top(in_windows(asked, mining), ["anchor", "positive"], mining.negatives)
        negatives.write.mode("append").parquet(found)
        shelf.drop(strips)
        if at_once < anchor_blocks:
            del positives, wanted, asked  # their files and those of the round's shuffles can go
            release(spark)
    shelf.drop(a, b)
    negatives = checkpoint(spark.read.schema(negatives.schema).parquet(found))
    remove(spark, found)
    return negatives.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, Mining().scale)
    return mine(rows, F.col("id") % 50 == 0)
