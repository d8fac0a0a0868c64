"""Ordered computations on partitions of rows: strict and max-plus clamps, islands, weighted medians, as-of lookups.

A recurrence that only shifts and takes maxima is a running window. One that branches on its own
last value is one pass over sorted rows that keeps that value.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Places of a track that meet in one task at once.
STRETCH = 65_536


def by_track() -> WindowSpec:
    return Window.partitionBy("track_id").orderBy("line_idx")


def by_line() -> WindowSpec:
    return Window.partitionBy("track_id", "line_idx").orderBy("word_idx")


def strict_clamp(
    df: DataFrame, keys: list[str], order: str, value: str, floor: Column | None = None, step: int = 1, kind: str = "bigint", keep: list[str] | None = None, missing: bool = False,
    stretch: int | None = None,
) -> DataFrame:
    """Lifts a value below its predecessor to the predecessor plus `step`; others stay: (keys, order, value, moved, keep). Nothing is below `floor`, or 0.

    Not a running maximum: after a lift the next row is compared with the lifted value. Rows pass in order in batches; only where one falls
    below the one before is anything done, row by row until a row's own value holds again, so rows in order cost a comparison
    of arrays. A null counts as the floor; with missing=True it takes its predecessor plus `step` (the first 0), and isn't called moved.

    With `stretch` a group is cut wherever order passes a multiple of it, so a long one spreads over tasks: see `carries`. Leave it out
    where groups are bounded.
    """
    least = F.lit(0) if floor is None else floor
    given = F.greatest(least, F.col(value)).cast(kind)
    given = F.when(F.col(value).isNotNull(), given) if missing else given
    nth = F.lit(0) if stretch is None else F.expr(f"`{order}` div {int(stretch)}")
    rows = df.select(*keys, nth.cast("bigint").alias("_nth"), F.col(order).cast("bigint").alias(order), given.alias(value), *(keep or []))
    group = [*keys, "_nth"]
    if stretch is None:
        dealt = rows.repartition(*keys).withColumn("_carry", F.lit(None).cast(kind))
    else:
        # a struct of the keys, as keys may be null; both readers share this one exchange
        apart = rows.withColumn("_part", F.struct(*group)).repartition("_part")
        dealt = apart.join(carries(apart, keys, order, value, kind, step), "_part", "left").drop("_part")
    wanted = [f for f in dealt.schema.fields if f.name not in ("_nth", "_carry")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if batch.num_rows:
                x, blank, same, before_value = _ordered_batch(batch, group, value, before)
                carried = batch.column("_carry")
                moved = _lift(x, blank, same, before_value, carried.is_valid().to_numpy(zero_copy_only=False), carried.fill_null(0).to_numpy(zero_copy_only=False), step)
                before = (_key(batch, group, -1), x[-1])
                out = {f.name: batch.column(f.name) for f in wanted} | {value: pa.array(x, batch.column(value).type), "moved": pa.array(moved, pa.bool_())}
                yield pa.RecordBatch.from_pydict(out)

    return dealt.sortWithinPartitions(*group, order, F.col(value).asc_nulls_last()).mapInArrow(run, f"{kinds}, moved boolean")


def carries(apart: DataFrame, keys: list[str], order: str, value: str, kind: str, step: int) -> DataFrame:
    """(_part, _carry): the clamped value that each stretch of a group but the first is entered with.

    Whatever value s a stretch is entered with, it adds `step` a row until a row i (from 0) holds s + i * step or more, and from there on
    goes the way it goes by itself. So a stretch is told by how many rows it has, the largest of its values less i * step, and its last
    value by itself; one short row for each is passed along, in order, from stretch to stretch.
    """
    group = [*keys, "_nth"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in apart.select(*group).schema.fields)
    least = np.iinfo(np.int64).min

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, None  # the stretch that is still open: key, rows, reach, last

        def give(rows: list) -> pa.RecordBatch:
            columns = zip(*((*key, n, reach, last) for key, n, reach, last in rows))
            types = [*key_types, pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*group, "n", "reach", "last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key_types = [batch.column(g).type for g in group]
            x, blank, same, before_value = _ordered_batch(batch, group, value, before)
            own, none = x.copy(), np.zeros(len(x), bool)
            _lift(x, blank, same, before_value, none, own, step)
            starts = np.flatnonzero(~same)
            starts = np.concatenate(([0], starts)) if same[0] else starts
            lengths = np.diff(np.append(starts, len(x)))
            offset = np.zeros(len(starts), np.int64)
            offset[0] = held[1] if same[0] else 0
            place = np.arange(len(x)) - np.repeat(starts - offset, lengths)
            reach = np.maximum.reduceat(np.where(blank, least, own - step * place), starts)
            done = []
            for at, n, top in zip(starts.tolist(), lengths.tolist(), reach.tolist()):
                if same[at]:
                    held = (held[0], held[1] + n, max(held[2], top), int(x[at + n - 1]))
                else:
                    if held is not None:
                        done.append(held)
                    held = (_key(batch, group, at), n, top, int(x[at + n - 1]))
            before = (held[0], x[-1])
            if done:
                yield give(done)
        if held is not None:
            yield give([held])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, s = None, None
        for batch in batches:
            got = []
            for i, (n, reach, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "reach", "last")))):
                key = _key(batch, keys, i)
                s = s if key == here else None
                got.append(s)
                here, s = key, last if s is None or s <= reach else s + step * n
            yield pa.RecordBatch.from_arrays([*(batch.column(g) for g in group), pa.array(got, pa.int64())], [*group, "_carry"])

    each = apart.sortWithinPartitions(*group, order, F.col(value).asc_nulls_last()).mapInArrow(told, f"{kinds}, n bigint, reach bigint, last bigint")
    out = each.repartition(*keys).sortWithinPartitions(*group).mapInArrow(passed, f"{kinds}, _carry bigint")
    return out.where("_carry is not null").select(F.struct(*group).alias("_part"), F.col("_carry").cast(kind).alias("_carry"))


def _key(batch: pa.RecordBatch, names: list[str], at: int) -> tuple:
    return tuple(batch.column(n)[at].as_py() for n in names)


def _ordered_batch(batch: pa.RecordBatch, group: list[str], value: str, before: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Values (nulls as 0), which are null, which have the row before them in their group, and the value before the first."""
    column = batch.column(value)
    x = column.fill_null(0).to_numpy(zero_copy_only=False).copy()
    codes = [batch.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for g in group]
    inside = np.all([c[1:] == c[:-1] for c in codes], axis=0)
    same = np.concatenate(([before is not None and before[0] == _key(batch, group, 0)], inside))
    return x, column.is_null().to_numpy(zero_copy_only=False), same, 0 if before is None else before[1]


def _lift(x: np.ndarray, blank: np.ndarray, same: np.ndarray, before: int, entered: np.ndarray, carry: np.ndarray, step: int) -> np.ndarray:
    """Clamps x in place and tells which rows it moved; a group's first row follows its carry where it was entered with one."""
    last_of = np.where(same, np.concatenate(([before], x[:-1])), carry).astype(x.dtype)
    moved, done = np.zeros(len(x), bool), 0
    for at in np.flatnonzero((same | entered) & (blank | (x < last_of))).tolist():
        if at < done:
            continue
        last = (x[at - 1] if at else before) if same[at] else carry[at]
        first = at
        while at < len(x) and (at == first or same[at]) and (blank[at] or x[at] < last):
            last = last + step
            x[at], moved[at] = last, not blank[at]
            at += 1
        done = at
    return moved


def settled(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the folder of the session's checkpoints; a local session without one gets one."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def sum_before(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of `value` over all rows before each in `order`; a total order of the whole table that no task sorts whole.

    Rows are parted by ranges of order and checkpointed, so give only the columns it needs. Each part's total is carried
    on to the parts after it: one row a part.
    """
    parted = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = parted.groupBy("_part").agg(F.sum(value).alias("_sum"))
    carried = totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carried"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    # one row a part, so the bound of what is broadcast is their number
    return parted.withColumn(out, F.coalesce(inside, F.lit(0))).join(F.broadcast(carried), "_part").withColumn(out, F.col(out) + F.col("_carried")).drop("_part", "_carried")


def maxplus_clamp(value: Column, order: WindowSpec, step: Column | int = 1) -> Column:
    """y[i] = max(value[i], y[i-1] + step): as a running window."""
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count("*").over(run)
    return F.max(value - step * n).over(run) + step * n


def islands(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Runs of consecutive indices: (keys, first, last, length)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(index))
    marked = df.select(*keys, index, (F.col(index) - place).alias("_island"))
    return marked.groupBy(*keys, "_island").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("length")).drop("_island")


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, out: str, floor: float | int = 0.001) -> DataFrame:
    """Lower weighted median: the first value, in order, at which half of the weight is reached."""
    w = F.greatest(F.col(weight), F.lit(floor))
    run = Window.partitionBy(*keys).orderBy(value, weight).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumn("_run", F.sum(w).over(run)).withColumn("_all", F.sum(w).over(Window.partitionBy(*keys)))
    return summed.groupBy(*keys).agg(F.min(F.when(2 * F.col("_run") >= F.col("_all"), F.col(value))).alias(out))


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """For each left row the right row's `value` with the latest time not after it; of equal times the largest value.

    Union and a running window: one shuffle on `by`, no range join.
    """
    rows = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    rows = rows.unionByName(right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_value")), allowMissingColumns=True)
    last = F.last("_value", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_t", "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(value, last).where("_side = 1").select("_left.*", value)


def next_with(value: Column, present: Column, keys: list[str], order: str) -> Column:
    """`value` of the next row that has it, skipping those that don't."""
    return F.first(F.when(present, value), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing))
