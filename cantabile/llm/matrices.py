"""Sums of one matrix per task, in two shuffled steps; the driver gets the sum alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of the matrix to a row of the shuffle, and groups that a chunk's parts are first summed in.
CHUNK, SALTS = 64, 256

_SCHEMA = "chunk long, salt long, sums binary"


def summed(df: DataFrame, n: int, width: int, part: Callable[[Iterator[pa.RecordBatch], np.ndarray], None]) -> np.ndarray:
    """part(batches, out) adds a task's share to out, n x width numbers; the result is the sum over all tasks."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = np.zeros((n, width), np.float32)
        part(batches, out)
        chunks = [(i, out[i * CHUNK : (i + 1) * CHUNK]) for i in range(-(-n // CHUNK))]
        chunks = [(i, c.tobytes()) for i, c in chunks if c.any()]
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([i for i, _ in chunks], pa.int64()), "salt": pa.array([salt] * len(chunks), pa.int64()), "sums": pa.array([c for _, c in chunks], pa.binary())})

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py(), np.float32).astype(np.float64) for s in parts["sums"])
        return parts.slice(0, 1).set_column(2, "sums", pa.array([total.astype(np.float32).tobytes()]))

    sums = df.mapInArrow(of_task, _SCHEMA).groupBy("chunk", "salt").applyInArrow(add, _SCHEMA).groupBy("chunk").applyInArrow(add, _SCHEMA)
    out = np.zeros((n, width))
    for r in sums.select("chunk", "sums").toLocalIterator():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.sums, np.float32).reshape(-1, width)
    return out
