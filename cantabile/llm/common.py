"""What the text operators share: tables, shared folders, checkpoints and size-checked joins."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has been counted and has no more rows than this.
#: The sides passed to checked_join have a few fixed-width columns, so this is some tens of MB.
BROADCAST_ROWS = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, _UPPER, _UPPER.lower())


#: What one Arrow batch holds at most; the same for all operators, so that none depends on which ran before it.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "2m")}


def bounded_batches(spark: SparkSession) -> None:
    """Bounds how many rows and bytes of whole texts a Python worker gets at once, where the session still has Spark's defaults."""
    for key, (default, bound) in BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, bound)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what is already set. Only a local session gets one of its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        held = context._jsc.sc().getCheckpointDir()
    return named or held.get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df once into the shared folder, so later stages neither recompute it nor depend on an executor."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle and checkpoint files that nothing refers to any more.

    Its cleaner acts when the driver collects garbage, which between many small rounds may be long in coming.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Shelf:
    """Tables written once into the shared folder, and deleted when nothing reads them any more.

    A checkpoint goes only when the driver collects garbage; these go at once, and small ones are read in few tasks.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, "step")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def mark(self) -> int:
        return len(self.held)

    def drop(self, *frames: DataFrame) -> None:
        for frame, path in self.held:
            if any(frame is f for f in frames):
                remove(self.spark, path)
        self.held = [x for x in self.held if not any(x[0] is f for f in frames)]

    def drop_since(self, mark: int, *kept: DataFrame) -> None:
        """Drops what was put since a mark, save what is kept."""
        self.drop(*(f for f, _ in self.held[mark:] if not any(f is k for k in kept)))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows; counting stops at one more than that."""
    return df.limit(rows + 1).count() <= rows


def checked_join(left: DataFrame, right: DataFrame, on, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a narrow `right`: broadcast when a count proves it small, a shuffled join otherwise.

    `right` is counted here, so pass something cheap to read, such as a checkpoint.
    """
    return left.join(F.broadcast(right) if is_small(right, rows) else right, on, how)


def row_key(text: Column, doc: Column) -> list[Column]:
    """Tells rows apart by content, so it is the same whenever and wherever it is computed."""
    return [F.xxhash64(doc, text).alias("_row1"), F.xxhash64(text, F.lit(1), doc).alias("_row2")]
