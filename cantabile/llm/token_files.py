"""Token ids as binary files: fixed-width bit packing in blocks of whole documents.

Ids come from the tokenizers library, without special tokens, with an end id after each document.
The format is a folder of Parquet files, so that any store Spark can write to holds it; each row is a
block:

    part, block     place of the block; blocks ascend in id order, documents ascend inside
    bits            width of an id: the least that holds the vocabulary
    first           ids before the block in its part
    n_ids           ids in the block
    starts          for each document, ids of the block before it
    ids             doc ids of the block's documents
    payload         n_ids ids of `bits` bits each, least significant bit first

A block holds whole documents: as many as reach BLOCK ids, or a single longer one. Any id is found
from the offsets and read without unpacking what lies before it: id i of a block starts at bit
i * bits. Ids before a part are the sum of the parts before, which `starts_of` adds up from one
number per part.

Text that repeats between spaces is tokenised once per worker: cutting before a space that follows
something other than white space never cuts a match of the tokenizer's pattern.

Defined results: a null text counts as empty, so its document is the end id alone; null doc ids
come first; rows with equal ids stay next to each other; an empty table gives no blocks and an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantabile.llm.bpe import spans
from cantabile.llm.common import shared_path, bounded_batches, table

VOCABULARY = "byte_bpe_50k.json"
END = 0
BLOCK = 1 << 16
#: Texts between spaces that a worker remembers.
MEMORY = 1_200_000
_ODD = re.compile(r"\s ")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Memory(dict):
    """What a worker has tokenised: a number for each text between spaces, and its ids in one long array."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = tokenizer(path)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self)
        self.new.append(part)
        return number

    def learn(self) -> None:
        for i in range(0, len(self.new), 20_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(self.new[i : i + 20_000], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))))
        self.new.clear()

    def tokenize(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, the same as the tokenizer's for the whole text."""
        if len(self) > MEMORY or len(self.ids) > 8 * MEMORY:
            self.forget()
        parts: list[str] = []
        counts = []
        for text in texts:
            before = len(parts)
            if _ODD.search(text):
                # here a space may belong to the white space before it
                parts.extend(spans(text))
            else:
                first, *rest = text.split(" ")
                parts.append(first)
                parts.extend([" " + x for x in rest])
            counts.append(len(parts) - before)
        number = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        self.learn()
        sizes = self.sizes[number]
        stops = np.cumsum(sizes)
        ids = self.ids[np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.starts[number] - stops + sizes, sizes)]
        ends = np.cumsum(counts)[:-1]
        return np.split(ids, np.concatenate(([0], stops))[ends])


_memories: dict[str, Memory] = {}


def tokenize(texts: list[str], path: str) -> list[np.ndarray]:
    if path not in _memories:
        _memories[path] = Memory(path)
    return _memories[path].tokenize(texts)


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (below 2**bits) at bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flags.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop - 1 of a block, without touching the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}")[start:stop].astype(np.uint32)
    at = np.arange(start, stop, dtype=np.int64) * bits
    first = int(at[0]) >> 3 if len(at) else 0
    some = np.frombuffer(payload, np.uint8)[first : (stop * bits + 7) // 8]
    some = np.concatenate((some, np.zeros(8, np.uint8))).astype(np.uint64)
    byte = (at >> 3) - first
    word = sum((some[byte + i] << np.uint64(8 * i) for i in range(5)), np.zeros(len(at), np.uint64))
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_tokens(docs: DataFrame, target: str, path: str | None = None, end: int = END, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of docs into the folder `target`, in ascending id order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()
    bits = width(tokenizer(path).get_vocab_size())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list = []
        size = 0

        def row() -> pa.RecordBatch:
            starts = np.cumsum([0, *(len(h) for h in held[:-1])])
            cols = {"part": [part], "block": [number], "bits": [bits], "first": [first], "n_ids": [size], "starts": [starts.tolist()], "ids": [names], "payload": [pack(np.concatenate(held), bits)]}
            return pa.RecordBatch.from_pydict({k: pa.array(v, schema.field(k).type) for k, v in cols.items()})

        for batch in batches:
            schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("bits", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("starts", pa.list_(pa.int64())), ("ids", pa.list_(batch.column("doc_id").type)), ("payload", pa.binary())])
            for name, ids in zip(batch.column("doc_id").to_pylist(), tokenize(batch.column("text").to_pylist(), path), strict=True):
                held.append(np.append(ids, np.uint32(end)))
                names.append(name)
                size += len(ids) + 1
                if size >= block:
                    yield row()
                    number, first = number + 1, first + size
                    held, names, size = [], [], 0
        if held:
            yield row()

    # the second key spreads rows that share an id
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    out = keyed.select("doc_id", "text").mapInArrow(blocks, f"part long, block long, bits int, first long, n_ids long, starts array<long>, ids array<{kind}>, payload binary")
    out.write.parquet(target)


def starts_of(files: DataFrame) -> DataFrame:
    """A row (part, before) for each part: ids in the parts before it."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # a row for each part
    return totals.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def read_tokens(spark: SparkSession, source: str) -> DataFrame:
    """A row (doc_id, start, n_tokens, ids) for each document; ids: little-endian unsigned 32-bit integers."""
    files = spark.read.parquet(source)
    kind = files.schema["ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_type = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                b = {k: batch.column(k)[i].as_py() for k in ("bits", "n_ids", "starts", "ids", "payload", "offset")}
                stops = [*b["starts"][1:], b["n_ids"]]
                payloads = [unpack(b["payload"], b["bits"], s, e).astype("<u4").tobytes() for s, e in zip(b["starts"], stops, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["ids"], ids_type), pa.array(np.asarray(b["starts"], np.int64) + b["offset"]), pa.array(np.asarray(stops, np.int64) - np.asarray(b["starts"], np.int64)), pa.array(payloads, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    bounded_batches(spark)
    placed = files.join(F.broadcast(starts_of(files.select("part", "n_ids"))), "part").select("bits", "n_ids", "starts", "ids", "payload", (F.col("before") + F.col("first")).alias("offset"))
    return placed.mapInArrow(documents, f"doc_id {kind}, start long, n_tokens long, ids binary")


def random_ids(files: DataFrame, start: int, stop: int) -> np.ndarray:
    """Ids start to stop - 1 of the whole corpus: only the blocks that hold them are read."""
    where = starts_of(files.select("part", "n_ids"))
    hit = files.join(F.broadcast(where), "part").withColumn("offset", F.col("before") + F.col("first")).where((F.col("offset") < stop) & (F.col("offset") + F.col("n_ids") > start))
    rows = hit.select("offset", "bits", "n_ids", "payload").orderBy("offset").collect()  # as long as the caller asks for
    parts = [unpack(bytes(r.payload), r.bits, max(0, start - r.offset), min(r.n_ids, stop - r.offset)) for r in rows]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), target)
    return read_tokens(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
