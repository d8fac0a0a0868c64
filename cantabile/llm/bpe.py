"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Ids travel as binary: little-endian unsigned 32-bit integers, so that hashing, measuring and
storing them stay built-in Spark functions. `ids_array` in this module turns them into an array.

Defined results: a null text encodes like an empty one, to zero ids; zero ids decode to zero
bytes; null ids decode to null. Rows are independent, so repeated rows, ties, null keys and extra
columns (whatever their names) pass through unchanged.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantabile.llm.common import bounded_batches, table

RANKS = "byte_bpe_50k.tiktoken"
#: Longer texts are encoded piece by piece, so the library never holds the merges of a whole book.
SPAN = 1 << 16
#: White space after something that isn't: no match of the pre-splitting pattern reaches over it.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])")


def spans(text: str, span: int = SPAN) -> Iterator[str]:
    """Cuts a long text at safe boundaries, `span` characters apart or as soon after as there is one.

    Python's white space is a superset of the pattern's, so a character that isn't white space here
    isn't there either, and every alternative of the pattern ends before white space unless it began in it.
    """
    start = 0
    while len(text) - start > span:
        cut = _SAFE.search(text, start + span)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; loaded once in each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(enc: tiktoken.Encoding, text: str | None, span: int = SPAN) -> bytes:
    return b"".join(np.asarray(enc.encode_ordinary(part), dtype="<u4").tobytes() for part in spans(text or "", span))


def encode(text: Column, path: str, pattern: str, span: int = SPAN) -> Column:
    """Ids of a text column, as binary."""

    @F.arrow_udf("binary")
    def _encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(path, pattern)
        for batch in batches:
            yield pa.array((encode_text(enc, t.as_py(), span) for t in batch), pa.binary(), size=len(batch))

    return _encode(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The raw bytes that ids stand for; they need not be valid UTF-8."""

    @F.arrow_udf("binary")
    def _decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(path, pattern)
        for batch in batches:
            yield pa.array((b if b is None else enc.decode_bytes(np.frombuffer(b, "<u4").tolist()) for b in batch.to_pylist()), pa.binary(), size=len(batch))

    return _decode(ids)


def ids_array(ids: Column) -> Column:
    """Binary ids as array<long>."""

    @F.arrow_udf("array<long>")
    def _array(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([b if b is None else np.frombuffer(b, "<u4").astype("i8") for b in batch.to_pylist()], pa.list_(pa.int64()))

    return _array(ids)


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def with_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None, ids_col: str = "ids", bytes_col: str | None = None) -> DataFrame:
    """docs with a column of ids and, if named, a column of the bytes they decode to."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    bounded_batches(docs.sparkSession)
    out = docs.withColumn(ids_col, encode(F.col(text_col), path, pattern))
    return out.withColumn(bytes_col, decode(F.col(ids_col), path, pattern)) if bytes_col else out


def digests(docs: DataFrame) -> DataFrame:
    out = with_tokens(docs.select("doc_id", "text"), ids_col="_ids", bytes_col="_bytes")
    return out.select("doc_id", n_ids(F.col("_ids")).alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_bytes", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
