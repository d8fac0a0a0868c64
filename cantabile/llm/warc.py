"""WARC archives: written one gzip member per record, read back as a stream.

A record is framed by its content length and packed as a gzip member of its own, so an archive can
be read from any record on. The reader takes an archive in chunks of CHUNK bytes, inflates member after
member with incremental zlib decompression, frames blocks by Content-Length, and checks each payload
against its digest; it holds one record at a time. Archives are files in a store that pyarrow can open (a
local or shared folder, HDFS, an object store). A task writes to a name of its own and
renames at the end, so a repeated or lost task leaves no half archive under a final name.

Pages with equal payloads of at least MIN_REVISIT bytes: the one with the smallest id becomes a response record,
the others become revisit records that name it and carry its digest and length but no payload.
Smaller payloads are all responses.

Defined results: a null payload counts as empty; a null id is written as an empty id, is read
back as null and is larger than any other here; rows with equal ids and payloads: exactly one is the response; an
empty table gives no archive and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantabile.llm.common import bounded_batches, checked_join, checkpoint, shared_path, table

MIN_REVISIT = 100
#: Parts that equal rows are counted in.
SALTS = 64
CHUNK = 1 << 18
#: Fixed, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    """An archive that is cut short, badly framed or does not match its digests."""


def record(kind: str, name: str, uri: str, payload: bytes, digest: str, length: int, refers_to: str | None) -> bytes:
    """One gzip member. length and digest are the full payload's, whether it is carried or not."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of an archive, one at a time."""
    unpacker, parts = None, []
    for chunk in chunks:
        while chunk:
            unpacker = unpacker or zlib.decompressobj(31)
            try:
                parts.append(unpacker.decompress(chunk))
            except zlib.error as e:
                raise BadRecord(str(e)) from e
            chunk = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = None, []
            else:
                break
    if unpacker is not None:
        raise BadRecord("the archive ends inside a record")


def headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


def parse(member: bytes) -> dict:
    """A record's headers, HTTP headers and payload, once framing and digests hold."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/1."):
        raise BadRecord("no WARC header")
    h = headers(head)
    try:
        length = int(h["content-length"])
    except (KeyError, ValueError) as e:
        raise BadRecord("no content length") from e
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise BadRecord("the block does not have its content length")
    if h.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise BadRecord("the block does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    web = headers(http)
    if h.get("warc-type") == "response" and (hashlib.sha256(payload).hexdigest() != digest or int(web.get("content-length", -1)) != len(payload)):
        raise BadRecord("the payload does not match its digest or length")
    return {"headers": h, "http": web, "payload": payload, "digest": digest}


def store(uri: str):
    """The file system and path of a URI or path, on the driver or in a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def plan(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url") -> DataFrame:
    """Rows (page_id, uri, payload, length, digest, kind, refers_to), one for each page; length is the full payload's, which a revisit needs not carry."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), (F.col(uri_col) if uri_col else F.lit("")).alias("uri"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    order = F.struct(F.col("page_id").isNull().alias("_none"), F.col("page_id"), F.xxhash64("uri").alias("_tie"))
    large = F.octet_length("payload") >= MIN_REVISIT
    # groups meet as partial counts and minima only
    groups = rows.where(large).groupBy("digest").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("digest", "_first")
    joined = checked_join(rows.withColumn("_order", order), checkpoint(groups), "digest", "left").withColumn("length", F.octet_length("payload").cast("long"))
    is_first = F.col("_order") == F.col("_first")
    columns = ["page_id", "uri", "payload", "length", "digest", "kind", "refers_to"]
    other = joined.where(F.coalesce(~is_first, F.lit(True)))
    again = F.col("_first").isNotNull()
    other = other.withColumns({"kind": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_first.page_id"))})
    # rows that are the first of their group; where several are equal in all that counts, they are counted by SALTS and one of them is the response
    firsts = joined.where(is_first).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    firsts = firsts.groupBy("page_id", "uri", "digest", "length", "_salt").agg(F.first("payload").alias("payload"), F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("digest").orderBy("_salt"))
    each = firsts.withColumn("_place", place).withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    response = (F.col("_place") == 1) & (F.col("_nth") == 1)
    first = each.withColumns({"kind": F.when(response, "response").otherwise("revisit"), "refers_to": F.when(~response, F.col("page_id")), "payload": F.when(response, F.col("payload"))})
    return other.select(columns).unionByName(first.select(columns))


def write_warc(records: DataFrame, target: str) -> DataFrame:
    """Writes one archive per partition of `records` (as `plan` makes them) into a folder; returns (path, n_records, n_bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, n, size = None, 0, 0
        context = TaskContext.get()
        files, folder = store(target)
        final = f"{folder}/part-{context.partitionId():05d}.warc.gz"
        own = f"{final}.{context.taskAttemptId()}.tmp"
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    files.create_dir(folder, recursive=True)
                    out = files.open_output_stream(own, compression=None)
                name = lambda x: "" if x is None else str(x)
                carried = r["payload"] if r["kind"] == "response" else b""
                member = record(r["kind"], name(r["page_id"]), (r["uri"] or "").replace("\r", " ").replace("\n", " "), carried, r["digest"], r["length"], None if r["kind"] == "response" else name(r["refers_to"]))
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            files.move(own, final)
            yield pa.RecordBatch.from_pydict({"path": [final], "n_records": [n], "n_bytes": [size]})

    return checkpoint(records.mapInArrow(write, "path string, n_records long, n_bytes long"))


def read_warc(archives: DataFrame, root: str, id_type: str = "long") -> DataFrame:
    """The records of archives (a column `path`, in the store of `root`) in their order: page_id, uri, record_type, refers_to, payload_bytes, payload_digest, payload.

    payload_bytes and payload_digest of a revisit are those of the payload it refers to.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = store(root)
        names = ["page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        cut = lambda urn: urn.removeprefix("<urn:page:").removesuffix(">") or None
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input_stream(path, compression=None) as f:
                    rows: list[tuple] = []
                    size = 0
                    for member in members(iter(lambda f=f: f.read(CHUNK), b"")):
                        r = parse(member)
                        h = r["headers"]
                        rows.append((cut(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], cut(h.get("warc-refers-to", "")), int(r["http"]["content-length"]), r["digest"], r["payload"]))
                        size += len(r["payload"])
                        if len(rows) == 1000 or size > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    out = archives.select("path").mapInArrow(read, "page_id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, target: str) -> DataFrame:
    """Writes pages as archives and reads these back."""
    spark = pages.sparkSession
    bounded_batches(spark)
    made = write_warc(plan(pages), target)
    n = made.count()  # a row for each archive
    return read_warc(made.repartition(max(1, n)), target, pages.schema["page_id"].dataType.simpleString())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
