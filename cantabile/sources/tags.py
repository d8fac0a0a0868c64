"""Title, artist and album from the tags in sound files: ID3v2.2 to 2.4 at the begin, ID3v1 at the end."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of frames by version, text codings by their number, what counts as blank.
FRAMES = {2: {b"TT2": "title", b"TP1": "artist", b"TAL": "album"}, 3: {b"TIT2": "title", b"TPE1": "artist", b"TALB": "album"}}
BLANK = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
FIELDS = ("title", "artist", "album")
#: Share of Cyrillic letters from which bytes of no stated coding are read as such.
CYRILLIC_SHARE = 0.3


def _western(b: int) -> str:
    try:
        return bytes([b]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(b)


def _cyrillic(b: int) -> str:
    """Letters as in cp1251; its signs, which titles hardly have, become drawing characters."""
    if b < 0x80:
        return chr(b)
    return bytes([b]).decode("cp1251") if b >= 0xC0 or b in (0xA8, 0xB8) else chr(0x2500 + b - 0x80)


WESTERN = [_western(b) for b in range(256)]
CYRILLIC = [_cyrillic(b) for b in range(256)]


def _seven_bit(four: bytes) -> int:
    """A whole number of four bytes of which the highest bits don't count."""
    return sum((b & 0x7F) << shift for b, shift in zip(four, (21, 14, 7, 0)))


def _text(coded: bytes) -> str:
    """The first part with letters of a text frame; its first byte names the coding."""
    coding, raw = coded[0], coded[1:]
    if coding == 1:
        text = raw[2:].decode("utf-16-le" if raw[:2] == b"\xff\xfe" else "utf-16-be", "replace").removeprefix("\ufeff")
    elif coding in (2, 3):
        text = raw.decode("utf-16-be" if coding == 2 else "utf-8", "replace").removeprefix("\ufeff")
    else:
        text = "".join(map(CYRILLIC.__getitem__, raw))
        letters = sum("\u0400" <= c <= "\u04ff" for c in text)
        if not letters or letters < CYRILLIC_SHARE * len(text):
            text = "".join(map(WESTERN.__getitem__, raw))
    return next(filter(None, (part.strip(BLANK) for part in text.split("\0"))), "")


def _frames(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(name, content) of the frames of a leading tag, up to the first that is broken."""
    if len(data) < 10 or data[:3] != b"ID3":
        return
    version, end = data[3], min(len(data), 10 + _seven_bit(data[6:10]))
    at, wide = 10, version != 2
    if data[5] & 0x40 and len(data) >= 14:
        at += 4 + (struct.unpack(">i", data[10:14])[0] if version == 3 else _seven_bit(data[10:14]))
    head = 10 if wide else 6
    while 0 <= at and at + head <= end:
        name = data[at : at + (4 if wide else 3)]
        if not (name.isalnum() and name == name.upper()):
            return
        if not wide:
            size = int.from_bytes(data[at + 3 : at + 6], "big")
        else:
            size = _seven_bit(data[at + 4 : at + 8]) if version == 4 else struct.unpack(">i", data[at + 4 : at + 8])[0]
        if size <= 0 or at + head + size > end:
            return
        yield name, data[at + head : at + head + size]
        at += head + size


def read_tags(data: bytes | None, last: bytes | None = None) -> dict[str, str]:
    """title, artist and album of one file, empty where it has none; the trailing tag gives only what the leading one lacks.

    data: the file, or as much of it as holds the leading tag, with the file's last 128 bytes beside it.
    """
    data = data or b""
    last = data[-128:] if last is None else last
    known = FRAMES[2] if data[3:4] == b"\x02" else FRAMES[3]
    found = dict.fromkeys(FIELDS, "")
    for name, content in _frames(data):
        field = known.get(name)
        if field and not found[field]:
            found[field] = _text(content)
    if len(last) == 128 and last[:3] == b"TAG":
        for i, field in enumerate(FIELDS):
            found[field] = found[field] or last[3 + 30 * i : 33 + 30 * i].decode("latin-1").replace("\0", "").strip(BLANK)
    return found


def with_tags(files: DataFrame, content: str = "content") -> DataFrame:
    """files with title, artist and album in place of their content; null content has empty ones. Columns of files by these names are replaced.

    Only the leading tag, of the length that its header states, and the last 128 bytes go to Python; the sound stays.
    """
    whole = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    byte = lambda n: F.coalesce(F.conv(F.hex(F.substring(whole, n, 1)), 16, 10).cast("int"), F.lit(0))
    length = sum((F.shiftleft(byte(n).bitwiseAND(0x7F), shift) for n, shift in zip((7, 8, 9, 10), (21, 14, 7, 0))), F.lit(10))
    kept = [c for c in files.columns if c not in (*FIELDS, content)]
    cut = files.select(*kept, whole.alias("_whole"), length.alias("_length"))
    head = F.when(F.substring("_whole", 1, 3) == F.lit(b"ID3"), F.expr("substring(_whole, 1, _length)")).otherwise(F.lit(b""))
    rows = cut.select(*kept, head.alias("_head"), F.substring("_whole", -128, 128).alias("_last"))
    kinds = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), *(f"{f} string" for f in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = [read_tags(h.as_py(), t.as_py()) for h, t in zip(batch.column("_head"), batch.column("_last"))]
            columns = [batch.column(c) for c in kept] + [pa.array([t[f] for t in tags], pa.string()) for f in FIELDS]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *FIELDS])

    return rows.mapInArrow(run, kinds)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, artist, album) of all files in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return with_tags(files.select("path", "content"))
