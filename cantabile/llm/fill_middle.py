"""Fill-in-the-middle: documents cut at unit boundaries and put in the order prefix, suffix, middle or suffix, prefix, middle.

A table-driven automaton over bytes knows continuation bytes of UTF-8, starts of units (lines) and sentinels. It goes over a batch once, in lanes
of LANE bytes side by side: every state is fixed by the three bytes before it, so a lane starts three bytes early. Each
transition emits marks (code point begins, unit begins, sentinel complete), which are counted by lane. The second pass looks in these
counts for the lane that holds a cut and only there for its byte. So a long text needs memory for its bytes and as many marks.

The choice of cuts and form is drawn from sha256 of "seed:key", so it depends on the row alone.

Defined results: a null text counts as empty; an empty text, or one that holds a sentinel, stays as it is (form plain); a null key draws
like an empty one; equal rows get equal results; extra columns pass through, whatever their names; a byte that continues
nothing begins no code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantabile.llm.common import bounded_batches, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
POINT, UNIT, SENTINEL = 1, 2, 4
#: Bytes of a lane; bytes that fix a state; the byte between texts, which UTF-8 doesn't have.
LANE, REACH, BETWEEN = 512, 3, 0xFF
#: States: at the start of a unit, inside one, after "<", after "<" and a sentinel's letter, and with 1, 2 or 3 continuation bytes to come.
START, INSIDE, OPEN, NAMED, MORE = 0, 1, 2, 3, 4


class Rule(NamedTuple):
    """seed of the draw; percent of texts that are transformed, and of these percent with the suffix first."""

    seed: int = 7
    percent: int = 100
    suffix_first: int = 50


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next, marks) by state * 256 + byte; next is a multiple of 256."""
    follow, marks = np.zeros((MORE + 3, 256), np.int64), np.zeros((MORE + 3, 256), np.uint8)
    letters = {s[1] for s in (PREFIX, SUFFIX, MIDDLE)}
    for state in range(MORE + 3):
        for byte in range(256):
            goes, told = INSIDE, POINT
            if byte == BETWEEN:
                goes, told = START, 0
            elif 0x80 <= byte < 0xC0:
                goes, told = (state - 1 if state > MORE else INSIDE), 0
            elif byte >= 0xC0:
                goes = MORE + (byte >= 0xE0) + (byte >= 0xF0)
            elif byte == ord("\n"):
                goes = START
            elif byte == ord("<"):
                goes = OPEN
            elif state == OPEN and byte in letters:
                goes = NAMED
            elif state == NAMED and byte == ord(">"):
                told |= SENTINEL
            if state == START and byte != BETWEEN:
                told |= UNIT
            follow[state, byte], marks[state, byte] = goes * 256, told
    return follow.ravel(), marks.ravel()


class Scan:
    """The marks of texts that lie in one buffer, and their counts before each lane."""

    def __init__(self, data: np.ndarray) -> None:
        follow, marks = automaton()
        n = max(1, -(-len(data) // LANE))
        lanes = np.full((n, LANE), BETWEEN, np.uint8)
        lanes.ravel()[: len(data)] = data
        early = np.full((n, REACH), BETWEEN, np.uint8)
        early[1:] = lanes[:-1, -REACH:]
        state = np.full(n, INSIDE * 256)
        for byte in early.T:
            state = follow[state + byte]
        state[0] = START * 256
        out = np.empty((LANE, n), np.uint8)
        for i, byte in enumerate(np.ascontiguousarray(lanes.T)):
            at = state + byte
            np.take(marks, at, out=out[i])
            state = follow[at]
        self.marks = np.ascontiguousarray(out.T)
        self.counts = {mark: np.concatenate(([0], np.cumsum((self.marks & mark != 0).sum(axis=1)))) for mark in (POINT, UNIT, SENTINEL)}

    def before(self, at: np.ndarray, mark: int) -> np.ndarray:
        """How often the mark was emitted before each byte of `at`."""
        lane, rest = np.divmod(at, LANE)
        own = np.minimum(lane, len(self.marks) - 1)
        inside = (np.arange(LANE) < np.where(lane > own, LANE, rest)[:, None]) & (self.marks[own] & mark != 0)
        return self.counts[mark][own] + inside.sum(axis=1)

    def find(self, rank: np.ndarray, mark: int) -> np.ndarray:
        """The byte at which the mark was emitted the rank-th time, counted from 0."""
        lane = np.searchsorted(self.counts[mark], rank, side="right") - 1
        reached = np.cumsum(self.marks[lane] & mark != 0, axis=1) == (rank - self.counts[mark][lane] + 1)[:, None]
        return lane * LANE + reached.argmax(axis=1)


def cut(texts: list[bytes], draws: np.ndarray, rule: Rule) -> Iterator[dict]:
    """n, form, lengths in code points and output of each text; draws: four numbers for each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    scan = Scan(np.frombuffer(bytes([BETWEEN]).join(texts) + bytes([BETWEEN]), np.uint8))
    units = scan.before(starts, UNIT)
    n = scan.before(ends, UNIT) - units
    plain = (sizes == 0) | (scan.before(ends, SENTINEL) > scan.before(starts, SENTINEL)) | (draws[:, 2] % 100 >= rule.percent)
    spm = draws[:, 3] % 100 < rule.suffix_first
    chosen = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    points, places = scan.before(starts, POINT), []
    for k in chosen.T:
        inner = np.flatnonzero(~plain & (k < n))
        at = ends.copy()
        at[inner] = scan.find(units[inner] + k[inner], UNIT)
        places.append((at - starts, scan.before(at, POINT) - points))
    (a, a_points), (b, b_points) = places
    for i, text in enumerate(texts):
        if plain[i]:
            yield {"n": int(n[i]), "form": "plain", "output": text}
            continue
        prefix, middle, suffix = text[: a[i]], text[a[i] : b[i]], text[b[i] :]
        made = (SUFFIX + suffix + PREFIX + prefix if spm[i] else PREFIX + prefix + SUFFIX + suffix) + MIDDLE + middle
        yield {"n": int(n[i]), "form": "spm" if spm[i] else "psm", "prefix_chars": int(a_points[i]), "middle_chars": int(b_points[i] - a_points[i]), "output": made}


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made of. No part holds a sentinel, and none arises where a part and a sentinel meet."""
    if form == "plain":
        return output
    rest, _, middle = output.partition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = rest[len(PREFIX) :].partition(SUFFIX)
    else:
        suffix, _, prefix = rest[len(SUFFIX) :].partition(PREFIX)
    return prefix + middle + suffix


def draw(key: Column, rule: Rule) -> list[Column]:
    """Four numbers of 32 bits that depend on the key alone."""
    text = F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(text, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


KIND = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:binary,restored_sha256:string>"


def fill_in_middle(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", out_col: str = "fim", rule: Rule = Rule()) -> DataFrame:
    """docs with a struct: n, form, prefix_chars, middle_chars, output (UTF-8), and the hash of the text rebuilt from output and form."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(KIND)
    def made(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, *drawn in batches:
            rows = list(cut(text.to_pylist(), np.column_stack([d.to_numpy(zero_copy_only=False) for d in drawn]), rule)) if len(text) else []
            for r in rows:
                r["restored_sha256"] = hashlib.sha256(restore(r["output"], r["form"])).hexdigest()
            names = ["n", "form", "prefix_chars", "middle_chars", "output", "restored_sha256"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.StructArray.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in zip(names, kinds)], names)

    return docs.withColumn(out_col, made(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), *draw(F.col(f"`{key_col}`"), rule)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fim = F.col("fim")
    return out.select("doc_id", *(fim[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")), F.sha2(fim["output"], 256).alias("output_sha256"), fim["restored_sha256"].alias("restored_sha256"))
