"""Benchmark passages in documents, exact or paraphrased, by latent semantic retrieval.

1. Texts are lower-cased words (letters and digits). Documents are read in windows of two
   blocks, each block STRIDE words; benchmark items are cut into passages of the same length.
2. The frequencies, to a block, of the benchmark's words in all documents are counted; they give TF-IDF weights and tell which words are too common to say anything. Each item keeps
   the RARE rarest of its words that documents have, whatever their frequency.
3. A randomised SVD of the matrix of all windows (rows) by these words, in one pass: every task adds up its
   part of Y = A'(A X) for a random X, the parts are summed in two shuffled steps, and only words x width numbers reach the
   driver, which takes the singular vectors from Y and X'Y.
4. Windows and passages are projected on the singular vectors; a window and an item are a candidate where the cosine with
   one of its passages is COSINE or more.
5. Of candidates those go that can't meet the rule: fewer words around the window belong to the item than the rule asks
   for. For the others the longest common subsequence of the item's words and those around the
   window is taken. The document holds the item if that covers LCS of the item, or LCS_ANSWER of it and the item's answer (its
   last words) is there in order too.

Steps 2 to 4 leave windows out: an item of few or of frequent words has no direction of its own. So beside these candidates come, for all items,
the places that a bound leaves open which follows from the rule: of n words at least
need = LCS_ANSWER n are in the subsequence, so of any n - need + t words of the item at least t are
around the window. These are the item's rarest, t a share HITS of its length. The result is the rule's on all windows and items.
With bound=False only items of fewer than SHORT words are looked for by it, and the latent search is on its own for the others: what it then reaches
is a measured share, given in the README.

The benchmark is the stated query set, worked through in blocks of at most ITEMS rows and WORDS different words, so what is sent to the tasks is
bounded. For each block the texts are read once and written as numbers of its words (0 for any other); the three passes read these. Documents
are never shuffled.

Defined results: null or empty texts, and items without words, match nothing; rows with equal ids
give one row per item together; null ids are kept as null; empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantabile.llm.common import Shelf, bounded_batches, checked_join, checkpoint, row_key, table
from cantabile.llm.matrices import summed
from cantabile.llm.shingles import PLAIN, word_hashes

STRIDE = 16
RANK, EXTRA = 128, 32
COSINE = 0.35
#: Words in a larger share of the blocks are left out, unless they are among an item's RARE rarest.
MAX_DF, RARE = 0.01, 12
LCS, LCS_ANSWER = 0.6, 0.55
#: Items of fewer words are looked for by their probes, even without the bound.
SHORT = STRIDE
#: Share of an item's words that must be found among its rarest; any gives the same result.
HITS = 0.15
#: The answer of an item: its last words, this share of it and so many at least.
ANSWER, ANSWER_WORDS = 0.15, 3
#: Different words of the items that are looked for together: so many rows have the matrices that tasks hold.
WORDS = 40_000
#: Rows of the benchmark that are looked for together.
ITEMS = 100_000
#: Items times words that are looked for together, a bit each.
CELLS = 1 << 29
#: Windows multiplied at a time, and cosines.
CHUNK, COSINES = 16384, 1 << 22


def number(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each word its place in the sorted `known`, from 1, or 0."""
    out = np.zeros(len(words), np.int32)
    if len(known):
        seen = np.zeros(1 << 16, bool)
        seen[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(seen[(words & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, words[maybe]), len(known) - 1)
        out[maybe] = np.where(known[at] == words[maybe], at + 1, 0)
    return out


def find(known: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the numbered words that are among the sorted `known`, and their places there."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.full(int(known[-1]) + 2, -1, np.int32)
    place[known] = np.arange(len(known))
    at = place[np.minimum(words, known[-1] + 1)]
    ok = np.flatnonzero(at >= 0)
    return ok, at[ok].astype(np.int64)


def spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers start[i], start[i] + 1, ..., n[i] of them: (i, number)."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[i]


@dataclass
class Probes:
    """The words that an item is looked for by. Entry e is a word of item[e], there times[e] times; those of words[w] begin at first[w]."""

    words: np.ndarray
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray
    #: For each item, how many of its words must be near and how many blocks before a window belong to it.
    least: np.ndarray
    reach: np.ndarray

    def places(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, item, windows): all that can meet the rule. A window is named by its first block, counted in the document."""
        block, first = blocks_of(docs)
        pos, word = find(self.words, np.concatenate(docs) if docs else np.zeros(0, np.int32))
        w = max(1, len(self.words))
        here, word = np.divmod(np.unique(block[pos] * w + word), w)
        doc = np.searchsorted(first, here, "right") - 1
        cell, entry = spread(self.first[word], self.first[word + 1] - self.first[word])
        gap = 4 * int(self.reach.max(initial=0)) + 4  # blocks left free between documents
        total = int(first[-1]) + gap * (len(docs) + 1)
        key = self.item[entry] * total + here[cell] + gap * (doc[cell] + 1)
        order = np.argsort(key)
        key, entry, cell = key[order], entry[order], cell[order]
        sums = np.concatenate(([0], np.cumsum(self.times[entry])))
        reach = self.reach[self.item[entry]]
        end = np.searchsorted(key, key + 2 * reach + 2)  # around a window are so many blocks; this cell is the first with a word
        ok = np.flatnonzero(sums[end] - sums[:-1] >= self.least[self.item[entry]])
        d, item = doc[cell[ok]], self.item[entry[ok]]
        i, near = spread(here[cell[ok]] - first[d] - reach[ok] - 1, 2 * reach[ok] + 2)
        d, item = d[i], item[i]
        inside = (near >= 0) & (near < first[d + 1] - first[d])
        found = np.unique(np.stack((d[inside], item[inside], near[inside])), axis=1)
        breaks = np.flatnonzero((np.diff(found[:2]) != 0).any(0) | (np.diff(found[2]) != 1)) + 1
        for run in np.split(found, breaks, axis=1) if found.size else ():
            yield int(run[0, 0]), int(run[1, 0]), run[2]


@dataclass
class Benchmark:
    """A block of items as numbers of words; words: those that count, with their weights; hashes: of all words, in the order of their numbers, from 1."""

    ids: list
    items: list[np.ndarray]
    words: np.ndarray
    hashes: np.ndarray
    idf: np.ndarray | None = None
    probes: Probes | None = None

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that count, and their numbers."""
        return find(self.words, words)


def probes(items: list[np.ndarray], df: np.ndarray, bound: bool) -> Probes | None:
    """df: in how many blocks each word is, by its number. Of the items all, or only those that are shorter than SHORT."""
    chosen, least, reach = [], [], []
    for nth, item in enumerate(items):
        if not bound and len(item) >= SHORT:
            least.append(0)
            reach.append(0)
            continue
        miss = len(item) - max(1, math.ceil(LCS_ANSWER * len(item) - 1e-9))
        rarest = item[np.argsort(df[item], kind="stable")][: miss + max(1, math.ceil(HITS * len(item)))]
        least.append(len(rarest) - miss)
        reach.append(-(-len(item) // STRIDE))
        word, times = np.unique(rarest, return_counts=True)
        chosen.append((word, np.full(len(word), nth), times))
    if not chosen:
        return None
    word, item, times = (np.concatenate(c) for c in zip(*chosen, strict=True))
    order = np.argsort(word, kind="stable")
    used, first = np.unique(word[order], return_index=True)
    return Probes(used, np.append(first, len(word)), item[order], times[order], np.asarray(least), np.asarray(reach))


@dataclass
class Windows:
    """Sparse unit vectors: entry i is word[i] with weight[i] in window row[i]; rows ascend. key: the window's number in the batch."""

    row: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    key: np.ndarray

    def times(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.key), x.shape[1]), np.float32)
        place = np.arange(len(self.row)) - self.starts()[self.row] if len(self.row) else self.row
        for nth in range(int(place.max(initial=-1)) + 1):  # the first word of each window, the second, ...
            at = np.flatnonzero(place == nth)
            out[self.row[at]] += x[self.word[at]] * self.weight[at, None]
        return out

    def starts(self) -> np.ndarray:
        return np.searchsorted(self.row, np.arange(len(self.key)))

    def transposed(self, y: np.ndarray, out: np.ndarray) -> None:
        """Adds A'y to out, a word at a time."""
        order = np.argsort(self.word, kind="stable")
        word = self.word[order]
        edges = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = order[a:b]
            out[word[a]] += self.weight[at] @ y[self.row[at]]

    def some(self, begin: int, end: int) -> Windows:
        a, b = np.searchsorted(self.row, (begin, end))
        return Windows(self.row[a:b] - begin, self.word[a:b], self.weight[a:b], self.key[begin:end])


def blocks_of(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For all words of a batch the number of their block, counted through; and each document's first block."""
    n = np.asarray([len(d) for d in docs], np.int64)
    first = np.cumsum(np.concatenate(([0], -(-n // STRIDE))))
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first[:-1], n) + inside // STRIDE, first


def windows(docs: list[np.ndarray], bench: Benchmark) -> tuple[Windows, np.ndarray]:
    """The windows of a batch that have words that count, and each document's first block."""
    block, first = blocks_of(docs)
    pos, word = bench.find(np.concatenate(docs) if docs else np.zeros(0, np.int32))
    here = block[pos]
    begins = np.zeros(int(first[-1]) + 1, bool)
    begins[first[:-1]] = True
    back = ~begins[here]  # a block is the second half of the window before, save at a document's start
    n = max(len(bench.words), 1)
    cell, tf = np.unique(np.concatenate((here, here[back] - 1)) * n + np.concatenate((word, word[back])), return_counts=True)
    key, word = np.divmod(cell, n)
    weight = ((1 + np.log(tf)) * bench.idf[word]).astype(np.float32) if len(word) else np.zeros(0, np.float32)
    names, row = np.unique(key, return_inverse=True)
    norm = np.sqrt(np.bincount(row, weight.astype(np.float64) ** 2, len(names)))
    return Windows(row, word, (weight / norm[row]).astype(np.float32), names), first


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with one bit for each word of a."""
    at: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        if m := at.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def holds(item: np.ndarray, around: np.ndarray) -> tuple[float, bool]:
    """Share of the item that the words around a window have in order, and whether its answer is among them."""
    answer = item[-max(ANSWER_WORDS, math.ceil(ANSWER * len(item))) :]
    return lcs_length(item, around) / len(item), lcs_length(answer, around) == len(answer)


def cut(item: np.ndarray) -> list[np.ndarray]:
    """An item as passages of two blocks, or itself if shorter."""
    return [item[i : i + 2 * STRIDE] for i in range(0, max(1, len(item) - STRIDE), STRIDE)]


def read_items(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = WORDS) -> Iterator[Benchmark]:
    """The benchmark in blocks of rows; one block at a time is on the driver."""
    rows = bench.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids, items, seen = [], [], set()

    def made() -> Benchmark:
        hashes = np.unique(np.concatenate(items))
        return Benchmark(ids, [number(hashes, i) for i in items], np.arange(1, len(hashes) + 1), hashes)

    for r in rows.toLocalIterator():
        (item,) = word_hashes([r.text and r.text.lower()], PLAIN)
        if len(item):
            ids.append(r.id)
            items.append(item)
            seen.update(item.tolist())
            if len(seen) >= most or len(items) >= ITEMS or len(seen) * len(items) >= CELLS:
                yield made()
                ids, items, seen = [], [], set()
    if items:
        yield made()


def numbered(docs: DataFrame, bench: Benchmark, kind: str) -> DataFrame:
    """(doc_id, words): texts as numbers of the block's words, 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = word_hashes((t and t.lower() for t in batch.column("text").to_pylist()), PLAIN)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array((number(bench.hashes, w).tobytes() for w in each), pa.binary(), size=batch.num_rows)], ["doc_id", "words"])

    return docs.mapInArrow(run, f"doc_id {kind}, words binary")


def word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, [np.frombuffer(w.as_buffer(), np.int32) for w in batch.column("words")]


def weigh(docs: DataFrame, bench: Benchmark, bound: bool = True) -> Benchmark:
    """Sets the weights from all documents, numbered, and leaves out the words that are too common."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(len(bench.hashes) + 1, np.int64)
        for _, words in word_batches(batches):
            df += np.bincount(np.concatenate(words), minlength=len(df))
            total += sum(-(-len(w) // STRIDE) for w in words)
        df[0] = 0
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.append(some, -1), pa.int64()), "df": pa.array(np.append(df[some], total), pa.int64())})

    counted = docs.select("words").mapInArrow(count, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()  # a row for each word of the block
    df, total = np.zeros(len(bench.hashes) + 1, np.int64), 1
    for r in counted:
        if r.word < 0:
            total = max(1, r.df)
        else:
            df[r.word] = r.df
    keep = (df > 0) & (df <= MAX_DF * total)
    for item in bench.items:
        at = np.unique(item)
        at = at[df[at] > 0]
        keep[at[np.argsort(df[at], kind="stable")[:RARE]]] = True
    words = np.flatnonzero(keep)
    return Benchmark(bench.ids, bench.items, words, bench.hashes, np.log1p(total / df[words]), probes(bench.items, df, bound))


def gram_times(docs: DataFrame, bench: Benchmark, x: np.ndarray) -> np.ndarray:
    """A'(A x), A having a row for each window of all documents."""
    n, width = x.shape

    def part(batches: Iterator[pa.RecordBatch], out: np.ndarray) -> None:
        for _, words in word_batches(batches):
            every, _ = windows(words, bench)
            for begin in range(0, len(every.key), CHUNK):
                w = every.some(begin, begin + CHUNK)
                w.transposed(w.times(x), out)

    return summed(docs.select("words"), n, width, part)


def singular_vectors(docs: DataFrame, bench: Benchmark, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Right singular vectors (words x rank) of the windows of all documents, from one pass over these."""
    n = len(bench.words)
    width = min(n, rank + EXTRA)
    x, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))
    y = gram_times(docs, bench, x.astype(np.float32))
    # A'A is nearly Y (X'Y)^-1 Y'; a small shift keeps X'Y invertible
    y += (shift := 1e-6 * max(np.linalg.norm(y), 1e-12)) * x
    root = np.linalg.cholesky((x.T @ y + y.T @ x) / 2 + shift * np.eye(width))
    left, _, _ = np.linalg.svd(np.linalg.solve(root, y.T).T, full_matrices=False)
    return left[:, : min(rank, width)].astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Latent:
    """Candidates of a batch of documents, by the cosine of windows and passages in the latent space."""

    def __init__(self, bench: Benchmark, vectors: np.ndarray, least: float = COSINE) -> None:
        self.bench, self.vectors, self.least = bench, vectors, least
        cuts = [cut(item) for item in bench.items]
        own, first = windows([p for c in cuts for p in c], bench)
        # a passage's first block names the window that is the whole passage
        whole = np.isin(own.key, first[:-1])
        self.owner = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])[np.searchsorted(first, own.key[whole])]
        self.query = unit(own.times(vectors)[whole])
        need = [math.ceil(LCS_ANSWER * len(item) - 1e-9) for item in bench.items]
        self.need, self.sizes = np.asarray(need, np.int64), np.asarray([len(item) for item in bench.items], np.int64)
        # which words an item has, a bit each, and how often; column 0 is no word of the benchmark
        self.wide = len(bench.hashes) + 1
        bits = np.zeros((len(bench.items), self.wide // 8 + 1), np.uint8)
        cells = []
        for i, item in enumerate(bench.items):
            word, n = np.unique(item, return_counts=True)
            np.bitwise_or.at(bits[i], word >> 3, (1 << (word & 7)).astype(np.uint8))
            cells.append((i * self.wide + word, n))
        self.has = bits
        self.cell, self.times = (np.concatenate(c) for c in zip(*cells, strict=True))

    def near(self, every: Windows) -> np.ndarray:
        """All pairs of window and item whose cosine is `least` or more, as window * items + item, ascending."""
        found = [np.zeros(0, np.int64)]
        step = max(16, min(CHUNK, COSINES // max(1, len(self.query))))
        items, begins = np.unique(self.owner, return_index=True)
        for begin in range(0, len(every.key) if len(items) else 0, step):
            w = every.some(begin, begin + step)
            cosine = np.maximum.reduceat(unit(w.times(self.vectors)) @ self.query.T, begins, axis=1)
            i, j = np.nonzero(cosine >= self.least)
            found.append(w.key[i] * len(self.need) + items[j])
        return np.concatenate(found)

    def candidates(self, docs: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(document, item, first word of the window) of the near pairs where enough words of the item are around the window."""
        every, first = windows(docs, self.bench)
        key, item = np.divmod(self.near(every), len(self.need))
        if not len(key):
            return []
        doc = np.searchsorted(first, key, "right") - 1
        size = np.asarray([len(d) for d in docs], np.int64)
        flat = np.append(np.concatenate(docs), np.int32(0))
        begins = np.cumsum(size) - size
        start = (key - first[doc]) * STRIDE
        # windows of an item next to each other are first tested as one stretch, which has all that is around them
        order = np.lexsort((key, item))
        key, item, doc, start = (x[order] for x in (key, item, doc, start))
        run = np.flatnonzero(np.concatenate(([True], (np.diff(item) != 0) | (np.diff(doc) != 0) | (np.diff(key) > 2))))
        of_run = np.append(run[1:], len(key)) - run
        ok = self.enough(flat, begins[doc[run]], np.maximum(0, start[run] - self.sizes[item[run]]), np.minimum(size[doc[run]], start[run + of_run - 1] + 2 * STRIDE + self.sizes[item[run]]), item[run])
        keep = np.repeat(ok, of_run)
        item, doc, start = (x[keep] for x in (item, doc, start))
        ok = self.enough(flat, begins[doc], np.maximum(0, start - self.sizes[item]), np.minimum(size[doc], start + 2 * STRIDE + self.sizes[item]), item)
        return list(zip(doc[ok].tolist(), item[ok].tolist(), start[ok].tolist(), strict=True))

    def enough(self, flat: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether the words low to high of the document that begins there can hold as many of the item as the rule asks for."""
        out = np.zeros(len(item), bool)
        for a in range(0, len(item), 4096):
            some = slice(a, a + 4096)
            pair, place = spread((begin + low)[some], (high - low)[some])
            word, need, wide = flat[place], self.need[item[some]], self.wide
            inside = self.has[item[some][pair], word >> 3] >> (word & 7).astype(np.uint8) & 1
            left = np.flatnonzero(inside)
            pair, word = pair[left], word[left]
            most = np.bincount(pair, minlength=len(need))
            # of those that remain a word counts no oftener than the item has it
            left = np.flatnonzero((most >= need)[pair])
            cell, n = np.unique(pair[left] * wide + word[left], return_counts=True)
            pair, word = np.divmod(cell, wide)
            out[some] = np.bincount(pair, np.minimum(n, self.times[np.searchsorted(self.cell, item[some][pair] * wide + word)]), len(need)) >= need
        return out


def places(bench: Benchmark, latent: Latent, words: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(document, item, first word of the window): all places that can meet the rule, of the items that have probes."""
    runs = list(bench.probes.places(words)) if bench.probes else []
    if not runs:
        return []
    size = np.asarray([len(w) for w in words], np.int64)
    flat, begins = np.append(np.concatenate(words), np.int32(0)), np.cumsum(size) - size

    def enough(doc: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        low, high = np.maximum(0, first * STRIDE - latent.sizes[item]), np.minimum(size[doc], (last + 2) * STRIDE + latent.sizes[item])
        ok = latent.enough(flat, begins[doc], low, high, item)
        return np.flatnonzero(ok), low, high

    doc, item = np.array([r[0] for r in runs]), np.array([r[1] for r in runs])
    ok, low, high = enough(doc, item, np.array([r[2][0] for r in runs]), np.array([r[2][-1] for r in runs]))
    held = [k for k in ok.tolist() if lcs_length(bench.items[item[k]], words[doc[k]][low[k] : high[k]]) >= LCS_ANSWER * len(bench.items[item[k]]) - 1e-9]
    if not held:
        return []
    near = [runs[k][2] for k in held]
    n = [len(x) for x in near]
    doc, item, near = np.repeat(doc[held], n), np.repeat(item[held], n), np.concatenate(near)
    ok, _, _ = enough(doc, item, near, near)
    return list(zip(doc[ok].tolist(), item[ok].tolist(), (near[ok] * STRIDE).tolist(), strict=True))


def cosines(bench: Benchmark, latent: Latent, words: list[np.ndarray], found: list[tuple[int, int, int]]) -> list[float]:
    """Of each document, item and window the largest cosine of the window and a passage of the item."""
    every, first = windows([words[d][start : start + 2 * STRIDE] for d, _, start in found], bench)
    whole = np.isin(every.key, first[:-1])
    vector = np.zeros((len(found), latent.vectors.shape[1]), np.float32)
    vector[np.searchsorted(first, every.key[whole])] = unit(every.times(latent.vectors)[whole])
    return [float((latent.query[latent.owner == i] @ v).max(initial=0)) for (_, i, _), v in zip(found, vector, strict=True)]


def matches(docs: DataFrame, bench: Benchmark, vectors: np.ndarray, kind: str, bound: bool, least: float = COSINE) -> DataFrame:
    """A row (doc_id, item, cosine, lcs, answer, latent) for each document and item that it holds.

    cosine is that of the place with the longest common part; latent: whether the latent search led to a place that holds it.
    """
    latent = Latent(bench, vectors, least)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in word_batches(batches):
            if bound:
                every, first = windows(words, bench)
                near, asked = latent.near(every), places(bench, latent, words)
                pairs = np.array([(first[d] + start // STRIDE) * len(bench.items) + i for d, i, start in asked], np.int64)
                at = np.minimum(np.searchsorted(near, pairs), max(0, len(near) - 1))
                retrieved = near[at] == pairs if len(near) else np.zeros(len(pairs), bool)
            else:
                asked = latent.candidates(words)
                retrieved = [True] * len(asked)
                asked, retrieved = (asked + (more := places(bench, latent, words)), retrieved + [False] * len(more))
            best: dict[tuple[int, int], tuple] = {}
            by_latent = set()
            for (d, i, start), seen in zip(asked, retrieved, strict=True):
                item = bench.items[i]
                share, answer = holds(item, words[d][max(0, start - len(item)) : start + 2 * STRIDE + len(item)])
                if share >= LCS or share >= LCS_ANSWER and answer:
                    found = (share, answer, -start)
                    best[d, i] = max(found, best.get((d, i), found))
                    if seen:
                        by_latent.add((d, i))
            if best:
                cosine = cosines(bench, latent, words, [(d, i, -v[2]) for (d, i), v in best.items()])
                at_doc = pa.array([d for d, _ in best], pa.int64())
                columns = [[i for _, i in best], cosine, [v[0] for v in best.values()], [v[1] for v in best.values()], [k in by_latent for k in best]]
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at_doc), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "item", "cosine", "lcs", "answer", "latent"])

    return docs.mapInArrow(search, f"doc_id {kind}, item long, cosine double, lcs double, answer boolean, latent boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", bound: bool = True, least: float = COSINE) -> DataFrame:
    """A row (doc_id, item_id, cosine, lcs, answer, latent) for each document and benchmark item that it holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "item_id": benchmark.schema[item_id_col].dataType.simpleString()}
    parts, shelf = [], Shelf(spark)
    for bench in read_items(benchmark, item_id_col, item_text_col):
        shelf.drop(*(f for f, _ in shelf.held))
        words = shelf.put(numbered(docs, bench, kinds["doc_id"]))
        bench = weigh(words, bench, bound)
        if not len(bench.words):  # no document has a word of theirs
            continue
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(bench.ids)), pa.int64()), "item_id": bench.ids}))
        names = names.select("item", F.col("item_id").cast(kinds["item_id"]))
        found = matches(words, bench, singular_vectors(words, bench), kinds["doc_id"], bound, least)
        parts.append(checkpoint(found.join(F.broadcast(names), "item")))  # ITEMS rows at most
    shelf.drop(*(f for f, _ in shelf.held))
    if not parts:
        none = {"doc_id": kinds["doc_id"], "item_id": kinds["item_id"], "cosine": "double", "lcs": "double", "answer": "boolean", "latent": "boolean"}
        return spark.range(0).select(*(F.lit(None).cast(kind).alias(c) for c, kind in none.items()))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "answer", "cosine")).alias("_b"), F.bool_or("latent").alias("latent"))
    return best.select("doc_id", "item_id", "_b.cosine", "_b.lcs", "_b.answer", "latent")


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item; rows are told apart by content, so one that shares its id with such a row stays."""
    key = F.struct(*row_key(F.col(text_col), F.col(id_col)))
    found = checkpoint(contaminated(docs.select(key.alias("doc_id"), F.col(text_col).alias("text")), benchmark).select("doc_id._row1", "doc_id._row2").distinct())
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_in"), *row_key(F.col(text_col), F.col(id_col)))
    return checked_join(whole, found, ["_row1", "_row2"], "left_anti").select("_in.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
