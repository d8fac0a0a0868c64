"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of letters and digits, and runs of other signs; letters A-Z count as a-z. So that the vectors need the same memory whatever
the corpus, words share BUCKETS classes by their hash; each class has a fixed sparse random index vector. A class's word vector is the sum of
the index vectors around all its words' occurrences in all documents, added up by Spark. A document is the
mean and the spread of its tokens' word vectors, with a few figures of
its surface (length, share of signs and of capitals, variety).

A network with one hidden layer is trained with numpy on the driver, on at most TRAIN_ROWS labelled
rows, taken by a hash of the id; a temperature, fitted on rows kept out of training, makes its output
a probability. Scoring runs on the pooled vectors.

Defined results: a null or empty text has a vector of zeros and is scored like any other; if nothing
could be learned (no labelled rows) every score is 0.5, and if all labels agree it is their smoothed
share; rows with a null label teach nothing; rows with equal ids are rows of their own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantabile.llm.common import checkpoint, bounded_batches, table
from cantabile.llm.language import held_out
from cantabile.llm.matrices import summed
from cantabile.llm.shingles import PIECE, mix, powers

BUCKETS, DIM, ONES, REACH = 1 << 14, 32, 4, 2
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 48, 60, 64, 3e-3, 1e-4
SURFACE = 6

_BASE = np.uint64(0xD6E8FEB86659FD93)
_POW = powers(_BASE, PIECE + 1)
_INV = powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), PIECE + 1)
#: 0: white space, 1: letters, digits and bytes beyond ASCII, 2: other signs.
_KIND = np.asarray([0 if b == 0x20 or 0x09 <= b <= 0x0D else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[0x41:0x5B] += np.uint64(32)
_CAPITAL = np.asarray([0x41 <= b <= 0x5A for b in range(256)])


@dataclass
class Tokens:
    """The tokens of a run of documents: bucket, kind, length, whether all capitals; n: how many each document has."""

    bucket: np.ndarray
    sign: np.ndarray
    length: np.ndarray
    capitals: np.ndarray
    n: np.ndarray


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces of at most PIECE bytes, or of one longer token; each ends where a token may."""
    kind = _KIND[np.frombuffer(raw, np.uint8)]
    edges = np.append(np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(raw))
    start = 0
    while start < len(raw):
        at = np.searchsorted(edges, start + PIECE, "right") - 1
        stop = int(edges[at] if at >= 0 and edges[at] > start else edges[at + 1])
        yield raw[start:stop]
        start = stop


def _long_token(buf: np.ndarray) -> np.uint64:
    """A hash of a token that is longer than a piece."""
    total = np.uint64(len(buf))
    for i in range(0, len(buf), PIECE):
        part = _LOWER[buf[i : i + PIECE]]
        total = mix(np.asarray([total ^ (part * _POW[: len(part)]).sum(dtype=np.uint64)]))[0]
    return total


def _tokens(raw: bytes) -> tuple[np.ndarray, ...]:
    buf = np.frombuffer(raw, np.uint8)
    if len(buf) > PIECE:  # one token, or white space
        n = int(_KIND[buf[0]] > 0)
        caps = np.full(n, bool(_CAPITAL[buf].all()))
        return np.zeros(n, np.int64), np.full(n, int(_long_token(buf) % np.uint64(BUCKETS))), np.full(n, _KIND[buf[0]] == 2), np.full(n, len(buf)), caps
    kind = np.concatenate((np.zeros(1, np.uint8), _KIND[buf], np.zeros(1, np.uint8)))
    edges = np.flatnonzero(kind[1:] != kind[:-1])
    starts, ends = edges[:-1], edges[1:]
    inside = kind[starts + 1] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[inside], ends[inside]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[buf] * _POW[: len(buf)], dtype=np.uint64)))
    caps = np.concatenate((np.zeros(1, np.int64), np.cumsum(_CAPITAL[buf])))
    bucket = (mix((sums[ends] - sums[starts]) * _INV[starts]) % np.uint64(BUCKETS)).astype(np.int64)
    length = ends - starts
    return starts, bucket, _KIND[buf[starts]] == 2, length, (caps[ends] - caps[starts] == length) & (length > 1)


def tokens(texts: list[str | None]) -> Iterator[Tokens]:
    """Tokens of all texts, a bounded number of bytes at a time; a text longer than that is cut between tokens, and its parts are joined."""
    held: list[bytes] = []
    size = 0

    def made() -> Tokens:
        starts, *cols = _tokens(b" ".join(held))
        offsets = np.cumsum([0, *(len(x) + 1 for x in held)])
        return Tokens(*cols, np.diff(np.searchsorted(starts, offsets)))

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if size + len(raw) + 1 > PIECE and held:
            yield made()
            held, size = [], 0
        if len(raw) >= PIECE:
            parts = [_tokens(piece)[1:] for piece in _pieces(raw)]
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            yield Tokens(*cols, np.asarray([len(cols[0])]))
        else:
            held.append(raw)
            size += len(raw) + 1
    if held:
        yield made()


def index_vectors(seed: int = 11) -> np.ndarray:
    """The fixed random index vectors: ONES signs among DIM places for each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for _ in range(ONES):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] += rng.choice(np.asarray([-1, 1], np.float32), BUCKETS)
    return out


def context_sums(t: Tokens, index: np.ndarray, out: np.ndarray) -> None:
    """Adds to out[bucket] the index vectors within REACH tokens, in the same document, of each of its tokens."""
    doc = np.repeat(np.arange(len(t.n)), t.n)
    near = np.zeros((len(t.bucket), DIM), np.float32)
    vectors = index[t.bucket]
    for d in range(1, REACH + 1):
        same = (doc[d:] == doc[:-d])[:, None]
        near[d:] += vectors[:-d] * same
        near[:-d] += vectors[d:] * same
    order = np.argsort(t.bucket, kind="stable")
    b = t.bucket[order]
    if len(b):
        starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        out[b[starts]] += np.add.reduceat(near[order], starts, axis=0)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """A unit vector for each bucket, from all documents."""
    index = index_vectors()

    def part(batches: Iterator[pa.RecordBatch], out: np.ndarray) -> None:
        for batch in batches:
            for t in tokens(batch.column(0).to_pylist()):
                context_sums(t, index, out)

    sums = summed(docs.select(text_col), BUCKETS, DIM, part)
    # the frequent words are around every word: what all have in common says nothing
    seen = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = sums / np.maximum(seen, 1e-9)
    used = seen[:, 0] > 0
    if used.any():
        vectors[used] -= vectors[used].mean(axis=0)
    return vectors.astype(np.float32)


def pool(t: Tokens, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each document."""
    out = np.zeros((len(t.n), 2 * vectors.shape[1] + SURFACE), np.float32)
    full = np.flatnonzero(t.n)
    if not len(full):
        return out
    starts = (np.cumsum(t.n) - t.n)[full]
    n = t.n[full][:, None].astype(np.float32)
    v = vectors[t.bucket]
    mean = np.add.reduceat(v, starts, axis=0) / n
    spread = np.sqrt(np.maximum(np.add.reduceat(v * v, starts, axis=0) / n - mean**2, 0))
    doc = np.repeat(np.arange(len(t.n)), t.n)
    kinds = np.unique(doc * BUCKETS + t.bucket)
    variety = np.bincount(kinds // BUCKETS, minlength=len(t.n))[full][:, None]
    share = lambda x: np.add.reduceat(x.astype(np.float32), starts)[:, None] / n
    again = np.concatenate(([False], (t.bucket[1:] == t.bucket[:-1]) & (doc[1:] == doc[:-1])))
    out[full] = np.concatenate((mean, spread, np.log1p(n) / 5, share(t.sign), share(t.capitals), variety / n**0.9, share(t.length) / 5, share(again)), axis=1)
    return out


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, features) for each document."""

    @F.arrow_udf("array<float>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [pool(t, vectors) for t in tokens(batch.to_pylist())]
            yield pa.array([r for part in rows for r in part], pa.list_(pa.float32()))

    return docs.select(F.col(id_col).alias("doc_id"), features(text_col).alias("features"))


@dataclass
class Network:
    """weights: (w1, b1, w2, b2), or None for a constant; mean and scale standardise the features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...] | None
    temperature: float = 1.0
    constant: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Trains on four fifths of the rows; the rest choose the epoch and the temperature."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(1), np.ones(1))
    if len(x) < 10 or y.min() == y.max():
        return Network(mean, scale, None, constant=float((y.sum() + 1) / (len(y) + 2)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    kept, rest = order[: max(2, len(x) // 5)], order[max(2, len(x) // 5) :]
    w = [rng.standard_normal((x.shape[1], HIDDEN)) * (2 / x.shape[1]) ** 0.5, np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * (1 / HIDDEN) ** 0.5, np.zeros(1)]
    first, second = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    net = Network(mean, scale, None)
    z = (x - mean) / scale
    best, chosen, step = np.inf, [a.copy() for a in w], 0

    def loss(logit: np.ndarray, label: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, logit) - label * logit))

    for _ in range(EPOCHS):
        rng.shuffle(rest)
        for i in range(0, len(rest), BATCH):
            b = rest[i : i + BATCH]
            hidden = np.maximum(z[b] @ w[0] + w[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -40, 40))) - y[b]) / len(b)
            back = np.outer(error, w[2]) * (hidden > 0)
            grads = [z[b].T @ back + DECAY * w[0], back.sum(axis=0), hidden.T @ error + DECAY * w[2], error.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        net.weights = tuple(w)
        if (now := loss(net.logits(x[kept]), y[kept])) < best:
            best, chosen = now, [a.copy() for a in w]
    net.weights = tuple(chosen)
    logit = net.logits(x[kept])
    net.temperature = float(min(np.geomspace(0.25, 8, 60), key=lambda t: loss(logit / t, y[kept])))
    return net


def learn(rows: DataFrame, labels: DataFrame, label_col: str = "quality", limit: int = TRAIN_ROWS) -> Network:
    """A network from pooled rows and labels (doc_id, label); of more than `limit` those with the least hash of the id."""
    known = rows.join(labels.where(F.col(label_col).isNotNull()).select("doc_id", F.col(label_col).cast("double").alias("_label")), "doc_id")
    got = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("features", "_label").toPandas()
    x = np.stack(got["features"].to_numpy()).astype(np.float64) if len(got) else np.zeros((0, 1))
    return fit(x, got["_label"].to_numpy(float))


def scored(rows: DataFrame, net: Network) -> DataFrame:
    """rows with score."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.array(net.score(flat.reshape(len(batch), -1)) if len(batch) else np.zeros(0))

    return rows.withColumn("score", score("features"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = checkpoint(pooled(docs, word_vectors(docs)))
    net = learn(rows.where(~held_out(1, 3) & F.col("doc_id").isNotNull()), table(spark, sf_dir, "labels"))
    return scored(rows, net).select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
