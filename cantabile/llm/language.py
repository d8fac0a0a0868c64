"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a public vocabulary, which is never changed. Each language has a
probability for every piece. A word (a run of letters, lower-cased, with a mark at its start) is scored by the forward
algorithm: the sum, over all ways to cut the whole word into pieces, of the product of their probabilities; a
text by the sum of its words' logarithms. Letters that aren't pieces may stand alone with a small
probability, the same in each language, so every word has a score. The score of a text is the share of the predicted
language when each language has the mean likelihood of a word there: near 1 where all words speak for it, about one half
where two languages are mixed.

The probabilities are fitted by expectation maximisation, on the word counts of a
sample of labelled rows of at most about TRAIN_ROWS rows a language, taken by a hash of the id; their words
are counted and expectations added up by Spark, and the driver gets pieces x languages numbers.

Words of one length are worked through together, as many as BYTES allow for the number of languages, and STRETCH letters
at a time: from one stretch to the next only the sums at the last places are carried, brought to scale, so a
word may have any length.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if
nothing was learned; ties go to the language that sorts first; rows are independent, so repeated
rows and null or equal ids are as good as any; rows with a null language teach nothing; an empty table
gives an empty result; extra columns pass through, save lang_pred and score, which are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantabile.llm.common import bounded_batches, checkpoint, table
from cantabile.llm.matrices import summed
from cantabile.llm.shingles import mix, powers

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
TRAIN_ROWS, ROUNDS = 2000, 3
#: Letters of a word between two rescalings: 1e-7 for each, and for those before that a piece spans, is no underflow.
STRETCH = 16
#: Bytes of the arrays that words are scored in.
BYTES = 1 << 23
#: Probability of a letter that isn't a piece, and what is added to every expected count.
UNKNOWN, SMOOTH = 1e-7, 0.01
#: What a worker remembers: bytes of words' scores, and letters of a word that is worth it. Words of texts that are scored at a time.
MEMORY, REMEMBERED, AT_ONCE = 1 << 25, 40, 100_000
_WORD = regex.compile(r"\p{L}+")


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """The vocabulary's pieces that are letters, with or without the mark, and their numbers from 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return {p: i for i, p in enumerate(sorted({p for p in found if p.lower() == p and _WORD.fullmatch(p.removeprefix(MARK))} | {MARK}))}


def words_of(text: str | None) -> Iterator[str]:
    """The words of a text, with their marks."""
    return (MARK + m.group() for m in _WORD.finditer(text.lower())) if text else iter(())


class Finder:
    """The numbers of pieces by the hashes of their letters, looked up for whole arrays at a time."""

    def __init__(self, known: dict[str, int]) -> None:
        self.n = len(known)
        self.longest = max(map(len, known), default=1)
        self.powers = powers(np.uint64(0x9E3779B97F4A7C15), self.longest)
        self.hashes = np.zeros(self.n, np.uint64)
        for length in range(1, self.longest + 1):
            some = [k for k in known if len(k) == length]
            if some:
                self.hashes[[known[k] for k in some]] = list(self.substrings(letters(some)))[-1][1][:, 0]
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def substrings(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each length of a piece the hashes of the substrings that begin at each place."""
        h = np.zeros_like(codes)
        for length in range(1, min(self.longest, codes.shape[1]) + 1):
            n = codes.shape[1] - length + 1
            h = h[:, :n] + (codes[:, length - 1 :] + np.uint64(1)) * self.powers[length - 1]
            yield length, mix(h + np.uint64(length))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, n + 1 where there is none."""
        out = np.full(hashes.shape, self.n + 1, np.int32)
        at = np.nonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        asked = hashes[at]
        place = np.minimum(np.searchsorted(self.sorted, asked), self.n - 1)
        out[at] = np.where(self.sorted[place] == asked, self.order[place], self.n + 1)
        return out


def letters(same_length: list[str]) -> np.ndarray:
    return np.frombuffer("".join(same_length).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(same_length), -1).astype(np.uint64)


class Lattice:
    """All pieces in words of one length.

    Numbers beyond the pieces: n for a letter that isn't one, n + 1 for nothing; p has a row for each.
    """

    def __init__(self, same_length: list[str], finder: Finder) -> None:
        self.codes, self.finder = letters(same_length), finder
        self.units, self.length = self.codes.shape
        self.longest = min(finder.longest, self.length)
        self.stretches = range(0, self.length, STRETCH)

    def ends(self, begin: int) -> np.ndarray:
        """ends[e, l, word]: the piece of l + 1 letters that ends after letter e of the stretch that begins here."""
        first, stop = max(0, begin - self.longest + 1), min(self.length, begin + STRETCH)
        out = np.full((stop - begin, self.longest, self.units), self.finder.n + 1, np.int32)
        for size, h in self.finder.substrings(self.codes[:, first:stop]):
            found = self.finder.find(h[:, max(0, begin - first - size + 1) :]).T
            out[len(out) - len(found) :, size - 1] = found
        out[:, 0][out[:, 0] == self.finder.n + 1] = self.finder.n
        return out

    def advance(self, before: np.ndarray, ends: np.ndarray, p: np.ndarray) -> np.ndarray:
        """alpha[place, word, language] from `longest` places before a stretch, which are given, to its end."""
        k = self.longest
        alpha = np.concatenate((before, np.zeros((len(ends), self.units, p.shape[1]))))
        for e, pieces_here in enumerate(ends):
            alpha[k + e] = np.einsum("lum,lum->um", alpha[e : k + e][::-1], p[pieces_here])
        return alpha

    def forward(self, p: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each stretch: its begin, its ends, its alpha and the logarithm of the alphas' scale."""
        log = np.zeros((self.units, p.shape[1]))
        alpha = np.zeros((self.longest, self.units, p.shape[1]))
        alpha[-1] = 1
        for begin in self.stretches:
            ends = self.ends(begin)
            alpha = self.advance(alpha, ends, p)
            yield begin, ends, alpha, log
            top = alpha[-1]
            log = log + np.log(top)
            alpha = alpha[-self.longest :] / top

    def log_totals(self, p: np.ndarray) -> np.ndarray:
        """[word, language]: the logarithm of the summed probability of all segmentations."""
        for _, _, alpha, log in self.forward(p):
            pass
        return log + np.log(alpha[-1])

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, for counts[word, language]."""
        k, out = self.longest, np.zeros_like(p)
        starts = [(alpha[:k].copy(), log) for _, _, alpha, log in self.forward(p)]
        total = self.log_totals(p)
        # beta of the last places before what has been done, and the logarithm of their scale
        after, down = np.zeros((k, self.units, p.shape[1])), np.zeros((self.units, p.shape[1]))
        after[-1] = 1
        for begin, (before, log) in zip(reversed(self.stretches), reversed(starts), strict=True):
            ends = self.ends(begin)
            alpha = self.advance(before, ends, p)
            beta = np.concatenate((np.zeros((len(ends), self.units, p.shape[1])), after))
            share = counts * np.exp(log + down - total)
            for e in range(len(ends) - 1, -1, -1):
                flow = p[ends[e]] * beta[k + e]
                uses = alpha[e : k + e][::-1] * flow * share
                beta[e : k + e][::-1] += flow
                for j in range(p.shape[1]):
                    out[:, j] += np.bincount(ends[e].reshape(-1), uses[:, :, j].reshape(-1), len(p))
            top = np.maximum(beta[k - 1], 1e-300)
            after, down = beta[:k] / top, down + np.log(top)
        return out


def by_length(words: list[str], languages: int, longest: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Positions and words of one length, as many at once as BYTES allow."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        k = min(int(n), longest)
        each = 8 * languages * (3 * k + 2 * STRETCH + k * (int(n) // STRETCH + 1)) + 4 * k * STRETCH + 32 * int(n)
        where = np.flatnonzero(sizes == n)
        at_once = max(1, BYTES // each)
        for i in range(0, len(where), at_once):
            some = where[i : i + at_once]
            yield some, [words[k] for k in some.tolist()]


@lru_cache(maxsize=2)
def finder(path: str) -> Finder:
    return Finder(pieces(path))


@dataclass
class Model:
    """languages, and p[piece, language] with two more rows: for letters that aren't pieces, and zeros."""

    path: str
    languages: list[str]
    p: np.ndarray
    name: str = ""

    def logs(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        known = finder(self.path)
        for at, some in by_length(words, len(self.languages), known.longest):
            out[at] = Lattice(some, known).log_totals(self.p)
        return out


class Scorer:
    """A worker's memory of words and their scores, bounded in bytes."""

    def __init__(self, model: Model) -> None:
        self.model, self.index = model, {}
        self.most = max(1000, MEMORY // (8 * len(model.languages) + 160))
        self.table = np.zeros((1024, len(model.languages)))

    def logs(self, words: list[str]) -> np.ndarray:
        """[word, language], for words with repeats; new ones are remembered."""
        new = list({w for w in words if w not in self.index and len(w) <= REMEMBERED})
        if len(self.index) + len(new) > self.most:
            self.index.clear()
            new = list({w for w in words if len(w) <= REMEMBERED})
        size = len(self.index)
        while size + len(new) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[size : size + len(new)] = self.model.logs(new)
        self.index.update(zip(new, range(size, size + len(new)), strict=True))
        rare = [i for i, w in enumerate(words) if len(w) > REMEMBERED]
        out = self.table[np.fromiter((self.index.get(w, 0) for w in words), np.int64, len(words))]
        if rare:
            out[rare] = self.model.logs([words[i] for i in rare])
        return out

    def of(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        m = len(self.model.languages)
        total, n = np.zeros((len(texts), m)), np.zeros(len(texts), np.int64)
        held: list[str] = []
        rows: list[int] = []

        def flush() -> None:
            logs, row = self.logs(held), np.asarray(rows)
            for j in range(m):
                total[:, j] += np.bincount(row, logs[:, j], len(texts))
            held.clear()
            rows.clear()

        for i, text in enumerate(texts if m else ()):
            words = words_of(text)
            while some := list(islice(words, AT_ONCE)):
                held.extend(some)
                rows.extend([i] * len(some))
                n[i] += len(some)
                if len(held) >= AT_ONCE:
                    flush()
        if held:
            flush()
        if not m:
            return ["und"] * len(texts), np.zeros(len(texts))
        mean = total / np.maximum(n, 1)[:, None]
        best = mean.argmax(axis=1)
        score = 1 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.model.languages[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, score, 0.0)


#: The scorer of the model in use, kept while the worker lives.
_scorers: dict[str, Scorer] = {}


def predict(text: Column, model: Model) -> Column:
    """A struct (lang_pred, score) for a text column; it is computed once, wherever it is used again."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def _predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if model.name not in _scorers:
            _scorers.clear()
            _scorers[model.name] = Scorer(model)
        scorer = _scorers[model.name]
        for batch in batches:
            names, scores = scorer.of(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    # Spark repeats a deterministic function below a filter on its result and above
    return _predict.asNondeterministic()(text)


def train(labelled: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Model:
    """Fits a model on rows with a text and a language."""
    spark = labelled.sparkSession
    bounded_batches(spark)
    path = path or public_tokenizers.path(VOCABULARY)
    source = labelled.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in source.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}  # a row for each language
    languages = sorted(sizes)
    n = len(pieces(path))
    if not languages:
        return Model(path, [], np.zeros((n + 2, 0)))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows / sizes[k]))])
    sample = source.where(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in seen], pa.string()), "word": pa.array([k[1] for k in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    per_lang = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i, k in enumerate(languages)]
    counted = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("word").agg(*per_lang)
    # a small table with much work in each row: over all cores, or it would be a few tasks
    counts = checkpoint(counted.repartition(spark.sparkContext.defaultParallelism))

    p = np.full((n + 2, len(languages)), 1.0 / n)
    p[n], p[n + 1] = UNKNOWN, 0
    for _ in range(rounds):

        def part(batches: Iterator[pa.RecordBatch], out: np.ndarray, p: np.ndarray = p) -> None:
            known = finder(path)
            for batch in batches:
                c = np.stack([batch.column(f"n{i}").to_numpy() for i in range(len(languages))], axis=1)
                for at, some in by_length(batch.column("word").to_pylist(), len(languages), known.longest):
                    out += Lattice(some, known).expected(p, c[at])

        uses = summed(counts, n + 2, len(languages), part)[:n] + SMOOTH
        p[:n] = uses / uses.sum(axis=0)
    return Model(path, languages, p, uuid.uuid4().hex)


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    bounded_batches(docs.sparkSession)
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("in"), predict(F.col(text_col), model).alias("out"))
    own = [F.col("in")[c].alias(c) for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return found.select(*own, "out.lang_pred", "out.score")


def held_out(fold: int, of: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(2, 4) & F.col("doc_id").isNotNull()))
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")
