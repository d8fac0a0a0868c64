"""Language, quality and decontamination: the forward algorithm against enumeration, held-out accuracy, planted passages; the pipeline against brute force."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from cantabile.llm import bpe, decontaminate, language, quality
from tests.llm import brute
from tests.llm.conftest import passage

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def segmentations(word, known):
    """All ways to cut a word into pieces; a letter that isn't one stands alone."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in known or n == 1:
            for rest in segmentations(word[n:], known):
                yield [word[:n], *rest]


def probability(piece, known, p, n):
    return p[known[piece]] if piece in known else p[n]


def summed(word, known, p, n):
    """Logarithm of the sum over all segmentations, letter by letter, in whole numbers of no scale."""
    ways = [Fraction(1)]
    for e in range(1, len(word) + 1):
        ways.append(sum((ways[b] * Fraction(probability(word[b:e], known, p, n)) for b in range(e) if word[b:e] in known or e - b == 1), Fraction(0)))
    total = ways[-1]
    return math.log(total.numerator) - math.log(total.denominator)


@pytest.fixture(scope="module")
def known():
    return language.pieces(public_tokenizers.path(language.VOCABULARY))


def random_model(known, languages):
    n = len(known)
    p = np.zeros((n + 2, languages))
    p[:n] = np.random.default_rng(1).dirichlet(np.ones(n), languages).T
    p[n] = language.UNKNOWN
    return p


def test_forward_sums_all_segmentations(known):
    find, n, p = language.Finder(known), len(known), random_model(known, 3)
    for word in ["▁the", "▁und", "▁der", "▁qzx", "▁eñe", "▁日本a"]:
        want = [math.log(sum(math.prod(probability(x, known, p[:, j], n) for x in cut) for cut in segmentations(word, known))) for j in range(3)]
        assert np.allclose(language.Lattice([word], find).log_totals(p)[0], want, rtol=1e-9)


def test_forward_over_long_words(known):
    """Words much longer than a stretch, and of letters that aren't pieces, sum over all of it."""
    find, n, p = language.Finder(known), len(known), random_model(known, 2)
    long = "▁" + "donaudampfschifffahrtsgesellschaft" * 3
    for word in [long, long[:16], long[:17], long[:33], "▁" + "日本語" * 60]:
        got = language.Lattice([word, word], find).log_totals(p)
        assert np.allclose(got, [[summed(word, known, p[:, j], n) for j in range(2)]] * 2, rtol=1e-9)


def expected_uses(word, known, p, n):
    cuts = [(math.prod(probability(x, known, p, n) for x in c), c) for c in segmentations(word, known)]
    total = sum(w for w, _ in cuts)
    want = np.zeros(n + 2)
    for w, c in cuts:
        for x in c:
            want[known.get(x, n)] += 2 * w / total
    return want


def test_expected_uses_are_those_of_all_segmentations(known, monkeypatch):
    find, n, p = language.Finder(known), len(known), random_model(known, 1)
    want = expected_uses("▁standing", known, p[:, 0], n)
    assert np.allclose(language.Lattice(["▁standing"], find).expected(p, np.asarray([[2.0]]))[:, 0], want)
    for stretch in (1, 2, 3, 5):  # the same however often the sums are carried on
        monkeypatch.setattr(language, "STRETCH", stretch)
        assert np.allclose(language.Lattice(["▁standing"], find).expected(p, np.asarray([[2.0]]))[:, 0], want)


def test_predictions_against_brute_force(spark, known, docs, cases, monkeypatch):
    """Whole texts, word by word, by a plain sum; with a memory that is always full."""
    p = random_model(known, 3)
    model = language.Model(public_tokenizers.path(language.VOCABULARY), ["a", "b", "c"], p, "brute")
    monkeypatch.setattr(language, "MEMORY", 0)
    got = {r.doc_id: r for r in language.with_language(docs.where("length(text) < 2000 or text is null"), model).collect()}
    for i, text in cases:
        words = ["▁" + w for w in regex.findall(r"\p{L}+", (text or "").lower())]
        if i in got and not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
        elif i in got and i % 4 == 0:
            mean = np.mean([[summed(w, known, p[:, j], len(known)) for j in range(3)] for w in words], axis=0)
            assert got[i].lang_pred == "abc"[int(mean.argmax())]
            assert got[i].score == pytest.approx(1 / np.exp(mean - mean.max()).sum(), rel=1e-6)


def test_a_mixed_text_scores_lower(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("das ist ein Haus und der Hund schläft heute nicht", "de"), ("this is the house and the dog does not sleep today", "en")] * 5)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(0, "der Hund und das Haus"), (1, "the dog and the house"), (2, "the dog und das Haus")]
    got = {r.doc_id: r for r in language.with_language(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert (got[0].lang_pred, got[1].lang_pred) == ("de", "en") and got[2].score < min(got[0].score, got[1].score)


def test_language_of_held_out_documents(spark):
    got = language.op4_language(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id")
    rows = got.where("held_out and lang is not null and lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_language_edge_cases(spark, clashing, nothing):
    rows = [(1, "das ist ein Haus und der Hund", "de"), (2, "this is the house and the dog", "en"), (None, "the", None), (3, None, "en")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in language.with_language(clashing.withColumn("score", F.lit("x")), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[5].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[65].lang_pred in ("de", "en")
    empty = language.train(nothing)
    assert {r.lang_pred for r in language.with_language(clashing, empty).collect()} == {"und"}
    assert language.with_language(nothing, model).count() == 0


def test_quality_of_held_out_documents(spark):
    got = quality.op3_quality(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(got) > 50 and auc >= 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def plain_tokens(text):
    """(bytes, kind) of the tokens, byte by byte."""
    from itertools import groupby

    return [(bytes(g), k) for k, g in ((k, list(g)) for k, g in groupby((text or "").encode(), key=lambda b: int(quality._KIND[b]))) if k]


def test_quality_features_against_plain_sums(monkeypatch):
    """Pooled features of texts around the size of a piece, with tokens on every cut and one longer than a piece."""
    rng = random.Random(4)
    monkeypatch.setattr(quality, "PIECE", 64)
    texts = [None, "", "A", "!!", " \n"] + ["".join(rng.choice(["Ab", "XY", "é", "!?", " ", "\n", "word", "z" * 40]) for _ in range(n)) for n in (3, 10, 30, 60, 200)] + ["ab " + "Q" * 300 + "!" + "q" * 64]
    vectors = np.random.default_rng(2).standard_normal((quality.BUCKETS, quality.DIM)).astype(np.float32)
    got = np.concatenate([quality.pool(t, vectors) for t in quality.tokens(texts)])
    bucket = lambda raw: int(next(quality.tokens([raw.decode()])).bucket[0])
    for text, row in zip(texts, got, strict=True):
        toks = plain_tokens(text)
        if not toks:
            assert not row.any()
            continue
        ids = [bucket(raw) for raw, _ in toks]
        v, n = vectors[ids], len(toks)
        caps = [len(raw) > 1 and all(65 <= b <= 90 for b in raw) for raw, _ in toks]
        again = [i > 0 and ids[i] == ids[i - 1] for i in range(n)]
        rest = [math.log1p(n) / 5, sum(k == 2 for _, k in toks) / n, sum(caps) / n, len(set(ids)) / n**0.9, sum(len(raw) for raw, _ in toks) / n / 5, sum(again) / n]
        assert np.allclose(row, np.concatenate((v.mean(axis=0), v.std(axis=0), rest)), atol=2e-3)


def test_quality_temperature_and_gradient():
    """On rows that one direction splits with noise the network ranks them, and its probabilities are near the shares."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 6)).astype(np.float32)
    true = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(3000) < true).astype(np.int64)
    net = quality.fit(x, y)
    score = net.score(x)
    assert np.abs(score - true).mean() < 0.1
    hidden = np.maximum((x[0] - net.mean) / net.scale @ net.weights[0] + net.weights[1], 0)
    assert math.isclose(score[0], 1 / (1 + math.exp(-float((hidden @ net.weights[2] + net.weights[3]).item()) / net.temperature)), rel_tol=1e-4)


def test_quality_of_repeated_rows_and_null_ids(spark):
    rows = [(i, f"good words number {i} here" if i % 2 else f"!! {i} ?? ##") for i in range(60)] + [(None, "good words"), (None, "good words"), (3, "other text"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    pooled = quality.pooled(docs, quality.word_vectors(docs))
    got = quality.scored(pooled, quality.learn(pooled, labels)).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id is None}) == 1


def test_language_of_repeated_rows(spark, nothing):
    rows = [(1, "the words of a text", "en")] * 5 + [(2, "die Wörter eines Textes", "de")] * 5 + [(None, "the words", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.with_language(docs, language.train(docs)).collect()
    assert len(got) == 12 and {(r.text, r.lang_pred) for r in got} == {("the words of a text", "en"), ("die Wörter eines Textes", "de"), ("the words", "en")}


def test_quality_edge_cases(spark, clashing, cases, nothing):
    vectors = quality.word_vectors(clashing)
    rows = quality.pooled(clashing, vectors)
    labels = spark.createDataFrame([(i, i % 2, "x") for i, _ in cases[5:40]] + [(1, None, "x")], "doc_id long, quality int, features string")
    net = quality.learn(rows, labels)
    got = quality.scored(rows, net).collect()
    assert len(got) == len(cases) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.scored(rows, quality.learn(rows, labels.limit(0))).collect()} == {0.5}
    assert quality.scored(quality.pooled(nothing, quality.word_vectors(nothing)), net).count() == 0


def test_index_vectors_are_summed_over_contexts():
    t = next(quality.tokens(["a b c", "d"]))
    index, out = quality.index_vectors(), np.zeros((quality.BUCKETS, quality.DIM))
    quality.context_sums(t, index, out)
    a, b, c, d = t.bucket
    assert np.allclose(out[a], index[b] + index[c]) and np.allclose(out[b], index[a] + index[c]) and np.allclose(out[d], 0)


@pytest.fixture(scope="module")
def leaks(spark):
    """Documents and items; planted: the pairs that must be found."""
    rng = random.Random(11)
    items = [(100 + i, f"What is the {passage(rng, 22)}? The answer is {passage(rng, 4)}.") for i in range(12)] + [(200, None), (201, "")]
    docs, planted = [(0, None), (1, ""), (2, "  \n ")], set()
    for i in range(3, 80):
        text = passage(rng, rng.randrange(30, 400)).split()
        if i % 4 == 0:
            item_id, item = items[i % 12]
            words = item.split()
            if i % 8 == 0:  # a paraphrase: every seventh word is another
                words = ["whatever" if k % 7 == 3 else w.upper() for k, w in enumerate(words)]
            at = rng.randrange(len(text))
            text[at:at] = words
            planted.add((i, item_id))
        docs.append((i, " ".join(text)))
    long = passage(rng, 20_000).split()
    long[15_000:15_000] = items[3][1].split()
    docs.append((90, " ".join(long)))
    return docs, items, planted | {(90, 103)}


def frames(spark, leaks):
    docs, items, planted = leaks
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, lcs int").repartition(4)
    return d, spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string"), planted


def test_planted_passages_are_found_and_nothing_else(spark, leaks):
    docs, bench, planted = frames(spark, leaks)
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in leaks[0]} - {i for i, _ in planted}


def test_blocks_of_items_give_the_same(spark, leaks, monkeypatch):
    docs, bench, planted = frames(spark, leaks)
    monkeypatch.setattr(decontaminate.read_items, "__defaults__", ("item_id", "text", 60))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == planted


def test_nothing_to_find(spark, leaks, nothing):
    docs, bench, _ = frames(spark, leaks)
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs, bench.where("text is null or text = ''")).count() == 0
    assert decontaminate.contaminated(nothing, bench).count() == 0
    repeated = decontaminate.contaminated(docs.union(docs), bench.union(bench))
    assert repeated.count() == repeated.select("doc_id", "item_id").distinct().count()


def by_the_rule(docs, items):
    """{(doc_id, item_id): (lcs, answer)}: every item against the words around every window."""
    out = {}
    split = lambda t: [w for w in "".join(ch if ch.isalnum() else " " for ch in (t or "").lower()).split()]
    for d, text in docs:
        words = np.asarray(split(text))
        for i, item in items:
            item = np.asarray(split(item))
            for start in range(0, len(words) if len(item) else 0, decontaminate.STRIDE):
                share, answer = decontaminate.holds(item, words[max(0, start - len(item)) : start + 2 * decontaminate.STRIDE + len(item)])
                if share >= decontaminate.LCS or share >= decontaminate.LCS_ANSWER and answer:
                    out[d, i] = max((share, answer), out.get((d, i), (0, False)))
    return out


def test_reworded_passages_are_found_as_by_the_rule(spark):
    """The rarest 20 to 40 % of an item's words are replaced, in documents of frequent words."""
    rng = random.Random(23)
    often = [f"w{i}" for i in range(60)]
    speak = lambda n: [rng.choice(often) if rng.random() < 0.6 else f"r{int(rng.paretovariate(0.4)) % 5000}" for _ in range(n)]
    items = [(i, " ".join(speak(n))) for i, n in enumerate([1, 3, 8, 15, 20, 26, 31, 32, 33, 38, 47, 48, 59, 80, 130])]
    background = [(1000 + i, " ".join(speak(rng.randrange(20, 300)))) for i in range(60)]
    count = {}
    for _, t in background:
        for w in t.split():
            count[w] = count.get(w, 0) + 1
    docs = list(background)
    for share in (0, 20, 30, 35, 40):
        for i, item in items[3:]:
            words = item.split()
            for k in sorted(range(len(words)), key=lambda k: count.get(words[k], 0))[: len(words) * share // 100]:
                words[k] = f"other{rng.randrange(10**6)}"
            text = speak(rng.randrange(10, 200))
            at = rng.randrange(len(text))
            text[at:at] = words
            docs.append((share * 10 + i, " ".join(text)))
    want = by_the_rule(docs, items)
    assert all((share * 10 + i, i) in want for share in (0, 20, 30, 35) for i, _ in items[3:])
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id): (r.lcs, r.answer) for r in got} == want
    assert all(-1.001 <= r.cosine <= 1.001 for r in got)
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench, bound=False).collect()}
    assert found <= set(want) and len(found) >= 0.9 * len(want), (len(found), len(want))


def test_recall_of_the_latent_search(spark):
    """Items with 0 to 40 % of their rarest words replaced, in real documents: at least 0.9 of what the rule finds at all places."""
    rng = random.Random(29)
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    count = Counter(w for _, t in texts for w in t.lower().split())
    long = [t.split() for _, t in texts if t.count(" ") > 150]
    docs = list(texts)
    for share in (0, 20, 30, 40):
        for k, (_, item) in enumerate(items):
            words, text = item.split(), list(rng.choice(long))
            for at in sorted(range(len(words)), key=lambda i: count[words[i].lower()])[: len(words) * share // 100]:
                words[at] = f"other{rng.randrange(10**6)}"
            at = rng.randrange(len(text))
            text[at:at] = words
            docs.append((10**6 + 1000 * share + k, " ".join(text)))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")
    want = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()}
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench, bound=False).collect()}
    assert found <= want and len(want) > 120 and len(found) >= 0.95 * len(want), (len(found), len(want))
    assert all((10**6 + k, i) in want for k, (i, _) in enumerate(items))  # word for word


def test_null_ids_ties_and_equal_rows_of_leaks(spark):
    """Null ids are kept as one, an item that two documents hold is found in both, equal items under two ids are both named."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    docs = [(None, f"some words {item} more"), (None, "nothing of it"), (1, item.upper()), (1, item), (2, item), (3, None)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item long").repartition(3)
    bench = spark.createDataFrame([(7, item), (8, item), (None, item), (9, "")], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.lcs) for r in decontaminate.contaminated(frame, bench).collect()]
    assert sorted(got, key=repr) == sorted(((d, i, 1.0) for d in (None, 1, 2) for i in (7, 8, None)), key=repr)


def test_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for k, y in enumerate(b):
                row[k + 1] = before[k] + 1 if x == y else max(row[k], before[k + 1])
        assert decontaminate.lcs_length(np.asarray(a), np.asarray(b)) == row[-1]


def test_pipeline_against_brute_force(spark, leaks, cases, tmp_path):
    docs, items, planted = leaks
    own = [(i + 1000, t) for i, t in cases]
    every = docs + own
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in every]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = [(i, t) for i, t in every if any(ch.isalpha() for ch in t or "")]
    lines = brute.line_dedup(left)
    left = [(i, lines[i][2]) for i, _ in left]
    left = [(i, dict(left)[i]) for i, _, root in brute.components(left) if i == root]
    left = [(i, t) for i, t in left if i not in {p for p, _ in planted}]
    assert set(got) == {i for i, _ in left}
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    for i, t in left:
        assert bytes(got[i].ids) == np.asarray(enc.encode_ordinary(t), "<u4").tobytes()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_language_stage_scores_each_text_once(spark, docs):
    """One Python node, though the prediction decides which rows stay and what lang becomes."""
    rows = docs.select("*", F.lit("en").alias("lang"), F.lit(1).alias("n_lines"), F.lit("x").alias("found"))
    out = corpus_pipeline.identify_language(spark, rows, SMALL)
    assert out.columns == rows.columns and out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert {r.found for r in out.collect()} == {"x"}


def test_stages_keep_columns_and_stand_odd_rows(spark, leaks, tmp_path):
    """Empty tables, null ids, repeated rows, columns with the operators' names."""
    _, items, _ = leaks
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped int, found string, _in string, _row1 long, doc string, lang_pred string, score int"
    rng = random.Random(3)
    leak, other = items[3][1] + " " + passage(rng, 30), passage(rng, 50)
    rows = [(None, leak, None), (5, items[4][1] + " " + passage(rng, 30), "en"), (5, other, "en"), (5, other, "en"), (None, None, None), (None, passage(rng, 40), None), (6, "", "en"), (7, "12 34", None)]
    docs = spark.createDataFrame([(i, t, k, "s", 1, 2, 3, "f", "i", 4, "d", "l", 5) for i, t, k in rows], names)
    for empty in (True, False):
        out = docs.limit(0) if empty else docs.repartition(3)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns
            out.write.mode("overwrite").parquet(f"{tmp_path}/stage")
            out = spark.createDataFrame(spark.read.parquet(f"{tmp_path}/stage").collect(), out.schema)
        left = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
        assert left == ([] if empty else sorted([(5, other), (None, rows[5][1])], key=repr))
        assert {(r.n_lines, r.n_dropped, r.found, r["_in"], r["_row1"], r.doc, r.lang_pred, r.score) for r in out.collect()} == (set() if empty else {(2, 3, "f", "i", 4, "d", "l", 5)})
        assert corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).count() == len(left)


def test_near_copies_leave_one_row_of_each_group(spark):
    """Repeated rows, repeated ids and null ids."""
    rng = random.Random(31)
    a, b, c, d, e, f = (passage(rng, 60) for _ in range(6))
    near = a + " more"
    rows = [
        (1, a, "en"), (1, a, "en"), (1, a, "en"),  # equal in every column: one stays
        (2, near, "en"), (2, b, "en"),  # a near copy goes, the other row with its id stays
        (None, c, "en"), (None, c, "en"), (None, c + " more", "en"),  # without any id
        (None, d, "en"), (9, d + " more", "en"),  # an id comes before none
        (5, e, "en"), (5, e, "de"),  # near copies that differ elsewhere only
        (6, "", "en"), (6, "", "en"), (6, "", "de"), (7, None, "en"), (7, None, "en"), (None, " ", "en"), (8, " ", "en"),  # without words
        (10, f, "en"),
    ]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.keep_one_of_near_copies(spark, docs, SMALL)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text, r.lang) for r in out.collect()]
    words = [g for g in got if (g[1] or "").strip()]
    groups = {t: i for i, text in enumerate((a, b, c, d, e, f)) for t in (text, text + " more")}
    assert sorted(groups[t] for _, t, _ in words) == [0, 1, 2, 3, 4, 5]
    assert {(i, groups[t]) for i, t, _ in words} == {(1, 0), (2, 1), (None, 2), (9, 3), (5, 4), (10, 5)}
    assert sorted((g for g in got if g not in words), key=repr) == sorted([(6, "", "en"), (6, "", "de"), (7, None, "en"), (None, " ", "en"), (8, " ", "en")], key=repr)
