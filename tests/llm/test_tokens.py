"""BPE, token files and WARC: equality with the libraries, exact round trips, random access, broken archives."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cantabile.llm import bpe, token_files, warc
from tests.llm import brute

LETTERS = st.text(alphabet=st.sampled_from(list("ab1 .'\n\t\r  é日😀s")), max_size=60)


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes_equal_the_library(clashing, cases, own):
    got = {r.doc_id: r for r in bpe.digests(clashing).collect()}
    assert len(got) == len(cases)
    for i, text in cases:
        ids = own.encode_ordinary(text or "")
        raw = np.asarray(ids, "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), brute.sha(text or ""))


def test_ids_of_repeated_rows_and_null_ids(spark, nothing):
    rows = [(None, "a text"), (None, "a text"), (1, "a text"), (1, None), (None, None)]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and len({(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got}) == 2 and sum(r.doc_id is None for r in got) == 3
    assert bpe.digests(nothing).count() == 0


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_cutting_at_safe_boundaries_changes_nothing(text):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    assert "".join(bpe.spans(text, 3)) == text
    assert bpe.encode_text(enc, text, 3) == np.asarray(enc.encode_ordinary(text), "<u4").tobytes()


def test_bpe_of_nothing(nothing):
    assert bpe.digests(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(LETTERS)
def test_remembered_pieces_give_the_tokenizers_ids(text):
    path = public_tokenizers.path(token_files.VOCABULARY)
    assert token_files.tokenize([text], path)[0].tolist() == token_files.tokenizer(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip_and_slices(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == (1001 * bits + 7) // 8
    for a, b in ((0, 1001), (0, 0), (1000, 1001), (17, 503), (8, 9)):
        assert (token_files.unpack(packed, bits, a, b) == ids[a:b]).all()


def test_token_files(spark, clashing, cases, tmp_path, nothing):
    token_files.write_tokens(clashing, f"{tmp_path}/t", block=500)
    got = {r.doc_id: r for r in token_files.read_tokens(spark, f"{tmp_path}/t").collect()}
    t, start, every = token_files.tokenizer(public_tokenizers.path(token_files.VOCABULARY)), 0, []
    for i, text in sorted(cases):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (start, len(ids), np.asarray(ids, "<u4").tobytes())
        start += len(ids)
        every += ids
    files = spark.read.parquet(f"{tmp_path}/t")
    assert files.select("bits").distinct().first().bits == 16
    rng = random.Random(3)
    for a in [0, start - 5, *(rng.randrange(start) for _ in range(4))]:
        assert token_files.random_ids(files, a, a + 5).tolist() == every[a : a + 5]
    token_files.write_tokens(nothing, f"{tmp_path}/n")
    assert token_files.read_tokens(spark, f"{tmp_path}/n").count() == 0


def test_token_files_of_repeated_and_null_ids(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (3, "c d"), (1, None)], "doc_id long, text string")
    token_files.write_tokens(rows, f"{tmp_path}/t")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_tokens(spark, f"{tmp_path}/t").collect())
    assert [g[:2] for g in got[:3]] == [(0, None), (2, 1), (3, 3)] and [g[1] for g in got[3:]] == [3, 3]
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 400_000 + "</p>"
    pages = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 99), (5, "y" * 100), (6, "y" * 100), (7, "é" * 50), (8, "é" * 50), (9, long), (10, long), (11, "\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y", h, "clash") for i, h in pages], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.round_trip(df, f"{tmp_path}/w").cache()
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(tuple(r) for r in got.select(cols).collect()) == brute.warc(pages)
    for r in got.where("record_type = 'response'").collect():
        assert bytes(r.payload).decode() == (dict(pages)[r.page_id] or "")


def test_warc_of_repeated_rows_null_ids_and_nothing(spark, tmp_path):
    text = "z" * 200
    df = spark.createDataFrame([(1, "u", text), (1, "u", text), (1, "v", text), (None, "u", text), (None, None, None)], "page_id long, url string, html string")
    got = warc.round_trip(df, f"{tmp_path}/w").collect()
    assert len(got) == 5
    same = [r for r in got if r.payload_bytes == 200]
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in same) == [(0, "revisit", 1), (1, "response", None), (1, "revisit", 1), (1, "revisit", 1)]
    assert [bytes(r.payload).decode() for r in same if r.record_type == "response"] == [text]
    assert warc.round_trip(df.limit(0), f"{tmp_path}/n").count() == 0
    hot = spark.createDataFrame([(i // 2, "u", text) for i in range(4, 400)] + [(None, "u", text + "a")] * 7, "page_id long, url string, html string").repartition(5)
    got = warc.round_trip(hot, f"{tmp_path}/h").groupBy("payload_bytes", "record_type", "refers_to").count().collect()
    assert sorted(((r[0], r[1], r[2] or 0, r[3]) for r in got)) == [(200, "response", 0, 1), (200, "revisit", 2, 395), (201, "response", 0, 1), (201, "revisit", 0, 6)]


def test_broken_archives_are_refused():
    payload = b"hello" * 50
    good = warc.record("response", "1", "u", payload, hashlib.sha256(payload).hexdigest(), len(payload), None)
    assert [warc.parse(m)["payload"] for m in warc.members([good[:9], good[9:] + good])] == [payload, payload]
    with pytest.raises(warc.BadRecord):
        list(warc.members([good[:-4]]))
    raw = gzip.decompress(good)
    for bad in (raw.replace(b"hello", b"hullo", 1), raw.replace(b"Content-Length: 3", b"Content-Length: 2", 1), raw[:-2], b"nothing"):
        with pytest.raises(warc.BadRecord):
            warc.parse(bad)
    with pytest.raises(warc.BadRecord):
        list(warc.members([zlib.compress(b"x")]))
