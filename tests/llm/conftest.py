import random

import pytest

WORDS = [a + b + c for a in ("ba", "le", "mi", "so", "tu", "ra", "ke") for b in ("n", "st", "rv", "lo") for c in ("er", "on", "ia", "um", "e")]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def cases():
    """(doc_id, text) with the cases that every operator must stand: nulls, nothing, white space, very long, copies, shared lines."""
    rng = random.Random(7)
    shared = [f"A shared line number {i} of many documents" for i in range(4)]
    docs = [(1, None), (2, ""), (3, "   \n\t \x0b"), (4, "word"), (5, "123 456 !!"), (6, "two\r\nlines\r\n"), (7, "naïve Überfluß \U0001f600 日本語 текст")]
    for i in range(8, 40):
        lines = [passage(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 6))]
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared))
        docs.append((i, "\n".join(lines)))
    base = passage(rng, 120)
    for i in range(40, 52):  # near copies around the threshold
        words = base.split()
        for _ in range(i - 40):
            words[rng.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words)))
    docs += [(i, "An Exact COPY of a short text") for i in range(60, 64)]
    docs += [(64, "an exact copy of a short text"), (65, passage(rng, 30_000)), (66, "x" * 300_000), (67, "  A SHARED line number 0 of many documents\t\nshort\nshort")]
    return docs


@pytest.fixture(scope="session")
def docs(spark, cases):
    return spark.createDataFrame(cases, "doc_id long, text string").repartition(5).cache()


#: Columns whose names the operators use themselves.
CLASHING = ["size", "shard", "slot", "n_lines", "n_dropped", "keep_id", "kept", "_text", "_row1", "_row2", "_lines", "_in", "_drop", "n", "sid", "token", "features", "ids", "start", "part", "payload", "digest", "component_id"]


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(-1).alias(c) for c in CLASHING))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
