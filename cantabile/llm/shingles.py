"""Word shingles of whole texts as sorted sets of 64-bit hashes, with numpy over UTF-8 bytes.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A set holds the distinct
runs of `k` words; a text with fewer words, but at least one, holds its whole sequence as one. Two
different shingles share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

K = 5
#: Bytes hashed at a time. Longer texts are cut between words.
PIECE = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[0x41:0x5B] += np.uint64(32)
_CUT = re.compile(rb"[\x20\x09-\x0D]")
#: For word_hashes: only letters, digits and bytes beyond ASCII make words, so punctuation doesn't tell words apart.
PLAIN = np.asarray([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = powers(_BASE, PIECE + 1)
_INV = powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), PIECE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(raw: bytes, white: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of at most PIECE bytes (longer words are hashed by themselves)."""
    buf = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], ~white[buf], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(buf) > PIECE:  # a run without white space, longer than a piece, is one word
        total = np.uint64(len(buf))
        for i in range(0, len(buf), PIECE):
            part = _LOWER[buf[i : i + PIECE]]
            total = mix(np.asarray([total ^ (part * _POW[: len(part)]).sum(dtype=np.uint64)]))[0]
        return np.asarray([total]), starts[:1]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[buf] * _POW[: len(buf)], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * _INV[starts]), starts


def word_hashes(texts: Iterable[str | None], white: np.ndarray = _WHITE) -> list[np.ndarray]:
    """For each text the hashes of its words, in order. white: which bytes separate words; ASCII white space must."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            hashes, starts = _hash_words(b" ".join(held), white)
            offsets = np.cumsum([0, *(len(x) + 1 for x in held)])
            out.extend(np.split(hashes, np.searchsorted(starts, offsets[1:-1])))
            held.clear()
            size = 0

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) >= PIECE:
            flush()
            out.append(_long(raw, white))
        else:
            if size + len(raw) + 1 > PIECE:
                flush()
            held.append(raw)
            size += len(raw) + 1
    flush()
    return out


def _long(raw: bytes, white: np.ndarray) -> np.ndarray:
    parts, start = [], 0
    while start < len(raw):
        stop = start + PIECE
        if stop >= len(raw):
            stop = len(raw)
        else:
            # back to the last white space of the piece, or on to the next if a word fills it
            back = max((raw.rfind(c, start, stop) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
            ahead = _CUT.search(raw, stop) if back <= start else None
            stop = back if back > start else ahead.start() if ahead else len(raw)
        parts.append(_hash_words(raw[start:stop].strip(b" \t\n\x0b\x0c\r") if stop - start > PIECE else raw[start:stop], white)[0])
        start = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the shingles in order, repeats included."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    total = np.full(n - width + 1, np.uint64(width if n < k else 0), np.uint64)
    for j in range(width):
        total = (total + words[j : n - width + 1 + j]) * _POW[3 * j + 1]
    return mix(total)


def shingle_sets(texts: Iterable[str | None], k: int = K) -> list[np.ndarray]:
    """For each text the sorted distinct shingle hashes."""
    out = []
    for words in word_hashes(texts):
        h = np.sort(shingle_hashes(words, k))
        out.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
