"""What the operators must return, in plain Python, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def crc_fold(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


def exact_groups(docs):
    """docs: (doc_id, text) with distinct ids."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(LOWER)].append(i)
    return sorted((i, max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g)


def line_dedup(docs):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    shared = {k: min(h) for k, h in holders.items() if len(k) >= 10 and len(h) >= 2}
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if shared.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(docs, percent=80):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def byte_shards(docs, n=16):
    sizes = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    total, before, slots, out = sum(s for _, s, _ in sizes), 0, defaultdict(int), []
    for i, size, crc in sizes:
        shard = (2 * before + size) * n // (2 * total)
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


def warc(pages):
    first = {}
    for i, html in sorted(pages):
        first.setdefault(html or "", i)
    out = []
    for i, html in sorted(pages):
        payload = (html or "").encode()
        again = len(payload) >= 100 and first[html or ""] != i
        out.append((i, len(payload), sha(payload), "revisit" if again else "response", first[html] if again else None))
    return out
