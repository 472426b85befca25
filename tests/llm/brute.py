"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return [w for w in SPACE.split((text or "").encode()) if w]


def substring_dedup(docs: list[tuple[int | None, str | None]], window: int = 50):
    """{row: (n_words, n_removed, kept text)}."""
    toks = [words(t) for _, t in docs]
    least: dict[tuple, int] = {}
    for (i, _), w in zip(docs, toks):
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, toks):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text: str | None) -> int:
    import xxhash
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    shingles = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash_components(docs: list[tuple[int, str | None]], bits: int = 2):
    fps = np.array([fingerprint(t) for _, t in docs], np.uint64)
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    order = sorted(range(len(docs)), key=lambda k: docs[k][0])
    rank = {k: r for r, k in enumerate(order)}
    for a in range(len(docs)):
        for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= bits):
            x, y = find(a), find(int(b))
            if rank[x] < rank[y]:
                root[y] = x
            elif rank[y] < rank[x]:
                root[x] = y
    return [(i, f"{int(f):016x}", docs[find(k)][0]) for k, ((i, _), f) in enumerate(zip(docs, fps))]


def token_ids(path: str, texts: list[str | None], end: int) -> list[np.ndarray]:
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    return [np.array(e.ids + [end], np.uint32)
            for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def equal_texts(docs: list[tuple[int | None, str | None]]):
    """Sorted (doc_id, keep_id, group_size, kept, sha) by plain grouping."""
    norm = [SPACE.sub(b" ", (t or "").encode()) for _, t in docs]
    groups: dict[bytes, list[int]] = {}
    for k, x in enumerate(norm):
        groups.setdefault(x, []).append(k)
    out = []
    for k, x in enumerate(norm):
        own = sorted(groups[x], key=lambda j: (docs[j][0] is None, docs[j][0] or 0, j))
        out.append((docs[k][0], docs[own[0]][0], len(own), k == own[0], hashlib.sha256(x).hexdigest()))
    return out


def kneser_ney(train: list[str], score: list[str], order: int, symbols: int) -> list[tuple[float, int]]:
    """(negative log probability, characters) of each text by a plain
    interpolated modified Kneser-Ney model over characters."""
    import math
    from collections import Counter, defaultdict

    pad = "\x02" * (order - 1)

    def grams(t):
        x = pad + " ".join(t.split())
        return [x[k - order + 1:k + 1] for k in range(order - 1, len(x))]

    counts = {order: Counter(g for t in train for g in grams(t))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut, contexts = {}, {}
    for n, c in counts.items():
        of = Counter(v for v in c.values() if v <= 4)
        y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else None
        if y is None:
            d = (0.5, 0.75, 0.9)
        else:
            d = [k - (k + 1) * y * of[k + 1] / of[k] if of[k] else k * 0.5 for k in (1, 2, 3)]
            d = [min(max(x, 0.01), k - 0.01) for k, x in zip((1, 2, 3), d)]
        cut[n] = d
        total = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            total[g[:-1]][0] += v
            total[g[:-1]][1] += d[min(v, 3) - 1]
        contexts[n] = total

    def p(g):
        if not g:
            return 1.0 / symbols
        n = len(g)
        below = p(g[1:])
        if g[:-1] not in contexts[n]:
            return below
        total, spared = contexts[n][g[:-1]]
        c = counts[n].get(g, 0)
        return (max(c - cut[n][min(c, 3) - 1], 0) if c else 0) / total + spared / total * below

    return [(-sum(math.log(p(g)) for g in grams(t)), len(grams(t))) for t in score]


def maximal_conversations(rows):
    """{conv_id: turns} of the conversations that no longer one begins with;
    of equal ones the smallest id."""
    by: dict[int, set] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, set()).add((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    keep = {}
    for c, t in sorted(turns.items()):
        longer = any(len(u) > len(t) and u[:len(t)] == t for u in turns.values())
        if not longer and t not in keep.values():
            keep[c] = t
    return keep
