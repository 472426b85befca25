"""Byte-level BPE by a segment tree of pair ranks.

A piece of text is a row of symbols, at first its bytes. Leaf i of the tree
holds the rank of the pair that starts at symbol i, and every inner node the
leftmost minimum of its children, so that the root names the next merge. A
merge changes three leaves: the merged pair's own, its left live neighbour's
and that of the symbol swallowed. Each is a point update of a logarithmic
number of nodes; live neighbours are kept in a doubly linked list.

Pieces are the matches of the vocabulary's pattern. A worker keeps the ids of
pieces it has met, up to a fixed number.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fs_of, slices, text_column

#: Pieces whose ids a worker keeps.
KEPT_PIECES = 400_000


class SegmentTreeBPE:
    """Encodes pieces by merge ranks {bytes: id}; ids decode to their bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.none = max(ranks.values(), default=0) + 1  # greater than any rank
        self.bytes_of = {i: b for b, i in ranks.items()}

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank, leftmost if tied, is
        merged until no pair has a rank."""
        ranks, none = self.ranks, self.none
        n = len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if n < 2:
            return [ranks[piece]] if n else []
        size = 1 << (n - 2).bit_length()  # n - 1 pairs
        # Symbol i spans piece[i:end[i]]; left[i] is the live symbol before it.
        end = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = ranks.get(piece[i:i + 2], none)
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b

        def put(i: int, rank: int) -> None:
            k = size + i
            tree[k] = rank
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a <= b else b
                if tree[k] == low:
                    return
                tree[k] = low

        while tree[1] < none:
            low, k = tree[1], 1
            while k < size:  # down to the leftmost leaf with the minimum
                k *= 2
                if tree[k] != low:
                    k += 1
            i = k - size
            j = end[i]  # the right symbol, swallowed
            end[i] = stop = end[j]
            if stop < n:
                left[stop] = i
            put(j, none) if j < size else None
            put(i, ranks.get(piece[i:end[stop]], none) if stop < n else none)
            h = left[i]
            if h >= 0:
                put(h, ranks.get(piece[h:stop], none))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    fs, name = fs_of(path)
    with fs.open_input_file(name) as f:
        lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class TextEncoder:
    """Texts to ids through pieces. ``pattern`` is for the ``regex`` module."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.bpe, self.find = SegmentTreeBPE(load_ranks(path)), regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as bytes of uint32. Text that no match covers gives no ids."""
        pieces, kept = self.find(text), self.kept
        out = list(map(kept.get, pieces))
        if None in out:
            if len(kept) > KEPT_PIECES:
                self.kept = kept = {}
            for k, v in enumerate(out):
                if v is None:
                    p = pieces[k]
                    v = kept.get(p)
                    if v is None:
                        v = kept[p] = np.array(self.bpe.encode(p.encode("utf-8", "surrogatepass")), np.uint32).tobytes()
                    out[k] = v
        return b"".join(out)


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def _encoder(path: str, pattern: str) -> TextEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TextEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ids (array of int).

    Null text counts as empty and gives no ids. Special tokens are ordinary
    text. Ids of documents are passed through, null or repeated. Empty table:
    empty result. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, pattern)
        for b in batches:
            texts = text_column(b, 1)
            for i, j in slices(texts):
                rows = [enc.encode(t) for t in texts.slice(i, j - i).to_pylist()]
                ends = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(rows), np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, flat)],
                                                 ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(rows: DataFrame, vocabulary: str) -> DataFrame:
    """``rows`` (doc_id, ids) with ``decoded`` (binary). An id that the
    vocabulary lacks is an error; null ids decode to null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(vocabulary)
        # Bytes of all ids end to end: a document is gathered in one step.
        size = max(ranks.values(), default=-1) + 1
        by_id = [b""] * size
        known = np.zeros(size, bool)
        for b, i in ranks.items():
            by_id[i], known[i] = b, True
        n = np.fromiter(map(len, by_id), np.int64, size)
        first, pool = np.cumsum(n) - n, np.frombuffer(b"".join(by_id), np.uint8)
        for b in batches:
            lists = b.column(1)
            for i in range(0, b.num_rows, 256):
                part = lists.slice(i, 256)
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= size or not known[ids].all()):
                    raise ValueError("an id that the vocabulary lacks")
                m = n[ids]
                before = np.cumsum(m) - m
                data = pool[np.repeat(first[ids] - before, m) + np.arange(int(m.sum()))].tobytes()
                counts = np.asarray(part.value_lengths().fill_null(0), np.int64)
                ends = np.concatenate([[0], np.cumsum(m)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
                null = part.is_null().to_pylist()
                out = [None if x else data[a:z] for x, a, z in zip(null, ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), part, pa.array(out, pa.binary())],
                                                 ["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
