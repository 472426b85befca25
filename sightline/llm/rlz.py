"""Substring deduplication by relative Lempel-Ziv factors.

Every document is parsed against one reference: the blocks of all documents
with a smaller id, each with the place of its first occurrence. A document is
factored greedily: its blocks are walked in order, and a factor goes on while
the next block's place in the reference follows on the last one's. A factor is
thus a run of words that one earlier document has too; those of at least
``window`` words, which all factors of whole blocks are, become duplicate
spans. The index of the reference is distributed and addressed by content:

* A block is cut where the content says so. Each window of ``window`` words
  has one anchor, its word k-gram of smallest hash (the leftmost, if tied).
  Consecutive windows with one anchor position form a block: the words from
  the first window's start to the last one's end. Equal windows have equal
  anchors wherever they stand, so no alignment is needed.
* The index holds every block of every document under (anchor, block), with
  the smallest id that has it. It is combined before the shuffle, so a
  passage shared by many documents is one entry.
* A document's blocks are looked up in the index, and the known ones form
  factors in the order of their positions (``factors``).
* At a factor's boundary a block is not known as a whole, but blocks with the
  same anchor may share a part of it; there each window is looked up by its
  own content among the windows of those blocks.

Blocks and windows are compared by 128 bits of hashes over their words; the
words themselves are hashed from their bytes. The result is exact but for
collisions of that size. No list of the documents that share a block is ever
built, and no pairs of documents either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_offsets, saved, slices, text_column, unique_ids

#: Words that must repeat, and words in the k-grams that serve as anchors.
WINDOW, GRAM = 50, 6

_U = np.uint64
_POS = 28  # bits for a position within a batch slice


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1 << 62, 1 << 63)) * 2 + 1


_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).view(_U)
_BASES = _odd(11), _odd(12), _odd(13)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for later batches."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 18)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = tuple(out)
        for old in [k for k in _POWERS if len(_POWERS[k][0]) > 1 << 21 and k != base]:
            del _POWERS[old]  # a very long text's tables are not kept
    return have[0], have[1]


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Ranges:
    """Hashes of ranges of an array of 64-bit values, by prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        p, self.inverse = _powers(base, len(values) + 1)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * p[:len(values)], dtype=_U)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(_U))


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and the first word of each text (n + 1).
    ``data`` are the bytes, ``offsets`` where each text starts and ends.
    Works in segments, cut between words, to bound the memory."""
    hashes, starts_at = [], []
    lo, end = int(offsets[0]), int(offsets[-1])
    cuts = offsets[:-1][np.diff(offsets) > 0]
    while lo < end:
        hi = min(end, lo + (1 << 19))
        if hi < end and not np.isin(hi, cuts):
            gap = np.flatnonzero(_SPACE[data[lo:hi]])
            hi = lo + int(gap[-1]) + 1 if len(gap) else end  # a word longer than a segment takes the rest
        part = data[lo:hi]
        word = ~_SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inside = cuts[np.searchsorted(cuts, lo):np.searchsorted(cuts, hi)] - lo
        first[inside] = word[inside]
        s = np.flatnonzero(first)
        last = word.copy()
        last[:-1] &= ~word[1:] | first[1:]
        e = np.flatnonzero(last) + 1
        hashes.append(Ranges(_BYTE[part], _BASES[0])(s, e))
        starts_at.append(s + lo)
        lo = hi
    at = np.concatenate(starts_at) if starts_at else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    return h, np.searchsorted(at, offsets)


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive keys, from running minima within
    blocks of that width, forwards and backwards."""
    n = len(keys) - width + 1
    pad = -len(keys) % width
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(_U).max, _U)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def blocks_of(h: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Blocks of a slice of documents: document index, first window and number
    of windows (as word positions in the document), anchor and block hash."""
    if len(h) < window:
        return [np.zeros(0, np.int64)] * 5
    grams = Ranges(h, _BASES[1])
    at = np.arange(len(h) - gram + 1)
    key = grams(at, at + gram)
    mask = _U((1 << _POS) - 1)
    anchor = (_window_min(key & ~mask | at.astype(_U), window - gram + 1) & mask).astype(np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[:len(anchor)]
    start = np.arange(len(anchor))
    ok = start + window <= first[doc + 1]
    start, anchor, doc = start[ok], anchor[ok], doc[ok]
    if not len(start):
        return [np.zeros(0, np.int64)] * 5
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(new)
    n = np.diff(np.append(lo, len(start)))
    begin = start[lo]
    block = Ranges(h, _BASES[2])(begin, begin + n + window - 1)
    return doc[lo], begin - first[doc[lo]], n, key[anchor[lo]].view(np.int64), block.view(np.int64)


def _per_slice(batches: Iterator[pa.RecordBatch], text_at: int):
    """(batch, i, j, word hashes, first words) for slices of rows i to j."""
    for b in batches:
        col = text_column(b, text_at)
        off, data = byte_offsets(col)
        for i, j in slices(col, 1 << 20):
            yield b, i, j, *word_hashes(data, off[i:j + 1])


def _keys(b: pa.RecordBatch, k: int, i: int, j: int, at: np.ndarray) -> list[pa.Array]:
    """The first ``k`` columns of rows i to j, at the given places of these."""
    return [b.column(c).slice(i, j - i).take(pa.array(at, pa.int64())) for c in range(k)]


def _with_id(df: DataFrame) -> DataFrame:
    """Where rows are numbered by their own id, ``row`` is it."""
    return df if "id" in df.columns else df.withColumn("id", F.col("row"))


def document_blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """row (and id, if ``docs`` has one), lo, n, anchor, block of every block
    of every document. ``docs``: row, [id], text."""
    keys = docs.columns[:-1]
    k = len(keys)
    names = [*keys, "lo", "n", "anchor", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, h, first in _per_slice(batches, k):
            doc, lo, n, anchor, block = blocks_of(h, first, window, gram)
            yield pa.RecordBatch.from_arrays(
                [*_keys(b, k, i, j, doc), pa.array(lo, pa.int32()), pa.array(n, pa.int32()),
                 pa.array(anchor, pa.int64()), pa.array(block, pa.int64())], names)

    kinds = ", ".join(f"{c} long" for c in keys)
    return docs.mapInArrow(run, f"{kinds}, lo int, n int, anchor long, block long")


def _runs(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, n) of a column of lists of structs lo, n."""
    rows = np.repeat(np.arange(len(col)), np.asarray(col.value_lengths().fill_null(0), np.int64))
    flat = col.flatten()
    return rows, np.asarray(flat.field(0), np.int64), np.asarray(flat.field(1), np.int64)


def _windows(docs_with_runs: DataFrame, window: int) -> DataFrame:
    """row, [id], pos, h1, h2 of every window in the runs of a document.
    The input: row, [id], text, runs."""
    keys = docs_with_runs.columns[:-2]
    k = len(keys)
    names = [*keys, "pos", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, h, first in _per_slice(batches, k):
            row, lo, n = _runs(b.column(k + 1).slice(i, j - i))
            before = np.cumsum(n) - n
            pos = np.repeat(lo - before, n) + np.arange(int(n.sum()))
            row = np.repeat(row, n)
            at = first[row] + pos
            hs = [Ranges(h, base)(at, at + window).view(np.int64) for base in _BASES[1:]]
            yield pa.RecordBatch.from_arrays(
                [*_keys(b, k, i, j, row), pa.array(pos, pa.int32()), *(pa.array(x, pa.int64()) for x in hs)], names)

    kinds = ", ".join(f"{c} long" for c in keys)
    return docs_with_runs.mapInArrow(run, f"{kinds}, pos int, h1 long, h2 long")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _without(text: bytes, spans: list[list[int]], layout: bool) -> tuple[int, bytes]:
    """Number of words, and the text without the spans: with its own white
    space (``layout``) or with one space between words."""
    if not layout:
        words = text.split()
        n = len(words)
        for lo, hi in reversed(spans):
            del words[lo:hi]
        return n, b" ".join(words)
    if not spans:
        return len(text.split()), text
    at = [m.span() for m in _WORD.finditer(text)]
    out, lo = [], 0
    for a, z in [*spans, [len(at), len(at)]]:
        if lo < a:
            # The kept words from lo to a, after the white space before them.
            out.append(text[at[lo - 1][1] if lo and out else at[lo][0]:at[a - 1][1]])
        lo = z
    return len(at), b"".join(out)


def _cut(docs_with_spans: DataFrame, window: int, layout: bool) -> DataFrame:
    """Remove the words under the spans (lo, n: windows that start at lo and
    the n - 1 words after it). The input: row, carried, text, runs."""
    carried = docs_with_spans.schema["carried"].dataType.simpleString()
    kind = (f"row bigint, carried {carried}, n_words bigint, n_removed bigint, text string, "
            "spans array<struct<start:int,end:int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_column(b, 2).cast(pa.large_binary())
            lists = b.column(3)
            out = [[], [], [], []]
            for k in range(len(texts)):
                merged: list[list[int]] = []
                for lo, hi in sorted((r["lo"], r["lo"] + r["n"] + window - 1) for r in lists[k].as_py() or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                n, kept = _without(texts[k].as_py(), merged, layout)
                out[0].append(n)
                out[1].append(sum(hi - lo for lo, hi in merged))
                out[2].append(kept)
                out[3].append([{"start": lo, "end": hi} for lo, hi in merged])
            spans = pa.array(out[3], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.binary()).cast(pa.string()), spans],
                ["row", "carried", "n_words", "n_removed", "text", "spans"])

    return docs_with_spans.mapInArrow(run, kind)


def factors(known: DataFrame) -> DataFrame:
    """The greedy parse of each document's known blocks (row, lo, n, least,
    at): a factor goes on while the next block follows on the last in the
    document and in the reference. Returns row, lo, n (windows), source (the
    id it comes from) and at (where there)."""
    by = W.partitionBy("row").orderBy("lo")
    last = F.lag(F.struct("lo", "n", "least", "at")).over(by)
    goes_on = ((F.col("lo") == F.col("last.lo") + F.col("last.n")) & (F.col("least") == F.col("last.least"))
               & (F.col("at") == F.col("last.at") + F.col("last.n")))
    number = F.sum(F.when(goes_on, 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0))
    return (known.withColumn("last", last).withColumn("factor", number).groupBy("row", "factor")
            .agg(F.min("lo").alias("lo"), F.sum("n").cast("int").alias("n"), F.min("least").alias("source"), F.min("at").alias("at"))
            .drop("factor"))


def document_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     gram: int = GRAM) -> DataFrame:
    """The factors of whole blocks of every document: doc_id, start and words
    (in its words), source_id and source_start (where an earlier document has
    them). Ids must be unique and not null."""
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    known = _parsed(_with_id(saved(document_blocks(rows.filter(F.col("text").isNotNull()), window, gram), "blocks"))).filter("known")
    return factors(known).select(F.col("row").alias("doc_id"), F.col("lo").alias("start"), (F.col("n") + window - 1).alias("words"),
                                 F.col("source").alias("source_id"), F.col("at").alias("source_start"))


def _parsed(found: DataFrame) -> DataFrame:
    """Blocks that are known of a smaller id (``known``: least, at) or may
    share a part with others (variants > 1)."""
    # The index, and which anchors more than one document has.
    index = found.groupBy("anchor", "block").agg(F.min("id").alias("least"), F.min_by("lo", "id").alias("at"), F.max("id").alias("most"))
    anchors = (index.groupBy("anchor")
               .agg(F.count(F.lit(1)).alias("variants"), F.min("least").alias("a"), F.max("most").alias("z"))
               .filter("a < z").select(F.col("anchor").alias("shared"), "variants"))
    index = saved(index.join(anchors, index["anchor"] == anchors["shared"])
                  .select("anchor", "block", "least", "at", "variants"), "shared-blocks")
    parsed = (found.join(index, ["anchor", "block"])
              .select("row", "lo", "n", (F.col("least") < F.col("id")).alias("known"), "variants", "least", "at")
              .filter("known or variants > 1"))
    return saved(parsed, "parsed")


def duplicate_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(row, runs): per document, the runs of windows (lo, n) whose words also
    start in a document with a smaller id. ``docs``: row (unique), id (only if
    it is not the row number itself), text."""
    keys = docs.columns[:-1]
    found = _with_id(saved(document_blocks(docs.filter(F.col("text").isNotNull()), window, gram), "blocks"))
    parsed = _parsed(found)
    whole = factors(parsed.filter("known"))
    # Boundary blocks, one of each content: its windows are both asked for and indexed.
    edge = (parsed.filter("not known").groupBy("row")
            .agg(F.collect_list(F.struct("lo", "n")).alias("runs")))
    edges = docs.join(edge.hint("shuffle_hash"), "row").select(*keys, "text", "runs")
    windows = _with_id(saved(_windows(edges, window), "boundary-windows"))
    first = (windows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most"))
             .filter("least < most").select("h1", "h2", "least"))
    part = (windows.join(first, ["h1", "h2"]).filter("least < id")
            .select("row", F.col("pos").alias("lo"), F.lit(1).alias("n")))
    return whole.select("row", "lo", "n").unionAll(part).groupBy("row").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     gram: int = GRAM, layout: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, text (the kept words
    joined by one space; with ``layout`` the text's own white space stays),
    spans (removed word ranges, end exclusive) and carried (a struct of all
    input columns but the text).

    A word goes if a window of ``window`` consecutive words of its document
    covers it whose words also start in a document with a smaller id; windows
    are judged on the input. Words are separated by ASCII white space. Null
    text has no words; texts shorter than a window lose nothing; rows with one
    id do not count as smaller than each other; rows with a null id lose
    nothing and are no reference. Extra columns are only carried, so their
    names cannot clash. Empty table: empty result.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows, key = unique_ids(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                                       rest.alias("carried")))
    own = [] if key == "doc_id" else [F.col("doc_id").alias("id")]
    runs = duplicate_runs(rows.select(F.col(key).alias("row"), *own, "text"), window, gram)
    work = rows.select(F.col(key).alias("row"), "carried", "text")
    cut = _cut(work.join(runs.hint("shuffle_hash"), "row", "left").select("row", "carried", "text", "runs"), window, layout)
    return cut.select(F.col(f"carried.`{id_col}`").cast("long").alias("doc_id"), "n_words", "n_removed", "text", "spans",
                      "carried")


def cut_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with repeated passages cut out of the text and its length
    counted again; documents of which nothing is left go. A text that loses
    nothing stays as it is, null or not."""
    cut = dedup_substrings(docs, text_col=text_col, layout=True, **options)
    cut = cut.filter("n_removed < n_words or n_removed = 0")
    length = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col(f"carried.`{length_col}`"))
    return cut.select(*[F.col("text").alias(c) if c == text_col else
                        length.cast(docs.schema[c].dataType).alias(c) if c == length_col else
                        F.col(f"carried.`{c}`").alias(c) for c in docs.columns])
