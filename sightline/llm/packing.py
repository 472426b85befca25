"""Bounded-space online packing of documents into fixed-length sequences.

Each partition keeps a fixed number of open windows. A document gives whole
windows as long as it can; its rest goes to the open window that it fits best
(least room left). When it fits none and all windows are open, the fullest is
topped up with the rest's head and emitted, and what remains goes on. The
windows still open at the end are merged over all partitions: their pieces,
in order, are one stream of ids cut every ``length`` ids; the last cut's
remainder becomes sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import slices, text_column
from .tokens import SLICE, tokenizer

#: Ids in a sequence and open windows in a partition.
LENGTH, OPEN = 4096, 16

_PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, part int, "
           "window long, offset long, at long, closed boolean")
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


class OnlinePacker:
    """The open windows of one partition. ``add`` takes a document as an array
    of ids; ``closed`` holds pieces of emitted windows until they are taken,
    ``rest`` gives those of the windows left open."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN):
        self.length, self.windows = length, windows
        self.emitted = 0
        self.open: list[list] = []  # ids in it, its pieces
        self.closed: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        self.closed += [(*p, self.emitted) for p in pieces]
        self.emitted += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0

        def piece(n: int, offset: int) -> tuple:
            return doc_id, start, n, ids[start:start + n].astype("<u4").tobytes(), total, offset

        while total - start >= self.length:
            self._emit([piece(self.length, 0)])
            start += self.length
        while start < total:
            n = total - start
            fits = [w for w in self.open if self.length - w[0] >= n]
            if fits:
                best = max(fits, key=lambda w: w[0])
                best[1].append(piece(n, best[0]))
                best[0] += n
                start = total
                if best[0] == self.length:
                    self.open.remove(best)
                    self._emit(best[1])
            elif len(self.open) < self.windows:
                self.open.append([n, [piece(n, 0)]])
                start = total
            else:
                fullest = max(self.open, key=lambda w: w[0])
                n = self.length - fullest[0]
                fullest[1].append(piece(n, fullest[0]))
                start += n
                self.open.remove(fullest)
                self._emit(fullest[1])

    def take(self) -> list[tuple]:
        out, self.closed = self.closed, []
        return out

    def rest(self) -> list[tuple]:
        out = []
        for _, pieces in self.open:
            out += [(*p, self.emitted) for p in pieces]
            self.emitted += 1
        self.open = []
        return out


def _batch(pieces: list[tuple], part: int, at: list[int] | None) -> pa.RecordBatch:
    cols = list(zip(*pieces)) or [()] * 7
    doc, start, n, ids, total, offset, window = map(list, cols)
    k = len(doc)
    arrays = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
              pa.array(total, pa.int64()), pa.array([part] * k, pa.int32()), pa.array(window, pa.int64()),
              pa.array(offset, pa.int64()), pa.array(at or [0] * k, pa.int64()), pa.array([at is None] * k, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def pack(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
         length: int = LENGTH, windows: int = OPEN) -> DataFrame:
    """Pieces of sequences: doc_id, start (ids of the document before it),
    length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset (place in the sequence, without gaps from 0).

    Null text counts as empty; every document ends with ``end_id``, so every
    row gives a piece. All sequences have ``length`` ids, but for at most
    log2(length) + 1 last ones, whose lengths are powers of two. Null and
    repeated ids are kept as they are. Empty table: empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, tok, packer = TaskContext.get().partitionId(), tokenizer(vocabulary), OnlinePacker(length, windows)
        for b in batches:
            names, texts = b.column(0).to_pylist(), text_column(b, 1)
            for i, j in slices(texts, SLICE):
                flat, off = tok.encode(texts.slice(i, j - i), end_id)
                for k in range(j - i):
                    packer.add(names[i + k], flat[off[k]:off[k + 1]])
                yield _batch(packer.take(), part, None)
        rest = packer.rest()
        ends = np.cumsum([p[2] for p in rest])
        yield _batch(rest, part, [int(e) - p[2] for e, p in zip(ends, rest)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = scratch_path(spark, "packed")
    rows.mapInArrow(run, _PIECES).write.option("compression", "zstd").partitionBy("closed").parquet(path)
    pieces = spark.read.schema(_PIECES).parquet(path)
    done = pieces.filter("closed").select(
        "doc_id", "start", "length", "ids", "doc_tokens",
        (F.shiftleft(F.col("part").cast("long"), 40) + F.col("window")).alias("sequence_id"), "offset")
    return done.unionByName(_merged(pieces.filter("not closed"), length))


def _merged(rest: DataFrame, length: int) -> DataFrame:
    """The pieces of open windows as one stream, cut anew."""
    per = rest.groupBy("part").agg(F.sum("length").alias("tokens"))
    before = F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = per.select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("base"))
    total = per.agg(F.sum("tokens")).first()[0] or 0
    full, left = divmod(total, length)
    ends, at = [], full * length
    for bit in range(length.bit_length() - 1, -1, -1):
        if left >> bit & 1:
            ends.append((at, at + (1 << bit)))
            at += 1 << bit
    cuts = F.array(*[F.struct(F.lit(a).cast("long").alias("lo"), F.lit(z).cast("long").alias("hi")) for a, z in ends]) \
        if ends else F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    g = F.col("base") + F.col("at")
    n = F.lit(length).cast("long")
    whole = F.transform(F.sequence(F.floor(g / n), F.floor((g + F.col("length") - 1) / n)),
                        lambda k: F.struct((k * n).alias("lo"), ((k + 1) * n).alias("hi")))
    parts = (rest.join(base, rest["part"] == base["_part"]).withColumn("g", g)
             .withColumn("cut", F.explode(F.concat(F.filter(whole, lambda c: c["lo"] < F.lit(full * length)), cuts))))
    lo, hi = F.greatest("g", "cut.lo"), F.least(F.col("g") + F.col("length"), F.col("cut.hi"))
    parts = parts.withColumn("lo", lo).withColumn("hi", hi).filter("lo < hi")
    skip = F.col("lo") - F.col("g")
    size = F.col("hi") - F.col("lo")
    return parts.select(
        "doc_id", (F.col("start") + skip).alias("start"), size.alias("length"),
        F.expr("substring(ids, cast((lo - g) * 4 + 1 as int), cast((hi - lo) * 4 as int))").alias("ids"), "doc_tokens",
        # Negative numbers, so that they differ from those of the partitions.
        (-1 - F.col("cut.lo")).alias("sequence_id"), (F.col("lo") - F.col("cut.lo")).alias("offset"))
