"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves and each half is quantised by its own codebook;
a cell is a pair of centroids. A query walks the cells by the sum of its two
distances, with a heap over the two sorted lists, until the cells passed hold
enough entries, and the entries are reranked by their exact distance.

The codebooks are fitted on a bounded sample. So is the number of entries to
pass: the share of the sample that holds the neighbours asked for, at the
recall aimed at. Cells are dealt to shards of bounded size, a large cell to
several; a query goes only to the shards that hold its cells, with the cells
to look at. Equal vectors are one point: only as many of their smallest ids
as a result can hold are kept, so a vector repeated by a third of all rows
neither fills a shard nor a candidate list.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

#: Vectors in the sample for codebooks and depth, centroids of a half, rounds.
SAMPLE, CENTROIDS, ROUNDS = 20_000, 64, 8
#: Recall aimed at on the sample, and queries of the sample it is judged by.
RECALL, PROBES = 0.97, 300
#: Entries in a shard and queries that meet a shard in one group.
SHARD, QUERIES = 8_192, 8_192


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part: not null or
    empty, all components finite, not all zero. Of rows with one id the
    smallest vector counts; null ids do not."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.filter("vec_id is not null and size(v) > 0").filter(ok)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


class Codebooks:
    """Centroids of both halves."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.parts = first, second
        self.cut = first.shape[1]

    @staticmethod
    def fit(sample: np.ndarray, centroids: int, rounds: int) -> Codebooks:
        cut = max(1, sample.shape[1] // 2)
        return Codebooks(*(_k_means(h, centroids, rounds) for h in (sample[:, :cut], sample[:, cut:])))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of rows to the centroids of each half."""
        return tuple(np.maximum(0, (h * h).sum(1)[:, None] - 2 * h @ c.T + (c * c).sum(1))
                     for h, c in zip((x[:, :self.cut], x[:, self.cut:]), self.parts))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.parts[1]) + b.argmin(1)


def _k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells by a[i] + b[j], smallest first, until those passed hold
    ``enough`` entries. ``counts``: entries of each cell."""
    i_of, j_of = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b, i_of, j_of = a[i_of].tolist(), b[j_of].tolist(), i_of.tolist(), j_of.tolist()
    width, held, out = len(b), 0, []
    heap, nexts = [(a[0] + b[0], 0, 0)], [0] * len(a)
    # Row i of the grid is entered once row i - 1 was; then its next j follows.
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = i_of[i] * width + j_of[j]
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        if j + 1 < width:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return out


def depth(sample: np.ndarray, books: Codebooks, k: int, recall: float, probes: int) -> float:
    """The share of entries to pass so that ``recall`` of the sample's true
    neighbours are among them, judged by evenly spread sample vectors."""
    at = np.unique(np.linspace(0, len(sample) - 1, probes).astype(int))
    if len(sample) <= k + 1:
        return 1.0
    cell = books.cells(sample)
    counts = np.bincount(cell, minlength=len(books.parts[0]) * len(books.parts[1]))
    a, b = books.distances(sample[at])
    need = []
    norms = (sample * sample).sum(1)
    for n, q in enumerate(at):
        d = norms - 2 * sample @ sample[q]
        d[q] = np.inf
        near = np.argpartition(d, k)[:k]
        s = (a[n][:, None] + b[n]).ravel()
        order = np.argsort(s, kind="stable")
        passed = np.empty(len(s), np.int64)
        passed[order] = np.cumsum(counts[order])
        need.append(passed[cell[near]])
    return min(1.0, float(np.quantile(np.concatenate(need), recall)) / len(sample) + k / len(sample))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           sample: int = SAMPLE, centroids: int = CENTROIDS, recall: float = RECALL,
           shard: int = SHARD) -> DataFrame:
    """The ``k`` nearest found rows of ``index`` for each row of ``queries``,
    without the row that has the query's own id: query_id, rank (from 1),
    vec_id, score (Euclidean distance of the vectors in double precision).
    Nearest first, ties to the smaller vec_id; all candidates if there are
    fewer than ``k``.

    Rows whose vector is null or zero, or holds nulls or values that are not
    finite, take no part, as queries or candidates; nor do null ids. A vector
    is compared with those of its own length, which have an index of their
    own. Of rows with one id the smallest vector counts. No valid
    query or candidate: empty result. Extra columns are not read.
    """
    kind = "query_id long, rank int, vec_id long, score double"
    spark = index.sparkSession
    every = saved(valid_vectors(index, id_col, vector_col), "vectors")
    asked = saved(valid_vectors(queries, id_col, vector_col), "queries")
    lengths = sorted(r[0] for r in asked.select(F.size("v")).distinct().collect())
    found = [_search(every.filter(F.size("v") == d), asked.filter(F.size("v") == d), k, sample, centroids, recall, shard) for d in lengths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kind)


def _search(points: DataFrame, asked: DataFrame, k: int, sample: int, centroids: int, recall: float, shard: int) -> DataFrame:
    """``search`` among vectors of one length."""
    kind = "query_id long, rank int, vec_id long, score double"
    spark = points.sparkSession
    held = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(held):
        return spark.createDataFrame([], kind)
    x = np.unique(np.vstack(held["v"].to_list()), axis=0)
    books = Codebooks.fit(x, centroids, ROUNDS)
    share = depth(x, books, k, recall, PROBES)

    # Of equal vectors no result shows more than k, besides the query itself.
    first = W.partitionBy("v").orderBy("vec_id")
    points = points.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).select("vec_id", "v")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1))
            cell = books.cells(m) if len(m) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32))],
                                             ["vec_id", "v", "cell"])

    entries = saved(points.mapInArrow(assign, "vec_id long, v array<double>, cell int"), "entries")
    counts = np.zeros(len(books.parts[0]) * len(books.parts[1]), np.int64)
    for r in entries.groupBy("cell").count().collect():  # at most centroids squared
        counts[r["cell"]] = r["count"]
    enough = max(k + 1, int(np.ceil(share * counts.sum())))
    # Shards are runs of cells; a cell larger than a shard has shards of its own.
    first_shard, parts = _shards(counts, shard)
    blocks = max(1, -(-asked.count() // QUERIES))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            qa, qb = books.distances(_matrix(b.column(1)))
            rows, shards, cells = [], [], []
            for r in range(b.num_rows):
                by: dict[int, list[int]] = {}
                for c in walk(qa[r], qb[r], counts, enough):
                    for p in range(parts[c]):
                        by.setdefault(int(first_shard[c]) + p, []).append(c)
                rows += [r] * len(by)
                shards += by
                cells += by.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(shards, pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                ["query_id", "q", "shard", "cells"])

    probes = (asked.mapInArrow(probe, "query_id long, q array<double>, shard int, cells array<int>")
              .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")))
    lookup = spark.createDataFrame([(c, int(first_shard[c]), int(parts[c])) for c in np.flatnonzero(counts).tolist()],
                                   "_cell int, f int, p int")
    dealt = entries.join(F.broadcast(lookup), entries["cell"] == lookup["_cell"]).select(
        "vec_id", "v", "cell", (F.col("f") + F.pmod(F.xxhash64("vec_id"), F.col("p"))).cast("int").alias("shard"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rerank(entry: pa.Table, ask: pa.Table) -> pa.Table:
        out = [[], [], []]
        if entry.num_rows and ask.num_rows:
            ids = entry.column("vec_id").to_numpy()
            m = _matrix(entry.column("v").combine_chunks())
            cell = entry.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            ids, m, cell = ids[order], m[order], cell[order]
            qs = _matrix(ask.column("q").combine_chunks())
            for q, own, cells in zip(qs, ask.column("query_id").to_pylist(), ask.column("cells").to_pylist()):
                lo, hi = np.searchsorted(cell, cells), np.searchsorted(cell, cells, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                at = at[ids[at] != own]
                d = np.sqrt(((m[at] - q) ** 2).sum(1))
                best = np.lexsort((ids[at], d))[:k]
                out[0] += [own] * len(best)
                out[1] += ids[at[best]].tolist()
                out[2] += d[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    found = (dealt.groupBy("shard", "block").cogroup(probes.groupBy("shard", "block"))
             .applyInArrow(rerank, "query_id long, vec_id long, score double"))
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _shards(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each cell."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    now = held = 0
    for c, n in enumerate(counts.tolist()):
        if n > size:
            now += held > 0
            first[c], parts[c] = now, -(-n // size)
            now, held = now + parts[c], 0
            continue
        if held + n > size:
            now, held = now + 1, 0
        first[c] = now
        held += n
    return first, parts
