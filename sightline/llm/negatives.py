"""Hard negatives by a packed R-tree over quantised vectors.

Rows are packed by sort-tile-recursive: sorted by one coordinate and cut into
slabs of equal size, each slab sorted by a second one and cut into nodes; in a
node the same gives tiles and in a tile leaves, over further coordinates. Nodes,
tiles and leaves carry their minimum bounding box. For an anchor a box gives an
interval for each coordinate's part of the inner product, and so bounds of the
score of every row in it.

A task takes a block of anchors and walks the tree best first: a queue gives
the node with the highest bound that some anchor of the block still needs; a
box is skipped for an anchor if it lies outside the anchor's score window or
strictly below its k-th best so far. Scores of the rows that are left come from
one matrix product. Nodes are read from the shared checkpoint folder when the
queue asks for them, one at a time: neither the rows nor a product of anchors
and rows is shuffled, and a lost task reads them again.

Equal vectors of one label are cut to the few smallest ids that a result can
hold before anything is packed, so a vector that a third of all rows repeat
is a handful of rows; a window's k-th score then prunes the rest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sequence import keyed_sequence
from ..session import scratch_path
from .common import fs_of, saved

#: Rows of a node, a tile and a leaf.
NODE, TILE, LEAF = 65_536, 2_048, 64
#: Anchors that walk the tree together, and those of one matrix product.
BLOCK, PART = 8_192, 512
#: Rows whose spread chooses the coordinates to sort by.
SAMPLE = 20_000

_NONE = -np.iinfo(np.int64).max


def quantised(rows: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """vec_id, label, q (floor of scale times each component) of the rows that
    take part, each once."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and size(v) > 0").filter(ok)
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q")).distinct()


# --- packing ---------------------------------------------------------------

def str_order(q: np.ndarray, axes: np.ndarray, size: int) -> np.ndarray:
    """Row order in which every ``size`` rows are one tile: slabs by the
    first axis, within them runs by the second."""
    n = len(q)
    a, b = axes[0], axes[-1]
    slabs = max(1, int(np.ceil(np.sqrt(-(-n // size)))))
    width = size * -(-(-(-n // size)) // slabs)
    slab = np.empty(n, np.int64)
    slab[np.argsort(q[:, a], kind="stable")] = np.arange(n) // width
    return np.lexsort((q[:, b], slab))


def pack_node(q: np.ndarray, axes: np.ndarray, tile: int = TILE, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Order of a node's rows and the start of each leaf (n leaves + 1); a
    tile is a run of leaves that begins at a multiple of ``tile`` rows."""
    order = str_order(q, axes[:2] if len(axes) < 4 else axes[2:4], tile)
    for at in range(0, len(order), tile):
        part = order[at:at + tile]
        order[at:at + tile] = part[str_order(q[part], axes[-2:], leaf)]
    starts = np.concatenate([np.arange(at, min(at + tile, len(order)), leaf) for at in range(0, len(order), tile)])
    return order, np.append(starts, len(order))


def boxes(q: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest value of each coordinate in each run of rows."""
    at = starts[:-1]
    return np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each anchor can have with a row of each
    box: per coordinate the interval between its products with both sides."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


class Tree:
    """A written index: ``root/node=K`` holds the rows of a node in packed
    order; ``tops`` the nodes' boxes."""

    def __init__(self, root: str, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, axes: np.ndarray, exact: type):
        self.root, self.nodes, self.axes, self.exact = root, nodes, axes, exact
        self.low, self.high = low.astype(exact), high.astype(exact)

    def node(self, k: int) -> tuple[np.ndarray, ...]:
        """ids, labels, vectors, leaf starts and leaf boxes of a node."""
        fs, folder = fs_of(self.root)
        t = pq.read_table(f"{folder}/node={self.nodes[k]}", filesystem=fs, columns=["vec_id", "label", "q"],
                          partitioning=None)
        t = t.sort_by("vec_id").combine_chunks()
        q = matrix(t.column("q"), self.exact)
        order, starts = pack_node(q, self.axes)
        q = q[order]
        return (t.column("vec_id").to_numpy()[order], t.column("label").to_numpy()[order], q, starts, *boxes(q, starts))


def matrix(col: pa.ChunkedArray, kind: type) -> np.ndarray:
    flat = col.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(col), -1)


def build(points: DataFrame, width: int) -> Tree | None:
    """Write the tree of the ``points`` (vec_id, label, q) with ``width``
    coordinates; None without points."""
    spark = points.sparkSession
    sample = points.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE).select("q").toPandas()
    if not len(sample):
        return None
    spread = np.stack(sample["q"].to_list()).astype(float).std(0)
    axes = np.argsort(-spread, kind="stable")[:6]
    # Slabs by the first coordinate, nodes by the second: two sorts of keys.
    n = points.count()
    nodes = -(-n // NODE)
    slabs = int(np.ceil(np.sqrt(nodes)))
    per = -(-nodes // slabs) * NODE
    rows = points.withColumns({"x": F.element_at("q", int(axes[0]) + 1), "y": F.element_at("q", int(axes[min(1, width - 1)]) + 1),
                               "all": F.lit(0)})
    rows = keyed_sequence(rows, "all", ["x", "vec_id", "label", "q"], "at") if slabs > 1 else rows.withColumn("at", F.lit(0))
    rows = rows.withColumn("slab", F.expr(f"int(at div {per})")).drop("at")
    if nodes > 1:
        rows = keyed_sequence(rows, "slab", ["y", "vec_id", "label", "q"], "at")
        rows = rows.withColumn("node", F.expr(f"slab * {per // NODE} + int(at div {NODE})"))
    else:
        rows = rows.withColumn("node", F.lit(0))
    root = scratch_path(spark, "r-tree")
    (rows.select("node", "vec_id", "label", "q").repartition("node").sortWithinPartitions("node", "vec_id")
     .write.partitionBy("node").parquet(root))
    at = F.posexplode("q").alias("d", "x")
    tops = (spark.read.schema("vec_id long, label long, q array<long>, node int").parquet(root).select("node", at)
            .groupBy("node", "d").agg(F.min("x").alias("l"), F.max("x").alias("h"))
            .groupBy("node").agg(F.array_sort(F.collect_list(F.struct("d", "l", "h"))).alias("b"))
            .select("node", "b.l", "b.h").orderBy("node").toPandas())  # one row for every NODE rows
    low, high = np.stack(tops["l"].to_list()), np.stack(tops["h"].to_list())
    most = float(np.maximum(np.abs(low.astype(float)), np.abs(high.astype(float))).max(0) @
                 np.maximum(np.abs(low.astype(float)), np.abs(high.astype(float))).max(0))
    exact = np.float64 if most < 2 ** 53 else np.int64 if most < 2 ** 63 else object
    return Tree(root, tops["node"].to_numpy(), low, high, axes, exact)


# --- search ----------------------------------------------------------------

class Best:
    """The best k (score, id) of each query so far; higher scores first, ties
    by smaller id. ``low`` and ``high`` are the queries' windows."""

    def __init__(self, queries: int, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low, high
        self.score = np.full((queries, k), _NONE, np.int64)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max, np.int64)

    def needs(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether a box with these score bounds (a row a query, a column a
        box) may still hold a result of each query."""
        reach = np.minimum(most, self.high[:, None])
        return (most >= self.low[:, None]) & (least <= self.high[:, None]) & (reach >= self.score[:, -1:])

    def of(self, at: np.ndarray) -> Best:
        """Some of the queries, to ask for their needs."""
        part = Best(0, self.k, self.low[at], self.high[at])
        part.score = self.score[at]
        return part

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """New candidates of the queries ``at``: a row a query."""
        ok = ok & (score >= self.low[at, None]) & (score <= self.high[at, None]) & (score >= self.score[at, -1:])
        row, col = np.nonzero(ok)
        if not len(row):
            return
        rows = np.unique(row)
        query = np.concatenate([row, np.repeat(rows, self.k)])
        s = np.concatenate([score[row, col].astype(np.int64), self.score[at[rows]].ravel()])
        i = np.concatenate([ids[col], self.ids[at[rows]].ravel()])
        order = np.lexsort((i, -s, query))
        query, s, i = query[order], s[order], i[order]
        first = np.searchsorted(query, query)
        top = np.arange(len(query)) - first < self.k
        slot = (np.arange(len(query)) - first)[top]
        self.score[at[query[top]], slot] = s[top]
        self.ids[at[query[top]], slot] = i[top]


def walk(tree: Tree, anchors: np.ndarray, anchor_ids: np.ndarray, owner: np.ndarray, best: Best, labels: np.ndarray,
         same: bool) -> None:
    """Fill ``best``: its query i belongs to anchor ``owner[i]`` and takes
    rows of the anchor's label (``same``) or of other labels. ``owner`` is
    sorted."""
    if not len(owner):
        return
    heap = []
    for at in range(0, len(tree.nodes), 256):
        top = bounds(anchors, tree.low[at:at + 256], tree.high[at:at + 256])[1].max(0)
        heap += [(-b, at + i) for i, b in enumerate(top.tolist())]
    heapq.heapify(heap)
    while heap:
        bound, k = heapq.heappop(heap)
        least, most = (x[owner] for x in bounds(anchors, tree.low[k:k + 1], tree.high[k:k + 1]))
        asks = best.needs(least, most)[:, 0]
        if not asks.any():
            continue
        top = most[asks].max()
        if -bound > top:  # fewer anchors need it now: back into the queue
            heapq.heappush(heap, (-top, k))
            continue
        node, at = tree.node(k), np.flatnonzero(asks)
        cut = np.searchsorted(owner[at], np.arange(0, len(anchors) + PART, PART))
        for i, j in zip(cut, cut[1:]):
            if j > i:
                _search_node(node, anchors, anchor_ids, owner, best, labels, same, at[i:j])


def _search_node(node: tuple, anchors: np.ndarray, anchor_ids: np.ndarray, owner: np.ndarray, best: Best,
                 labels: np.ndarray, same: bool, at: np.ndarray) -> None:
    """The rows of a node for the queries ``at``, tile by tile, best first."""
    ids, label, q, starts, low, high = node
    who, back = np.unique(owner[at], return_inverse=True)
    least, most = bounds(anchors[who], low, high)
    per = TILE // LEAF
    for t in sorted(range(0, len(low), per), key=lambda t: -most[:, t:t + per].max()):
        need = best.of(at).needs(least[back, t:t + per], most[back, t:t + per])
        leaves = np.flatnonzero(need.any(0)) + t
        if not len(leaves):
            continue
        rows = np.concatenate([np.arange(starts[x], starts[x + 1]) for x in leaves])
        asking = need.any(1)
        used, mine = np.unique(back[asking], return_inverse=True)
        score = anchors[who[used]] @ q[rows].T
        equal = labels[who[used]][:, None] == label[rows][None, :]
        ok = (equal if same else ~equal) & (anchor_ids[who[used]][:, None] != ids[rows][None, :])
        best.add(at[asking], score[mine], ids[rows], ok[mine])


def mine_block(tree: Tree, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, positives: int, negatives: int,
               window: tuple[int, int, int]) -> dict[str, np.ndarray]:
    """The triples of a block of anchors."""
    n = len(ids)
    everything = np.full(n, _NONE, np.int64), np.full(n, np.iinfo(np.int64).max, np.int64)
    near = Best(n, positives, *everything)
    walk(tree, q, ids, np.arange(n), near, labels, True)
    anchor, slot = np.nonzero(near.ids != np.iinfo(np.int64).max)
    score = near.score[anchor, slot]
    # Positives of one score share a window: a query is an anchor and a score.
    pairs, query = np.unique(np.stack([anchor, score], 1), axis=0, return_inverse=True)
    least, most, per = window
    far = Best(len(pairs), negatives, -(-least * pairs[:, 1] // per), most * pairs[:, 1] // per)
    walk(tree, q, ids, pairs[:, 0], far, labels, False)
    query = query.ravel()
    row, rank = np.nonzero(far.ids[query] != np.iinfo(np.int64).max)
    return {"anchor_id": ids[anchor[row]], "positive_id": near.ids[anchor, slot][row], "rank": (rank + 1).astype(np.int32),
            "negative_id": far.ids[query[row], rank], "positive_score": score[row], "negative_score": far.score[query[row], rank]}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables of ``BLOCK`` rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        while sum(x.num_rows for x in held) >= BLOCK:
            t = pa.Table.from_batches(held)
            yield t.slice(0, BLOCK)
            held = t.slice(BLOCK).to_batches()
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


KIND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3,
                   window: tuple[int, int, int] = (50, 95, 100), scale: int = 256, id_col: str = "vec_id",
                   label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """For each row of ``anchors`` and each of its positives, the hard
    negatives among ``rows``: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.

    A score is the integer inner product of components floor(scale x); higher
    first, ties to the smaller id. Positives are the first rows of the
    anchor's label, negatives the first of other labels whose score s
    satisfies window[0] p <= window[2] s <= window[1] p for the positive's
    score p; fewer if there are no more. Rows with the anchor's own id are
    neither.

    Rows with a null id, label or vector, an empty vector, or null or
    non-finite components take no part; vectors meet only those of their own
    length. Equal rows count once; of rows with one id and several labels or
    vectors each counts. Exact while scores fit in a long. Extra columns are
    not read. No anchor or no candidate: empty result.
    """
    spark = rows.sparkSession
    points = saved(quantised(rows, scale, id_col, label_col, vector_col), "quantised")
    asked = saved(quantised(anchors, scale, id_col, label_col, vector_col), "anchors")
    # Of equal vectors of a label no result shows more, besides the anchor itself.
    most = max(positives, negatives) + 1
    first = W.partitionBy("q", "label").orderBy("vec_id")
    points = points.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).drop("n")
    points = saved(points, "points")
    out = None
    for width, n in sorted((r["d"], r["n"]) for r in asked.groupBy(F.size("q").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()):
        own = F.size("q") == width
        tree = build(points.filter(own), width)
        if tree is not None:
            found = _mine(asked.filter(own), n, tree, positives, negatives, window)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], KIND) if out is None else out


def _mine(asked: DataFrame, n: int, tree: Tree, positives: int, negatives: int, window: tuple[int, int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            found = mine_block(tree, part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), tree.exact),
                               positives, negatives, window)
            yield pa.RecordBatch.from_pydict(found)

    tasks = max(asked.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK))
    # Anchors near each other walk the tree together.
    a = F.element_at("q", int(tree.axes[0]) + 1)
    return asked.repartitionByRange(tasks, a, "vec_id").sortWithinPartitions(a, "vec_id").mapInArrow(run, KIND)
