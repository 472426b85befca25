"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are bit votes over hashed word shingles. The distinct
fingerprints form a binary trie; two nodes of it are traversed together, the
bits in which their prefixes differ are added up, and a pair is dropped as
soon as the sum exceeds the budget. The upper levels of the traversal are
Spark's: a fingerprint is sent to every pair of subtrees (a unit) that its
prefix can form within the budget, and a unit that still holds too many
fingerprints is split again on its next bits with what is left of its
budget. A task then walks the rest of a unit, level by level, over sorted
arrays. Every pair of fingerprints meets in exactly one unit.

Documents with one fingerprint are one node, so copies never multiply, and a
node has at most 64 + 2016 partners within two bits, which bounds the links
by the number of distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pinned, saved, text_column, unique_ids, without

#: Words in a shingle, seed of the hash and largest distance of a link.
SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Bits of the prefix that Spark sends by, and of each further split; most
#: fingerprints in a unit that one task walks without another split.
START_BITS, UNIT = 6, 1 << 17
#: Node pairs a task holds at a time.
FRONTIER = 1 << 19


def simhash(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text, as a signed 64-bit integer. A-Z count as a-z;
    no words: 0; fewer words than a shingle: the whole sequence is one."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        bits = np.unpackbits(h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(votes * 2 > n, bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, fp (long). Null text has no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_column(b, 1).cast(pa.large_binary())
            fps = [simhash(t.as_py(), words, seed) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# --- the part of the traversal that Spark does ----------------------------

def _masks(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, number of ones) of all ways to differ in up to ``most`` of ``bits`` bits."""
    return [(sum(1 << i for i in c), k) for k in range(most + 1) for c in combinations(range(bits), k)]


def _partners(own: Column, bits: int, most: int) -> Column:
    masks = _masks(bits, most)
    return F.array(*[F.struct(own.bitwiseXOR(F.lit(m)).alias("other"), F.lit(k).alias("used")) for m, k in masks])


def _units(fps: DataFrame, bits: int, max_bits: int) -> DataFrame:
    """unit (the two prefixes, smaller first), left (bits of budget left),
    side (whether fp is under the first prefix), fp."""
    own = F.shiftrightunsigned("fp", 64 - bits)
    u = fps.select("fp", own.alias("own"), F.explode(_partners(own, bits, max_bits)).alias("p"))
    return u.select(F.struct(F.least("own", "p.other").alias("a"), F.greatest("own", "p.other").alias("b")).alias("unit"),
                    (F.lit(max_bits) - F.col("p.used")).alias("left"),
                    (F.col("own") <= F.col("p.other")).alias("side"), "fp")


def _split(units: DataFrame, depth: int, bits: int, max_bits: int) -> DataFrame:
    """Units with ``bits`` more bits of prefix, by the budget that each has left."""
    out = None
    more = F.shiftrightunsigned("fp", 64 - depth - bits)
    for left in range(max_bits + 1):
        rows = units.filter(F.col("left") == left)
        rows = rows.select("*", more.alias("own"), F.explode(_partners(F.lit(0).cast("long"), bits, left)).alias("p"))
        # The partner's prefix: that of the other subtree, with this row's next bits changed by the mask.
        other = F.when(F.col("side"), F.col("unit.b")).otherwise(F.col("unit.a"))
        low = F.col("own").bitwiseAND(F.lit((1 << bits) - 1)).bitwiseXOR(F.col("p.other"))
        rows = rows.select("*", (F.shiftleft(other, bits) + low).alias("far"))
        # In a unit of one subtree with itself both orders meet: the smaller prefix is the first.
        same = F.col("unit.a") == F.col("unit.b")
        first = F.when(same, F.col("own") <= F.col("far")).otherwise(F.col("side"))
        rows = rows.select(F.struct(F.when(first, F.col("own")).otherwise(F.col("far")).alias("a"),
                                    F.when(first, F.col("far")).otherwise(F.col("own")).alias("b")).alias("unit"),
                           (F.col("left") - F.col("p.used")).alias("left"), first.alias("side"), "fp")
        out = rows if out is None else out.unionAll(rows)
    return out


# --- the part of the traversal that a task does ---------------------------

def trie_links(x: np.ndarray, y: np.ndarray | None, start: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``max_bits`` of sorted distinct uint64 arrays ``x`` and
    ``y`` (None: of ``x`` with itself, each pair once), whose nodes at depth
    ``start`` are the roots: all of x, and all of y. A node is a range of an
    array; its children are cut at the next bit."""
    same = y is None
    y = x if same else y
    if not len(x) or not len(y):
        return x[:0], y[:0]
    budget = int(np.bitwise_count(x[0] >> np.uint64(64 - start) ^ y[0] >> np.uint64(64 - start))) if start else 0
    ones: dict[tuple[int, int], np.ndarray] = {}

    def middle(which: int, a: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if (which, depth) not in ones:
            bit = (a >> np.uint64(63 - depth)) & np.uint64(1)
            ones[which, depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        c = ones[which, depth]
        return hi - (c[hi] - c[lo])

    one = np.array([0]), np.array([len(x)]), np.array([0]), np.array([len(y)]), np.array([budget], np.int64)
    stack, out = [(start, *one)], []
    while stack:
        depth, xl, xh, yl, yh, used = stack.pop()
        leaf = (xh - xl == 1) & (yh - yl == 1)
        if depth == 64:
            leaf[:] = True
        if leaf.any():
            i, j = xl[leaf], yl[leaf]
            near = np.bitwise_count(x[i] ^ y[j]) <= max_bits
            near &= (i < j) if same else True
            out.append((x[i[near]], y[j[near]]))
            go = ~leaf
            xl, xh, yl, yh, used = xl[go], xh[go], yl[go], yh[go], used[go]
        if not len(xl):
            continue
        if len(xl) > FRONTIER:
            h = len(xl) // 2
            stack += [(depth, xl[:h], xh[:h], yl[:h], yh[:h], used[:h]), (depth, xl[h:], xh[h:], yl[h:], yh[h:], used[h:])]
            continue
        xm, ym = middle(0, x, depth, xl, xh), middle(0 if same else 1, y, depth, yl, yh)
        parts = [(xl, xm, yl, ym, used), (xm, xh, ym, yh, used), (xl, xm, ym, yh, used + 1), (xm, xh, yl, ym, used + 1)]
        kids = [np.concatenate(c) for c in zip(*parts)]
        ok = (kids[1] > kids[0]) & (kids[3] > kids[2]) & (kids[4] <= max_bits)
        if same:  # of two different nodes, one order is enough
            ok &= kids[0] <= kids[2]
        stack.append((depth + 1, *(k[ok] for k in kids)))
    if not out:
        return x[:0], y[:0]
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def trie_self_join(fps: DataFrame, max_bits: int = MAX_BITS, unit: int = UNIT) -> DataFrame:
    """Links (a, b, bits) between the distinct longs ``fp``: every pair that
    differs in 1 to ``max_bits`` bits, once."""
    depth, links = START_BITS, None
    todo = _units(fps, depth, max_bits)
    # At most 2**depth rows: no unit holds more than two subtrees.
    sizes = fps.groupBy(F.shiftrightunsigned("fp", 64 - depth)).count()
    largest = 2 * (sizes.agg(F.max("count")).first()[0] or 0)
    while True:
        heavy = None
        if largest > unit and depth < 60:
            todo = saved(todo, "units")
            sizes = pinned(todo.groupBy("unit").count().filter(F.col("count") > unit).select("unit"))
            heavy = todo.join(sizes, "unit", "left_semi")
            todo = todo.join(sizes, "unit", "left_anti")
            largest = 2 * unit if sizes.limit(1).count() else 0
        found = _walk(todo, depth, max_bits)
        links = found if links is None else links.unionAll(found)
        if heavy is None or not largest:
            return links
        step = min(START_BITS, 64 - depth)
        todo = _split(heavy, depth, step, max_bits)
        depth += step


def _walk(units: DataFrame, depth: int, max_bits: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        fp = t.column("fp").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
        unit = t.column("unit")[0].as_py()
        first = t.column("side").combine_chunks().to_numpy(zero_copy_only=False)
        if unit["a"] == unit["b"]:
            a, b = trie_links(np.sort(fp), None, depth, max_bits)
        else:
            a, b = trie_links(np.sort(fp[first]), np.sort(fp[~first]), depth, max_bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64),
                         "bits": np.bitwise_count(a ^ b).astype(np.int32)})

    return units.groupBy("unit").applyInArrow(run, "a long, b long, bits int")


# --- components -----------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b): the smallest node that
    it reaches. Rounds of smallest-neighbour labels, each followed by a step
    to the label's own label, until nothing changes."""
    both = saved(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = pinned(both.groupBy("a").agg(F.min("b").alias("m"))
                   .select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = (both.join(label.withColumnRenamed("node", "b"), "b")
                .groupBy("a").agg(F.min("root").alias("m")))
        step = (label.join(near, label["node"] == near["a"])
                .select("node", F.col("root").alias("old"), F.least("root", "m").alias("root")))
        jump = label.select(F.col("node").alias("via"), F.col("root").alias("far"))
        nxt = pinned(step.join(jump, step["root"] == jump["via"], "left")
                     .select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        if not nxt.filter("old <> root").limit(1).count():
            return nxt.select("node", "root")
        label = nxt.select("node", "root")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   words: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id reached over links between fingerprints
    that differ in up to ``max_bits`` bits, itself included.

    Null or empty text: fingerprint 0, linked like any other. Null ids never
    become a component_id unless the component has no other. Repeated ids and
    rows keep their rows. Empty table: empty result. Columns other than the
    two named are not read.
    """
    fp = saved(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    nodes = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(trie_self_join(nodes.select("fp"), max_bits))
    rooted = nodes.join(comp, nodes["fp"] == comp["node"]).select("fp", "least", "root")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = rooted.join(ids, "root").select("fp", "component_id")
    alone = nodes.join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return (fp.join(linked.unionAll(alone), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The row with the smallest id of each group; the others go."""
    rows, key = unique_ids(docs, id_col)
    groups = simhash_groups(rows, key, **options)
    return without(rows, groups.filter("doc_id <> component_id").select("doc_id"), key).select(docs.columns)
