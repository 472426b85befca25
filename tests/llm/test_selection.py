"""Importance resampling, sharding and hard negatives against plain versions."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import negatives, resampling, sharding
from sightline.llm import queries as Q

from ..conftest import SF_MID, SF_SMALL

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, longest):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return w, [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, longest=1, buckets=10_000, seed=2024, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    parsed = [grams(x, longest) for _, x in docs]
    for _, fs in parsed:
        for f in fs:
            s[bucket(f)] += 1
    for x in target:
        for f in grams(x, longest)[1]:
            t[bucket(f)] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (big_s + buckets) / ((a + 1) * (big_t + buckets)))) for a, b in zip(s, t)]
    rows = []
    for (i, _), (w, fs) in zip(docs, parsed):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least),
                  key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1], r[5]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in rows)))


def rows_of(df, *cols):
    return sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


RANKED = ("doc_id", "n_features", "weight", "score", "rank")


def test_resampling_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()]
    got = Q.op11_importance_resampling(spark, SF_MID)
    assert got.columns == list(RANKED) and {t for _, t in got.dtypes} == {"bigint"}
    assert rows_of(got, *RANKED) == plain_resample(docs, target)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_edge_documents(spark, edge, longest):
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    target = [None, "", "w1 W2 w3 the END", "ÉTÉ été w5,w6"]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(edge, t, percent=40, longest=longest, buckets=997)
    assert rows_of(got, *RANKED) == plain_resample(docs, target, longest, 997, percent=40)


def test_resampling_empty_tables(spark, edge):
    none = edge.limit(0)
    assert resampling.resample(none, edge).count() == 0
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    assert rows_of(resampling.resample(edge, none), *RANKED) == plain_resample(docs, [])


def test_features_do_not_cross_documents():
    texts = [b"a b", b"", b"B c!d", b"\x00e\x00f"]
    doc, code, words = resampling.features(texts, 2, 1 << 32)
    want = [(0, "a"), (0, "b"), (2, "b"), (2, "c"), (2, "d"), (3, "e"), (3, "f"), (0, "a b"), (2, "b c"), (2, "c d"), (3, "e f")]
    assert list(zip(doc.tolist(), code.tolist())) == [(d, zlib.crc32(w.encode())) for d, w in want]
    assert words.tolist() == [2, 0, 3, 2]


def test_drawn_documents_keep_all_columns(spark, edge):
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    got = resampling.drawn_documents(edge, target, percent=50)
    assert got.columns == edge.columns
    able = [r for r in edge.collect() if len(grams(r.text, 1)[0]) >= 20]
    assert got.count() == len(able) // 2


# --- sharding ---------------------------------------------------------------

def least_capacity(sizes, shards):
    """Smallest possible largest shard over contiguous cuts, by dynamic
    programming."""
    best = [0] + [math.inf] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[a], sum(sizes[a:b])) for a in range(b + 1)) for b in range(1, len(sizes) + 1)]
    return best[-1]


def check_shards(docs, got, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in got) == \
        sorted(str((i, size(t), zlib.crc32((t or "").encode()))) for i, t in docs)
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r)
    for k, rows in per.items():
        rows.sort(key=lambda r: r.slot)
        assert 0 <= k < shards and [r.slot for r in rows] == list(range(len(rows)))
        ids = [(r.doc_id is None, r.doc_id) for r in rows if r.doc_id is not None]
        assert ids == sorted(ids)
    group, first = {}, {}
    for i, t in docs:
        group[t or ""] = group.get(t or "", 0) + size(t)
        first[t or ""] = min(first.get(t or "", (True, 0)), (i is None, i or 0))
    order = sorted(group, key=lambda t: (first[t], hashlib.sha256(t.encode()).digest()))
    loads = [sum(r["size"] for r in rows) for rows in per.values()]
    if group:
        assert max(loads) == least_capacity([group[t] for t in order], shards)
    return loads


def test_sharding_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = Q.op12_minimax_shards(spark, SF_SMALL)
    rows = got.collect()
    loads = check_shards(docs, rows, 8)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)} and len(loads) == 8
    by_text = {}
    text = dict(docs)
    for r in rows:
        by_text.setdefault(text[r.doc_id] or "", set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


@pytest.mark.parametrize("shards", [1, 3, 8, 40])
def test_sharding_edge_documents(spark, edge, shards):
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    check_shards(docs, sharding.assign(edge, shards).collect(), shards)


def test_sharding_hot_group_and_empty(spark):
    docs = [(i, "same text " * 4 if i % 3 == 0 else f"text {i % 50}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    loads = check_shards(docs, sharding.assign(df, 4).collect(), 4)
    assert len(loads) == 4  # the others share what the hot group leaves
    assert sharding.assign(df.limit(0), 4).count() == 0


def test_written_shards_hold_the_documents(spark, edge, tmp_path):
    sharding.write_shards(edge, str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert set(got.columns) == {*edge.columns, "shard", "slot"}
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, edge.select("doc_id", "text").collect()))


# --- hard negatives -----------------------------------------------------------

def plain_negatives(rows, anchors, positives=5, negatives=3, window=(50, 95, 100)):
    """rows: {(id, label, tuple of ints)}."""
    out = []
    rows = sorted(rows)
    for a, la, qa in sorted(anchors):
        scored = sorted((-sum(x * y for x, y in zip(qa, q)), i, lab) for i, lab, q in rows if len(q) == len(qa) and i != a)
        for p, i, _ in [s for s in scored if s[2] == la][:positives]:
            ok = [(-s, j) for s, j, lab in scored
                  if lab != la and window[0] * -p <= window[2] * -s <= window[1] * -p][:negatives]
            out += [(a, i, r + 1, j, -p, s) for r, (s, j) in enumerate(ok)]
    return sorted(out)


def whole(rows):
    return {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows
            if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)}


def test_negatives_query(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()]
    rows = whole(rows)
    got = Q.op13_rtree_negatives(spark, SF_MID)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, {r for r in rows if r[0] % 50 == 0})


def test_negatives_edge_vectors(spark):
    nan, inf, rng = float("nan"), float("inf"), np.random.default_rng(4)
    rows = [(1, 0, None), (2, 0, []), (3, 0, [nan, 1.0, 1.0]), (4, 0, [1.0, None, 1.0]), (5, None, [1.0, 1.0, 1.0]),
            (None, 1, [1.0, 1.0, 1.0]), (6, 1, [inf, 0.0, 0.0]), (7, 1, [0.0, 0.0, 0.0]), (8, 0, [1.0, 1.0]), (9, 1, [1.0, 0.7]),
            (10, 0, [0.9, 0.9]), (11, 0, [1.0, 1.0, 1.0]), (11, 0, [1.0, 1.0, 1.0]), (11, 1, [1.0, 1.0, 1.0])]
    rows += [(100 + i, i % 3, [1.0, 0.5, 0.25]) for i in range(60)]  # one point many times
    rows += [(200 + i, i % 2, [0.7, 0.4, 0.2]) for i in range(40)]
    rows += [(300 + i, int(rng.integers(3)), [float(x) for x in rng.normal(size=3)]) for i in range(300)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, q string, node int")
    anchors = df.filter("vec_id % 5 = 0 or vec_id < 20")
    want = plain_negatives(whole(rows), {r for r in whole(rows) if r[0] % 5 == 0 or r[0] < 20})
    assert sorted(tuple(r) for r in negatives.hard_negatives(df, anchors).collect()) == want
    assert negatives.hard_negatives(df.limit(0), anchors).count() == 0
    assert negatives.hard_negatives(df, anchors.limit(0)).count() == 0


def test_negatives_over_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(negatives, "NODE", 64)
    monkeypatch.setattr(negatives, "BLOCK", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    rows = [(i, int(rng.integers(4)), [float(x) for x in centres[i % 12] + 0.2 * rng.normal(size=6)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = plain_negatives(whole(rows), {r for r in whole(rows) if r[0] % 20 == 0})
    assert sorted(tuple(r) for r in negatives.hard_negatives(df, df.filter("vec_id % 20 = 0")).collect()) == want


def test_tree_prunes_clustered_vectors():
    """Boxes bound the scores of their rows, and most leaves are skipped."""
    rng = np.random.default_rng(6)
    centres = rng.integers(-200, 200, (40, 8))
    q = (centres[np.arange(8192) % 40] + rng.integers(-3, 4, (8192, 8))).astype(float)
    order, starts = negatives.pack_node(q, np.arange(6))
    assert sorted(order.tolist()) == list(range(8192)) and np.diff(starts).max() <= negatives.LEAF
    low, high = negatives.boxes(q[order], starts)
    anchors = q[:50]
    least, most = negatives.bounds(anchors, low, high)
    score = anchors @ q[order].T
    leaf = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    assert (score <= most[:, leaf]).all() and (score >= least[:, leaf]).all()
    fifth = -np.sort(-score, axis=1)[:, 4]
    assert (most >= fifth[:, None]).mean() < 0.5


def test_large_components_stay_exact(spark):
    rows = [(1, 0, [3e5, 1.0]), (2, 0, [3e5, 2.0]), (3, 1, [2.7e5, 1.0]), (4, 1, [2.7e5, 1.001])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, df.filter("vec_id = 1")).collect())
    assert got == plain_negatives(whole(rows), {r for r in whole(rows) if r[0] == 1})
