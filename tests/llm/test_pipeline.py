"""The corpus pipeline, stage by stage against plain versions."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from ..conftest import SF_MID
from . import brute
from .conftest import CLASHING, edge_documents, passage
from .test_documents import check_packing

WORD = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents of sf0.01 before and after every stage, each written
    and read again."""
    root = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF_MID}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF_MID).write.parquet(f"{root}/{k}")
        after = spark.read.parquet(f"{root}/{k}")
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    assert all(columns == COLUMNS for _, _, columns in stages[:-1])


def test_quality_keeps_trusted_documents(spark, stages):
    before, after, _ = stages[0]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert sorted(after) == sorted(r for r in before if r.doc_id in kept)
    good, junk = ([i for i in (r.doc_id for r in before) if quality.get(i) == q] for q in (1, 0))
    assert sum(i in kept for i in good) > 0.99 * len(good) and sum(i in kept for i in junk) < 0.2 * len(junk)


def test_exact_stage(stages):
    before, after, _ = stages[1]
    keep = {i for i, _, _, kept, _ in brute.equal_texts([(r.doc_id, r.text) for r in before]) if kept}
    assert sorted(after) == sorted(r for r in before if r.doc_id in keep) and len(after) < len(before)


def test_near_stage(stages):
    before, after, _ = stages[2]
    keep = {i for i, _, c in brute.simhash_components([(r.doc_id, r.text) for r in before]) if i == c}
    assert sorted(after) == sorted(r for r in before if r.doc_id in keep)


def test_substring_stage(stages):
    before, after, _ = stages[3]
    want = {i: (n, gone, sha) for i, n, gone, sha in brute.substring_dedup([(r.doc_id, r.text) for r in before])}
    rows = {r.doc_id: r for r in after}
    assert rows.keys() == {i for i, (n, gone, _) in want.items() if gone < n or not gone}
    for r in before:
        if r.doc_id in rows:
            new = rows[r.doc_id]
            assert (new.lang, new.source) == (r.lang, r.source)
            if want[r.doc_id][1]:
                import hashlib
                assert hashlib.sha256(b" ".join(brute.words(new.text))).hexdigest() == want[r.doc_id][2]
                assert new.n_chars == len(new.text)
            else:
                assert new == r


def test_packing_stage(stages):
    before, after, _ = stages[4]
    ids = brute.token_ids(WORD, [r.text for r in before], P.END_ID)
    check_packing(after, list(zip((r.doc_id for r in before), ids)), 4096)


def test_run_gives_the_last_stage(spark, stages):
    got = P.run(spark, SF_MID).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    want = {}
    for r in stages[4][1]:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.length
    assert {r.doc_id: r.n for r in got} == want


def test_stages_take_edge_rows_and_extra_columns(spark, edge, tmp_path):
    """Nulls, blanks, ties, repeated rows and clashing names go through every
    stage; columns stay."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 73)] + [(None, 1, 0), (5, None, None)],
                                   "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = edge
    for k, (_, stage) in enumerate(P.STAGES):
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns == [*COLUMNS, *CLASHING]
        if k == 1:
            texts = [re.sub(r"\s+", " ", r.text) for r in docs.collect()]
            assert len(texts) == len(set(texts)) and "dup row" in texts
        if k == 3:
            text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and r.doc_id != 60}
            assert passage(3, 70) not in text.get(22, "") and text[20] == edge_documents()[8][1]


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
