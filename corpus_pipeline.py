"""Corpus pipeline: documents through five operators of ``sightline.llm``.

``STAGES`` are (name, function) in order; each function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import exact_dedup, kneser_ney, packing, rlz, simhash
from sightline.llm.common import saved, table
from sightline.llm.queries import WORD_BPE, vocabulary
from sightline.session import ship_package

#: Id that ends a document in packed sequences.
END_ID = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the language model rejects (operator 5)."""
    ship_package(spark)
    return kneser_ney.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts (operator 4)."""
    ship_package(spark)
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 10)."""
    ship_package(spark)
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of 50 words or more that an earlier document has
    (operator 2); documents of which nothing is left go."""
    ship_package(spark)
    return rlz.cut_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences (operator 8): doc_id, start, length, ids,
    doc_tokens, sequence_id, offset."""
    ship_package(spark)
    return packing.pack(docs, vocabulary(WORD_BPE), END_ID)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("substring_dedup", substrings),
    ("packing", packed),
]

#: Several stages (language model, parsing, token ids) have no SQL form; the
#: tests compare the result with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents``: the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
