"""Importance resampling of documents towards a target distribution.

Documents and target texts are bags of hashed word n-grams. A bucket's gain is
the log ratio of its share in the target to its share in the documents; a
document's weight is the sum of its features' gains. Weights plus Gumbel noise
that depends on the document id alone, taken from the top, are a sample without
replacement in proportion to the importance weights.

The texts of a batch are joined with a separator byte that is in no word, and
one pass of one regular expression finds all words of the batch. A binary
search in the document offsets gives each word its document; runs of words that
cross from one document to the next are masked out before ``bincount`` adds up
the buckets.

1. A scan of each table gives every task's bucket counts, summed by bucket:
   at most ``buckets`` rows of a task are shuffled, however skewed the words.
2. The gains (one number a bucket) go out with the second scan, which yields
   narrow rows only: texts are never shuffled.
3. Ranks are positions in a range-partitioned sort of those rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import keyed_sequence
from .common import saved, slices, text_column

#: Bytes of text joined at a time; a longer text is joined on its own.
JOINED = 1 << 20
#: Words of UTF-8 text in which A-Z are lower-cased: digits, a-z and all that
#: is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\0"


def features(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document and the bucket of every run of 1 to ``longest`` words, and
    the number of words of each document."""
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + len(SEPARATOR)
    offsets = np.cumsum(length) - length
    data = SEPARATOR.join(texts).lower()
    spans = np.fromiter((x for m in WORD.finditer(data) for x in m.span()), np.int64).reshape(-1, 2)
    doc = np.searchsorted(offsets, spans[:, 0], "right") - 1
    words = [data[a:b] for a, b in spans.tolist()]
    n_words = np.bincount(doc, minlength=len(texts))
    run = np.fromiter(map(crc32, words), np.int64, len(words))
    docs, codes = [doc], [run % buckets]
    for n in range(2, longest + 1):
        # The checksum of a run goes on over a space and the next word.
        run = np.fromiter((crc32(b" " + w, c) for w, c in zip(words[n - 1:], run.tolist())), np.int64,
                          max(0, len(words) - n + 1))
        inside = doc[:len(run)] == doc[n - 1:]
        docs.append(doc[:len(run)][inside])
        codes.append(run[inside] % buckets)
    return np.concatenate(docs), np.concatenate(codes), n_words


def _batches(col: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    for i, j in slices(col, JOINED):
        yield i, j, col.slice(i, j - i).cast(pa.large_binary()).to_pylist()


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, c) over the texts of a one-column table; buckets without a
    feature are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, part in _batches(text_column(b, 0)):
                c += np.bincount(features(part, longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c[at])], ["bucket", "c"])

    return texts.mapInArrow(run, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln(((t+1)(S+B)) / ((s+1)(T+B)))) of each bucket, in doubles."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((source, s), (target, t)):
        into[list(counts)] = list(counts.values())
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _noise(id_text: Column, seed: int) -> Column:
    """Gumbel noise times 1000, rounded down, from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    u = (h + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u))).cast("long")


def importance_scores(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024,
                      id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_features, weight, score.

    Words are runs of digits, letters a-z (after A-Z are lower-cased) and
    characters beyond ASCII; features are the runs of 1 to ``longest`` words
    of one document, repeats counted. Null, empty and wordless texts have no
    features and weight 0; an empty target gives all buckets the same share.
    Rows with one id have the same noise; a null id counts as the empty text.
    Extra columns are not read.
    """
    def table_of(df: DataFrame, col: str) -> dict[int, int]:  # at most one row a bucket
        return {r["bucket"]: r["c"] for r in bucket_counts(df.select(F.col(col).alias("t")), longest, buckets).collect()}

    gain = gains(table_of(docs, text_col), table_of(target, target_col), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for i, j, part in _batches(text_column(b, 1)):
                doc, code, words = features(part, longest, buckets)
                n_words[i:j] = words
                n_features[i:j] = np.bincount(doc, minlength=j - i)
                np.add.at(weight[i:j], doc, gain[code])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                                             ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    scored = rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    noise = _noise(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)
    return scored.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, **options) -> DataFrame:
    """``importance_scores`` of every row and its ``rank`` among the drawn
    ones: of the N rows with at least ``least_words`` words,
    floor(percent N / 100) with the highest scores, ties to the smaller
    doc_id (null last, then by weight and length: rows alike in all of these
    are interchangeable). Not drawn: null. ``options`` are those of
    ``importance_scores``."""
    scored = saved(importance_scores(docs, target, **options), "importance")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    # One key: its rows are spread over the tasks by the order columns.
    order = able.withColumns({"all": F.lit(0), "down": -F.col("score"), "none": F.col("doc_id").isNull()})
    order = keyed_sequence(order, "all", ["down", "none", "doc_id", "weight", "n_features", "n_words"], "at")
    rank = F.when(F.col("at") < drawn, F.col("at") + 1)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    short = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return order.select(*columns, rank.cast("long").alias("rank")).unionByName(short)


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns. Rows with repeated or null
    ids are told apart by row number."""
    from .common import unique_ids
    rows, key = unique_ids(docs, id_col)
    ids = resample(rows, target, id_col=key, **options).filter("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return rows.join(ids, rows[key] == ids["_drawn"], "left_semi").select(docs.columns)
