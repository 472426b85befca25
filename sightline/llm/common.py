"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back. Cuts the lineage with files that every executor can reach."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """``checkpoint()`` a narrow table in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def long_texts(spark: SparkSession) -> None:
    """Documents are long rows: an Arrow batch of Spark's default 10,000 of
    them takes tens of megabytes in the JVM and again in the Python worker.
    A session that has not chosen its own number gets batches of 1,000."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "1000")


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    long_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collapsed(text: Column | str) -> Column:
    """Null as empty; each run of white space as one space. A lone space is
    left alone, so the pattern only matches runs that change."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")),
                            r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def text_column(batch: pa.RecordBatch, i: int) -> pa.Array:
    """A string column without nulls (null: empty), with 64-bit offsets."""
    return batch.column(i).cast(pa.large_string()).fill_null("")


def byte_offsets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a large_string column."""
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    return off, (np.frombuffer(data, np.uint8) if data is not None and len(col) and off[-1] else np.zeros(0, np.uint8))


def slices(col: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    off, _ = byte_offsets(col)
    i = 0
    while i < len(col):
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), len(col))
        yield i, j
        i = j


def fs_of(uri: str):
    """File system and path of a shared folder, for tasks that write or read
    whole files: local paths directly, other schemes through Arrow."""
    from pyarrow import fs

    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem(), u.path
    return fs.FileSystem.from_uri(uri)


#: Most rows of a one-column id table that is broadcast (8 to 16 bytes each);
#: beyond it the planner joins by shuffle.
BROADCAST_IDS = 2_000_000


def unique_ids(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` and the name of a column of unique, non-null ids in the order
    of ``id_col`` (nulls last). That is ``id_col`` itself unless some id is
    null or repeated; then a saved copy with a row number is used."""
    again = (docs.groupBy(id_col).count()
             .filter((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count())
    if not again:
        return docs, id_col
    key = "row_no"
    while key in docs.columns:
        key += "_"
    order = [F.col(id_col).asc_nulls_last()]
    numbered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(numbered.withColumn(key, F.monotonically_increasing_id()), "row-numbers"), key


def without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in the one-column ``dropped``.
    The ids are broadcast after a count shows that they are few, so that the
    texts are not shuffled; otherwise this is a plain anti join."""
    ids = pinned(dropped.select(F.col(dropped.columns[0]).alias(key)))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, "left_anti").select(docs.columns)
