"""Ordered, per-camera building blocks that stay balanced when one camera
holds a large share of all frames.

A plain ``Window.partitionBy(camera)`` puts every frame of a camera into one
task. The helpers here never do that:

* ``keyed_sequence`` numbers rows per key. Rows are range-partitioned on
  (key, order), so a hot key is spread over many tasks; each task numbers
  its rows locally and a small table of per-(task, key) counts supplies the
  offset of every task's first row.
* ``carry_last`` fills a column forward per key (latest non-null value at or
  before each row). It scans fixed-size chunks of the sequence in parallel
  and carries the last value of each chunk into the next through a small
  per-chunk table.
* ``trailing_groups`` builds windows of the last N rows inside chunks of a
  key's sequence; the N-1 rows before a chunk are copied into it, so each
  row is shuffled about once and no group exceeds the chunk size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK_ROWS_CONF, SCAN_CHUNK_ROWS, session_int
from ..session import ensure_checkpoint_dir


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a dimension table. The planner broadcasts it when its size is
    below the session's threshold, at planning or, under AQE, at run time."""
    return big.join(small, on, how)


def keyed_sequence(df: DataFrame, keys, order, seq_col: str = "seq",
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``seq_col``: 0-based position of each row within its key, by
    ``order``. ``order`` must be a total order within a key (end it with a
    unique id), so the numbering is deterministic. Select the needed
    columns first: the numbered rows are checkpointed as they are."""
    keys, order = _cols(keys), _cols(order)
    by = keys + order
    ensure_checkpoint_dir(df.sparkSession)
    # Without a fixed count the range partitioning starts from
    # spark.sql.shuffle.partitions and AQE merges small partitions.
    ranged = df.repartitionByRange(num_partitions, *by) if num_partitions else df.repartitionByRange(*by)
    ranged = (ranged.sortWithinPartitions(*by)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mono", F.monotonically_increasing_id()))
    # Written once to the shared checkpoint folder: the counts below and the
    # numbering must see the same partitioning, and lineage stops here.
    ranged = ranged.checkpoint(eager=True)
    blocks = ranged.groupBy("_pid", *keys).agg(
        F.min("_mono").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("_pid").alias("_bpid"), *[F.col(k).alias(f"_b_{k}") for k in keys], "_m0",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    cond = (ranged["_pid"] == blocks["_bpid"]) & reduce(
        lambda a, b: a & b, [ranged[k].eqNullSafe(blocks[f"_b_{k}"]) for k in keys])
    out = ranged.join(blocks, cond, "inner")
    return (out.withColumn(seq_col, (F.col("_mono") - F.col("_m0") + F.col("_off")).cast("bigint"))
            .drop("_pid", "_mono", "_bpid", "_m0", "_off", *[f"_b_{k}" for k in keys]))


CHUNK_COL = "_chunk"


def _chunk_rows(df: DataFrame, chunk_rows: int | None) -> int:
    return chunk_rows or session_int(df.sparkSession, CHUNK_ROWS_CONF, SCAN_CHUNK_ROWS)


def carry_last(df: DataFrame, keys, seq_col: str, value_cols, out_cols=None,
               chunk_rows: int | None = None, keep_chunk: bool = False) -> DataFrame:
    """For every row and every column of ``value_cols``, the latest non-null
    value of that column among rows of the same key at or before it (by
    ``seq_col``). Columns are carried independently, all in one window pass;
    pack columns that belong together into a struct. ``seq_col`` must be a
    dense per-key sequence (``keyed_sequence``); NULL is a key like any other.

    Plan: one shuffle of the rows on (key, chunk) for the scan; the per-chunk
    ends come from a map-side combined aggregate (a few rows per task); the
    carry table (one row per chunk) is joined back on (key, chunk) -
    broadcast by AQE when small, otherwise co-partitioned with the rows.
    With ``keep_chunk`` the chunk column stays in the output; a following
    ``carry_last`` on the same keys reuses it, and with it the partitioning
    and order of the rows, so it adds no shuffle."""
    keys, value_cols = _cols(keys), _cols(value_cols)
    out_cols = _cols(out_cols) if out_cols else [f"{c}_carried" for c in value_cols]
    idx = range(len(value_cols))
    chunk_rows = _chunk_rows(df, chunk_rows)
    base = df if CHUNK_COL in df.columns else \
        df.withColumn(CHUNK_COL, F.expr(f"`{seq_col}` div {int(chunk_rows)}"))
    upto = (Window.partitionBy(*keys, "_chunk").orderBy(seq_col)
            .rowsBetween(Window.unboundedPreceding, 0))
    x = base.select("*", *[F.last(v, ignorenulls=True).over(upto).alias(f"_l{i}")
                           for i, v in zip(idx, value_cols)])
    # Last non-null value of each chunk: a max_by aggregate combined map-side,
    # so only one row per (key, chunk, task) is shuffled for it. Then carried
    # over the chunks of a key (a window over one row per chunk).
    ends = base.groupBy(*keys, "_chunk").agg(*[
        F.max_by(v, F.when(F.col(v).isNotNull(), F.col(seq_col))).alias(f"_e{i}")
        for i, v in zip(idx, value_cols)])
    prev = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_chunk").alias("_c_chunk"),
                        *[F.last(f"_e{i}", ignorenulls=True).over(prev).alias(f"_in{i}") for i in idx])
    # Only chunks that receive a value from an earlier chunk are joined; a
    # camera that fits in one chunk adds nothing, so the table stays small.
    carry = carry.where(reduce(lambda a, b: a | b, [F.col(f"_in{i}").isNotNull() for i in idx]))
    cond = reduce(lambda a, b: a & b, [x[k].eqNullSafe(carry[f"_c_{k}"]) for k in keys] +
                  [x["_chunk"] == carry["_c_chunk"]])
    y = x.join(carry, cond, "left")
    keep = [c for c in df.columns if c != CHUNK_COL] + ([CHUNK_COL] if keep_chunk else [])
    return y.select(*keep, *[F.coalesce(F.col(f"_l{i}"), F.col(f"_in{i}")).alias(o)
                             for i, o in zip(idx, out_cols)])


def trailing_groups(df: DataFrame, keys, seq_col: str, size: int,
                    payload_cols, end_col: str = "end_seq",
                    chunk_rows: int | None = None) -> DataFrame:
    """Windows of the last ``size`` rows per key, one output row per window
    end that has a full window. Returns keys, ``end_col`` and ``items``: the
    rows of the window ordered by sequence.

    Rows are grouped by (key, chunk of ``chunk_rows`` positions); the last
    ``size`` - 1 rows of a chunk are also copied into the next chunk, so
    every window lies inside one group and a sliding window of ``size`` rows
    runs within it. Each row is shuffled about once (not ``size`` times), and
    no group exceeds ``chunk_rows`` + ``size`` - 1 rows."""
    keys, payload_cols = _cols(keys), _cols(payload_cols)
    chunk_rows = _chunk_rows(df, chunk_rows)
    item = F.struct(F.col(seq_col).alias("seq"), *[F.col(c) for c in payload_cols])
    seq = F.col(seq_col)
    own = F.expr(f"`{seq_col}` div {int(chunk_rows)}")
    last = F.expr(f"(`{seq_col}` + {size - 1}) div {int(chunk_rows)}")
    x = df.select(*keys, seq.alias("_s"), item.alias("_item"), own.alias("_own"),
                  F.explode(F.sequence(own, last)).alias("_chunk"))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_s").rowsBetween(-(size - 1), 0)
    y = x.withColumn("items", F.collect_list("_item").over(w))
    return (y.where((F.col("_own") == F.col("_chunk")) & (F.size("items") == size))
            .select(*keys, F.col("_s").alias(end_col), "items"))
