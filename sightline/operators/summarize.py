"""Per-frame label counts, summary text and batch metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def label_counts(dets: DataFrame, frame_keys, label_col: str = "label",
                 pos_col: str | None = "pos") -> DataFrame:
    """G1: detections per (frame, label). With ``pos_col`` also the first
    position the label was seen at, which orders the summary text."""
    keys = _cols(frame_keys)
    aggs = [F.count(F.lit(1)).alias("n")]
    if pos_col:
        aggs.append(F.min(pos_col).alias("first_pos"))
    return dets.groupBy(*keys, label_col).agg(*aggs)


def summary_text(dets: DataFrame, frame_keys, label_col: str = "label", pos_col: str = "pos",
                 out_col: str = "summary") -> DataFrame:
    """``label (count)`` lines, each ended by a newline, labels in the
    order first seen in the frame. Counts are combined map-side first, so
    the list gathered per frame has one entry per distinct label."""
    keys = _cols(frame_keys)
    counts = label_counts(dets, keys, label_col, pos_col)
    line = lambda s: F.concat(s[label_col], F.lit(" ("), s["n"].cast("string"), F.lit(")\n"))
    return (counts.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("first_pos", label_col, "n"))).alias("_l"))
            .select(*keys, F.array_join(F.transform("_l", line), "").alias(out_col)))


def batch_metrics(df: DataFrame, batch_col: str, camera_col: str = "camera_id") -> DataFrame:
    """G3 over a batch table: messages per batch and frames processed (one
    per camera). The distinct count is planned as two aggregates, the first
    map-side, so a hot camera does not land in one task."""
    return df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_messages"),
                                     F.countDistinct(camera_col).alias("n_processed"))


def observe_batch_metrics(df: DataFrame, ts_col: str = "event_ts", camera_col: str = "camera_id",
                          name: str = "batch_metrics") -> DataFrame:
    """G3 on a stream: metrics of every micro-batch, read from
    ``StreamingQueryProgress.observedMetrics``. The camera count is
    approximate (a distinct count is not allowed here)."""
    return df.observe(name, F.count(F.lit(1)).alias("n_messages"),
                      F.approx_count_distinct(camera_col).alias("n_cameras_approx"),
                      F.max(F.timestamp_diff("MICROSECOND", F.col(ts_col), F.current_timestamp()))
                      .alias("max_age_us"))
