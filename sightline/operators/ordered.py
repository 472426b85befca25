"""Ordered per-camera operators, batch form (H1-H3). The stream forms keep
the same results with keyed state (``streaming/state.py``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ACTIVITY_SEQUENCE_LENGTH, VECTOR_CHUNK_ROWS
from .select import latest_per_key
from .sequence import carry_last, trailing_groups


def rolling_features(df: DataFrame, key: str = "camera_id", seq_col: str = "seq",
                     vec_col: str = "vec", id_col: str = "vec_id",
                     size: int = ACTIVITY_SEQUENCE_LENGTH, chunk_rows: int | None = None) -> DataFrame:
    """H1: the last ``size`` feature vectors, sliding by one sampled frame;
    a window is emitted only once it is full. One row per window end:
    ``seq`` (end position), ``ids`` and ``vectors`` oldest first. Chunks of a
    camera are short, for vectors are wide: a task holds at most
    ``chunk_rows`` of them, and a camera with many is spread over tasks."""
    g = trailing_groups(df, [key], seq_col, size, [id_col, vec_col], end_col=seq_col,
                        chunk_rows=chunk_rows or VECTOR_CHUNK_ROWS)
    return g.select(key, seq_col, F.transform("items", lambda s: s[id_col]).alias("ids"),
                    F.transform("items", lambda s: s[vec_col]).alias("vectors"))


def carry_forward_text(df: DataFrame, key: str = "camera_id", seq_col: str = "seq",
                       text_col: str = "text", out_col: str = "shown_text",
                       chunk_rows: int | None = None, carry_forward: bool = True) -> DataFrame:
    """H2: text shown with each frame. It changes only on a non-empty text,
    otherwise the previous one stays; '' before the first. Without
    ``carry_forward`` each frame shows its own text. Reuses the chunk column
    of an earlier ``carry_last`` when present."""
    if not carry_forward:
        return df.withColumn(out_col, F.coalesce(F.col(text_col), F.lit("")))
    kw = {"chunk_rows": chunk_rows} if chunk_rows else {}
    x = df.withColumn("_t", F.when(F.col(text_col) != "", F.col(text_col)))
    y = carry_last(x, [key], seq_col, ["_t"], ["_shown"], **kw)
    return y.withColumn(out_col, F.coalesce(F.col("_shown"), F.lit(""))).drop("_t", "_shown")


def latest_feature(df: DataFrame, key: str = "camera_id", seq_col: str = "seq") -> DataFrame:
    """H3: the newest feature vector per camera (the standing value handed
    to the event classifier)."""
    return latest_per_key(df, [key], [seq_col])
