"""Keyed-state stream forms of the ordered operators.

Window functions other than time windows are refused on streams, so each
ordered operator has a second form here: ``applyInPandasWithState`` keyed by
camera. Within a micro-batch a camera's rows are sorted by the order
columns; the state carries what the operator needs from earlier batches
(a counter, the last N vectors, the last text, the last prediction). Input
is expected in event-time order per camera across batches, as a Kafka
partition per camera gives it; the state is kept in the checkpoint, so a
restarted query continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

_UNIT_MS = {"millisecond": 1, "ms": 1, "second": 1000, "s": 1000, "minute": 60_000, "min": 60_000,
            "hour": 3_600_000, "h": 3_600_000, "day": 86_400_000, "d": 86_400_000}


def duration_ms(d) -> int:
    """``"1 hour"``, ``"90 seconds"``, ``"5 min"`` or an int (ms) to ms."""
    if isinstance(d, int):
        return d
    num, unit = d.strip().split(None, 1)
    unit = unit.strip().lower()
    unit = unit[:-1] if unit.endswith("s") and unit[:-1] in _UNIT_MS else unit
    return int(float(num) * _UNIT_MS[unit])


def _py(v):
    """A pandas/numpy value as a plain Python value for the state store."""
    if v is None:
        return None
    if isinstance(v, pd.Timestamp):
        return None if pd.isna(v) else v.to_pydatetime()
    if isinstance(v, np.ndarray):
        return [_py(x) for x in v.tolist()]
    if isinstance(v, (list, tuple)):
        return [_py(x) for x in v]
    if isinstance(v, np.generic):
        v = v.item()
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    return v


def _scan_stream(df: DataFrame, key: str, order: list[str], extra: list[T.StructField],
                 state_schema: T.StructType, initial: tuple,
                 step: Callable[[pd.DataFrame, tuple], tuple[pd.DataFrame, tuple]],
                 drop_input: tuple[str, ...] = (), idle_timeout=None, time_col: str | None = None,
                 watermark: str = "0 seconds", hold_back: bool = False) -> DataFrame:
    """Run ``step(sorted_rows, state) -> (output_rows, state)`` per camera
    and micro-batch, with a typed state row (``initial`` for a new camera).
    The output keeps the input columns (minus ``drop_input``) and adds
    ``extra``.

    With ``idle_timeout`` (``"1 hour"``, or ms) the state of a camera that
    sent nothing for that long is removed, so state does not grow with
    cameras that went away; a camera that comes back after that starts
    afresh. Idleness is judged by processing time, which needs no watermark
    and so drops no row; only with ``hold_back``, which has a watermark
    anyway, by event time. Spark keeps waking a query with processing-time
    timeouts, so run it with a processing-time trigger and stop it; it does
    not end by itself under ``availableNow``.

    With ``hold_back`` a camera's rows wait in state until the watermark
    (``watermark`` behind the newest event time) passes them, and are then
    processed in time order; rows arriving behind the watermark are dropped
    as late. Out-of-order arrival within the watermark delay then gives the
    same result as the batch form, at the cost of that much latency."""
    idle_ms = duration_ms(idle_timeout) if idle_timeout else None
    if hold_back:
        if not time_col or order[0] != time_col:
            raise ValueError("hold_back needs time_col (the event time of the rows) first in the order")
        df = df.withWatermark(time_col, watermark).withColumn("_t_ms", F.unix_millis(time_col))
        drop_input = tuple(drop_input) + ("_t_ms",)
    in_names = df.columns
    if hold_back:
        pending_type = T.ArrayType(T.StructType(df.schema.fields))
        state_schema = T.StructType(state_schema.fields + [T.StructField("_pending", pending_type)])
        initial = tuple(initial) + ([],)
    fields = [f for f in df.schema.fields if f.name not in drop_input] + extra
    out_schema = T.StructType(fields)
    names = [f.name for f in fields]

    def empty():
        return pd.DataFrame({n: [] for n in names})

    def fn(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        parts = list(pdfs)
        st = tuple(state.get) if state.exists else initial
        core, pending = (st[:-1], st[-1] or []) if hold_back else (st, [])
        if state.hasTimedOut and not pending:
            state.remove()  # idle camera
            yield empty()
            return
        new = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=in_names)
        rest = None
        if hold_back:
            held = pd.DataFrame([tuple(r) for r in pending], columns=in_names)
            rows = pd.concat([x for x in (held, new) if len(x)] or [new], ignore_index=True)
            rows[time_col] = pd.to_datetime(rows[time_col])
            ready_mask = rows["_t_ms"].astype("int64") <= state.getCurrentWatermarkMs()
            ready, rest = rows[ready_mask], rows[~ready_mask]
        else:
            ready = new
        out = None
        if len(ready):
            ready = ready.sort_values(order, kind="mergesort").reset_index(drop=True)
            out, core = step(ready, tuple(core))
        new_state = tuple(core)
        if hold_back:
            new_state += ([tuple(_py(v) for v in r) for r in rest[in_names].itertuples(index=False)],)
        state.update(new_state)
        if hold_back:
            wm = state.getCurrentWatermarkMs()
            if len(rest):
                state.setTimeoutTimestamp(max(int(rest["_t_ms"].min()), wm + 1))  # release once passed
            elif idle_ms is not None:
                last = int(ready["_t_ms"].max()) if len(ready) else wm
                state.setTimeoutTimestamp(max(last + idle_ms, wm + 1))
        elif idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out[names] if out is not None and len(out) else empty()

    timeout = (GroupStateTimeout.EventTimeTimeout if hold_back else
               GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout)
    return df.groupBy(key).applyInPandasWithState(fn, out_schema, state_schema, "append", timeout)


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def sample_every_n_stream(df: DataFrame, n: int, key: str = "camera_id",
                          order=("event_ts", "offset"), idle_timeout=None,
                          time_col: str = "event_ts", hold_back: bool = False,
                          watermark: str = "0 seconds") -> DataFrame:
    """E1 on a stream: per-camera counter in state; rows whose position is a
    multiple of ``n`` are emitted with ``seq``."""
    def step(pdf, st):
        start = int(st[0])
        pdf["seq"] = range(start, start + len(pdf))
        return pdf[pdf["seq"] % n == 0], (start + len(pdf),)
    return _scan_stream(df, key, list(order), [T.StructField("seq", T.LongType())],
                        _schema("count BIGINT"), (0,), step, idle_timeout=idle_timeout, time_col=time_col,
                        hold_back=hold_back, watermark=watermark)


def rolling_stream(df: DataFrame, size: int, key: str = "camera_id", order=("vec_id",),
                   id_col: str = "vec_id", vec_col: str = "vec", idle_timeout=None,
                   time_col: str | None = None) -> DataFrame:
    """H1 on a stream: the last ``size`` - 1 vectors stay in state; each new
    vector that completes a window emits (camera, seq, ids, vectors)."""
    def step(pdf, st):
        held = 0 if st[0] is None else len(st[0])
        new = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]])
        ids = np.concatenate([np.asarray(st[0] if held else [], np.int64), pdf[id_col].to_numpy(np.int64)])
        vecs = np.concatenate([np.asarray(st[1], np.float64).reshape(held, -1), new]) if held else new
        ends = np.arange(max(size, held + 1), len(ids) + 1)  # windows that end in this batch
        first = int(st[2]) - held
        out = pd.DataFrame({"seq": first + ends - 1, "ids": [ids[e - size:e] for e in ends],
                            "vectors": [list(vecs[e - size:e]) for e in ends]})
        out[key] = pdf[key].iloc[0]
        keep = min(size - 1, len(ids))
        tail = slice(len(ids) - keep, len(ids))
        return out, (ids[tail].tolist(), vecs[tail].tolist(), int(st[2]) + len(pdf))

    extra = [T.StructField("seq", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())),
             T.StructField("vectors", T.ArrayType(T.ArrayType(T.DoubleType())))]
    cols = [key, id_col, vec_col] + ([time_col] if time_col else [])
    return _scan_stream(df.select(*cols), key, list(order), extra,
                        _schema("ids ARRAY<BIGINT>, vecs ARRAY<ARRAY<DOUBLE>>, count BIGINT"), ([], [], 0),
                        step, drop_input=tuple(c for c in cols if c != key), idle_timeout=idle_timeout,
                        time_col=time_col)


def carry_text_stream(df: DataFrame, key: str = "camera_id", order=("event_ts", "offset"),
                      text_col: str = "text", out_col: str = "shown_text",
                      idle_timeout=None, time_col: str = "event_ts", hold_back: bool = False,
                      watermark: str = "0 seconds") -> DataFrame:
    """H2 on a stream: the last non-empty text stays in state."""
    def step(pdf, st):
        text = pdf[text_col]
        shown = text.where(text.notna() & (text != "")).ffill().fillna(st[0] or "")
        pdf[out_col] = shown
        return pdf, (shown.iloc[-1],)
    return _scan_stream(df, key, list(order), [T.StructField(out_col, T.StringType())],
                        _schema("text STRING"), ("",), step, idle_timeout=idle_timeout, time_col=time_col,
                        hold_back=hold_back, watermark=watermark)


def asof_stream(tagged: DataFrame, key: str = "camera_id", order=("ts", "side", "id"),
                value_col: str = "value", side_col: str = "side", id_col: str = "id",
                idle_timeout=None, hold_back: bool = False, watermark: str = "0 seconds") -> DataFrame:
    """F5 on a stream: both sides in one stream, tagged ``side`` 0 for a
    prediction and 1 for a frame. The latest prediction stays in state;
    every frame row is emitted with it (prediction first on equal times)."""
    def step(pdf, st):
        pred = (pdf[side_col] == 0).to_numpy()
        # Position of the latest prediction at each row; -1: the one in state.
        at = np.maximum.accumulate(np.where(pred, np.arange(len(pdf)), -1))
        ids = pd.array([_py(st[0]), *pdf[id_col]], dtype="Int64")
        vals = pd.array([_py(st[1]), *pdf[value_col]], dtype="Float64")
        pdf["pred_id"], pdf["pred_value"] = ids[at + 1], vals[at + 1]
        return pdf[~pred], (_py(ids[at[-1] + 1]), _py(vals[at[-1] + 1]))
    extra = [T.StructField("pred_id", T.LongType()), T.StructField("pred_value", T.DoubleType())]
    return _scan_stream(tagged, key, list(order), extra, _schema("pred_id BIGINT, pred_value DOUBLE"),
                        (None, None), step, idle_timeout=idle_timeout, time_col="ts",
                        hold_back=hold_back, watermark=watermark)


def tag_sides(frames: DataFrame, preds: DataFrame, key: str, ts_col: str, id_col: str,
              value_col: str) -> DataFrame:
    """Union of predictions (side 0) and frames (side 1) for ``asof_stream``."""
    p = preds.select(key, F.col(ts_col).alias("ts"), F.lit(0).alias("side"), F.col(id_col).alias("id"),
                     F.col(value_col).cast("double").alias("value"))
    f = frames.select(key, F.col(ts_col).alias("ts"), F.lit(1).alias("side"), F.col(id_col).alias("id"),
                      F.lit(None).cast("double").alias("value"))
    return p.unionByName(f)
