"""Unions, dimension lookups, colours, as-of pairing and standing state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_COLOUR
from .sequence import carry_last, join_small, keyed_sequence


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def union_detections(parts: list[DataFrame], frame_keys, pos_col: str = "pos",
                     out_col: str = "union_pos") -> DataFrame:
    """concatenate per-detector detection lists, in the given detector
    order, keeping duplicates. ``out_col`` is the position in the combined
    list. The window is per frame, whose list is bounded by the detectors'
    output size."""
    keys = _cols(frame_keys)
    tagged = [p.withColumn("detector_order", F.lit(i)) for i, p in enumerate(parts)]
    u = tagged[0]
    for p in tagged[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy(*keys).orderBy("detector_order", pos_col)
    return u.withColumn(out_col, (F.row_number().over(w) - 1).cast("int"))


def label_lookup(df: DataFrame, labels: DataFrame, idx_col: str,
                 label_id_col: str = "label_id", label_col: str = "label") -> DataFrame:
    """class index to name through a label dimension (left join; an
    unknown index gives NULL)."""
    dim = labels.select(F.col(label_id_col).alias(idx_col), F.col(label_col).alias(label_col))
    return join_small(df, dim, idx_col, "left")


def palette_colours(i, n) -> dict[str, Column]:
    """colour of label number ``i`` among ``n`` labels. With
    b = ceil(n^(1/3)): blue = |2 - i/b^2|, red = |2 - (i mod b^2)/b|,
    green = |2 - (i mod b^2) mod b|, each times 127 (true division, not
    clamped)."""
    base = F.ceil(F.pow(n.cast("double"), F.lit(1.0 / 3.0))).cast("bigint")
    sq = base * base
    rem = i % sq
    return {
        "blue": F.abs(F.lit(2.0) - i / sq) * 127,
        "red": F.abs(F.lit(2.0) - rem / base) * 127,
        "green": (F.abs(F.lit(2) - rem % base) * 127).cast("double"),
    }


def label_palette(labels: DataFrame, label_id_col: str = "label_id") -> DataFrame:
    """F3 over a label dimension. The label count enters as a scalar
    subquery, so the palette is one pass over the dimension."""
    n = labels.agg(F.count(F.lit(1))).scalar()
    cols = palette_colours(F.col(label_id_col), n)
    return labels.select("*", *[c.alias(k) for k, c in cols.items()])


def palette_map(label_lists: list[list[str]]) -> Column:
    """F3 over several models as a literal map label -> (blue, red, green):
    the label lists are numbered one after the other, so n is the number of
    all labels; a label listed twice keeps its last colour. For label lists
    of models, which are configuration."""
    names = [x for labels in label_lists for x in labels]
    last = {x: i for i, x in enumerate(names)}
    pairs = []
    for x, i in last.items():
        c = palette_colours(F.lit(i).cast("bigint"), F.lit(len(names)))
        pairs += [F.lit(x), F.struct(*[v.alias(k) for k, v in c.items()])]
    return F.create_map(*pairs)


def colour_table(palette: DataFrame, label_col: str = "label",
                 label_id_col: str = "label_id") -> DataFrame:
    """Label to colour; a label listed twice keeps its last colour."""
    return (palette.groupBy(label_col)
            .agg(F.max_by(F.struct("blue", "red", "green"), F.col(label_id_col)).alias("_c"))
            .select(label_col, "_c.*"))


def color_lookup(df: DataFrame, colours: DataFrame, label_col: str = "label") -> DataFrame:
    """colour of each row's label, the default colour when unknown."""
    c = colours.select(F.col(label_col).alias("_lab"), F.col("blue").alias("_b"),
                       F.col("red").alias("_r"), F.col("green").alias("_g"))
    x = join_small(df.withColumn("_lab", F.col(label_col)), c, "_lab", "left")
    b, r, g = DEFAULT_COLOUR
    return (x.withColumn("blue", F.coalesce("_b", F.lit(b)))
            .withColumn("red", F.coalesce("_r", F.lit(r)))
            .withColumn("green", F.coalesce("_g", F.lit(g)))
            .drop("_lab", "_b", "_r", "_g"))


def asof_prediction(frames: DataFrame, preds: DataFrame, key: str, ts_col: str, id_col: str,
                    value_cols, prefix: str = "pred_", chunk_rows: int | None = None) -> DataFrame:
    """backward as-of join per camera. Each frame gets the latest
    prediction with time at or before its own (a prediction at the same
    time counts as earlier). Both sides are tagged and unioned, numbered per
    camera by (time, side, id) with ``keyed_sequence`` and the prediction is
    carried forward with ``carry_last``; no camera is held by one task."""
    value_cols = _cols(value_cols)
    fcols = frames.columns
    p = preds.select(F.col(key), F.col(ts_col), F.col(id_col).alias("_oid"), F.lit(0).alias("_side"),
                     F.struct(F.col(id_col).alias(id_col), *[F.col(c) for c in value_cols]).alias("_p"))
    f = frames.select(F.col(key), F.col(ts_col), F.col(id_col).alias("_oid"), F.lit(1).alias("_side"),
                      F.lit(None).cast(p.schema["_p"].dataType).alias("_p"),
                      F.struct(*[F.col(c) for c in fcols]).alias("_f"))
    u = p.withColumn("_f", F.lit(None).cast(f.schema["_f"].dataType)).unionByName(f)
    u = keyed_sequence(u, [key], [ts_col, "_side", "_oid"], "_seq")
    kw = {"chunk_rows": chunk_rows} if chunk_rows else {}
    filled = carry_last(u, [key], "_seq", ["_p"], ["_pc"], **kw)
    out = filled.where(F.col("_side") == 1).select(
        *[F.col("_f")[c].alias(c) for c in fcols],
        *[F.col("_pc")[c].alias(prefix + c) for c in [id_col] + value_cols])
    return out


def prediction_state(preds: DataFrame, keys, order, value_cols) -> DataFrame:
    """the standing (latest) prediction per (camera, detector). One input
    row is a whole prediction - the list of a frame on which the detector was
    due, which may be empty - so a newer empty one replaces an older one."""
    from .select import latest_per_key
    keys = _cols(keys)
    return latest_per_key(preds.select(*keys, *_cols(order), *[c for c in _cols(value_cols)
                                                               if c not in _cols(order)]), keys, order)
