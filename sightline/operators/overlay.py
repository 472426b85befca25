"""Box overlays (I1): what would be drawn on a frame, as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BOX_LINE_WIDTH, CAPTION_OFFSET_Y, DEFAULT_COLOUR, FONT_SCALE_PER_PIXEL
from .combine import color_lookup


def box_overlays(dets: DataFrame, colours: DataFrame, height_col: str = "height") -> DataFrame:
    """Per detection a rectangle (x1, y1)-(x2, y2), a caption
    ``label confidence`` placed 13 pixels above the top-left corner (not
    clipped), font scale 0.001 x frame height, line width 1, and the
    label's colour (default colour when unknown)."""
    x = color_lookup(dets, colours, "label")
    return x.select(
        "*",
        F.concat(F.col("label"), F.lit(" "), F.col("confidence").cast("string")).alias("caption"),
        F.col("x1").alias("caption_x"),
        (F.col("y1") - CAPTION_OFFSET_Y).alias("caption_y"),
        (F.col(height_col) * FONT_SCALE_PER_PIXEL).alias("font_scale"),
        F.lit(BOX_LINE_WIDTH).alias("line_width"))


def overlay_list(preds, colours, height: int) -> Column:
    """I1 on a frame's list: what would be drawn, as ARRAY<STRUCT>. ``colours``
    is a map column label -> (blue, red, green)."""
    default = F.struct(*[F.lit(v).alias(k) for k, v in zip(("blue", "red", "green"), DEFAULT_COLOUR)])

    def box(d):
        c = F.coalesce(F.try_element_at(colours, d["label"]), default)
        return F.struct(
            d["label"].alias("label"), d["confidence"].alias("confidence"),
            *[d[k].alias(k) for k in ("x1", "y1", "x2", "y2")],
            F.concat(d["label"], F.lit(" "), d["confidence"].cast("string")).alias("caption"),
            d["x1"].alias("caption_x"), (d["y1"] - CAPTION_OFFSET_Y).alias("caption_y"),
            F.lit(height * FONT_SCALE_PER_PIXEL).alias("font_scale"), F.lit(BOX_LINE_WIDTH).alias("line_width"),
            *[c[k].alias(k) for k in ("blue", "red", "green")])

    return F.transform(preds, box)


def boxes_text(boxes) -> Column:
    """An overlay as text: per box its caption, corners, caption place and colour."""
    parts = lambda b: F.concat_ws(" ", b["caption"], *[
        F.concat_ws(",", *[F.round(b[k]).cast("int").cast("string") for k in g])
        for g in (("x1", "y1", "x2", "y2"), ("caption_x", "caption_y"), ("blue", "red", "green"))])
    return F.array_join(F.transform(boxes, parts), "; ")
