"""Dimension sources: label names files, model configs, event label maps
(A5-A7). They are small in practice but are read as distributed jobs: no
file is read whole into one task or the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sequence import join_small

_STRIP = r"(?U)^\s+|\s+$"


def strip_text(col) -> F.Column:
    """Whitespace removed at both ends (Unicode spaces included)."""
    return F.regexp_replace(col, _STRIP, "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one text file, or of a folder of part files in name order,
    with their 0-based line number.

    Every line belongs to exactly one file block, and a block is read in
    order by one task. The line number is the position inside the block plus
    the count of lines of all earlier blocks, which comes from a table with
    one row per block."""
    t = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"))
    blocks = t.groupBy("_f", "_b").agg(F.min("_m").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    # One row per file block: ordering all blocks in one window is cheap.
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_f", "_b", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (join_small(t, blocks, ["_f", "_b"], "inner")
            .select((F.col("_m") - F.col("_m0") + F.col("_off")).alias("line_no"), "value"))


def read_label_file(spark: SparkSession, path: str) -> DataFrame:
    """A5: names file to (label_id, label): the line number is the class id
    and each line is stripped."""
    return numbered_lines(spark, path).select(F.col("line_no").alias("label_id"),
                                              strip_text(F.col("value")).alias("label"))


MODEL_CONFIG_SCHEMA = T.StructType([
    T.StructField("weights", T.StringType()), T.StructField("config", T.StringType()),
    T.StructField("pb", T.StringType()), T.StructField("meta", T.StringType()),
    T.StructField("offset", T.IntegerType()), T.StructField("classes", T.IntegerType()),
    T.StructField("labels", T.StringType()),
])


def read_model_registry(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Model config JSON files (``<model>/<model>.json``) to one row per
    model. The model name is the config's folder; file names inside a config
    are resolved against that folder (``*_path`` columns)."""
    r = (spark.read.schema(MODEL_CONFIG_SCHEMA).option("multiLine", multiline)
         .option("recursiveFileLookup", "true").json(path)
         .withColumn("_file", F.col("_metadata.file_path")))
    folder = F.regexp_extract("_file", r"^(.*)/[^/]+$", 1)
    model = F.regexp_replace(F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1), r"^model=", "")
    out = r.select(model.alias("model"), "*", folder.alias("_dir"))
    for c in ("weights", "config", "pb", "meta", "labels"):
        out = out.withColumn(f"{c}_path", F.when(F.col(c).isNotNull(),
                                                  F.concat(F.col("_dir"), F.lit("/"), F.col(c))))
    return out.drop("_file", "_dir")


def event_label_map(df: DataFrame, json_col: str = "value") -> DataFrame:
    """JSON objects with integer-like keys to (label_id, name) rows."""
    m = F.from_json(F.col(json_col), T.MapType(T.StringType(), T.StringType()))
    return (df.select(F.explode(m).alias("_k", "name"))
            .select(F.col("_k").cast("bigint").alias("label_id"), "name"))
