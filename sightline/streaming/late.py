"""H5 without loss: late rows are split off before a stateful operator.

Spark drops rows behind the watermark inside the operator and only counts
them. Here every micro-batch is divided first, by the same rule: the watermark
is the newest event time of all batches before, less the delay, and a row is
late when the window it belongs to ended at or before it. Rows in time and
late rows are two folders of one table, written together per batch id, and a
row of counts per batch says how many there were; a repeated batch replaces
all three. The stateful query reads the rows in time and drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .pipeline import run_batches
from .state import duration_ms

_COUNTS = "n_rows BIGINT, n_late BIGINT, watermark_us BIGINT, newest_us BIGINT"


class LateSplit:
    """The tables of a split under ``root``: ``rows`` (folders batch= and
    late=) and ``counts`` (folder batch=)."""

    def __init__(self, spark: SparkSession, root: str, ts_col: str = "event_ts", delay="1 day", window: str | None = None):
        self.spark, self.root, self.ts_col, self.window = spark, root.rstrip("/"), ts_col, window
        self.delay_us = duration_ms(delay) * 1000

    def watermark_us(self, batch_id: int) -> int | None:
        """The watermark that a batch is judged by; None before any row."""
        if batch_id == 0:
            return None
        before = self.counts().where(F.col("batch") < batch_id)  # one row a batch
        newest = before.agg(F.max("newest_us")).first()[0]
        return None if newest is None else newest - self.delay_us

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        mark = self.watermark_us(batch_id)
        us = F.unix_micros(F.col(self.ts_col).cast("timestamp"))
        end = F.unix_micros(F.window(self.ts_col, self.window)["end"].cast("timestamp")) if self.window else us
        late = F.coalesce(end <= F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
        seen = Observation()
        rows = batch.withColumn("late", late).observe(
            seen, F.count(F.lit(1)).alias("n_rows"), F.count_if("late").alias("n_late"), F.max(us).alias("newest_us"))
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{self.root}/rows/batch={batch_id}")
        n = seen.get
        counts = [(n["n_rows"], n["n_late"], mark, n["newest_us"])]
        (self.spark.createDataFrame(counts, _COUNTS).coalesce(1)
         .write.mode("overwrite").json(f"{self.root}/counts/batch={batch_id}"))

    def run(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        return run_batches(stream, self.handle, checkpoint, available_now)

    def counts(self) -> DataFrame:
        """batch, n_rows, n_late, the watermark it was judged by, newest_us."""
        return self.spark.read.schema(_COUNTS + ", batch BIGINT").json(f"{self.root}/counts")

    def late(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows").where(F.col("late").cast("boolean")).drop("late", "batch")

    def in_time(self) -> DataFrame:
        """The rows in time as a stream, for the stateful operator."""
        schema = self.spark.read.parquet(f"{self.root}/rows").drop("late", "batch").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.root}/rows/batch=*/late=false")
