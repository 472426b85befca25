"""Running the operators as streams (H4, H5, D1 per micro-batch, G3).

Tests and the registered queries drive streams with ``availableNow`` over
folders written by Spark; a deployment uses ``processingTime`` triggers on
the Kafka source. Sinks are exactly-once: every micro-batch writes its own
folder, so a replayed batch overwrites rather than duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BATCH_INTERVAL
from ..functions import codec
from ..operators.select import latest_per_key, latest_per_window
from ..operators.summarize import observe_batch_metrics
from ..session import scratch_path
from ..sources import streams
from ..sources import tables as TB


def drain_to_table(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over everything available into a parquet table and
    return the table as a batch DataFrame."""
    q = (stream.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint or path + "-ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def drain_results(records: DataFrame, path: str, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A4 as one stream with two tables under ``path``: readable results and
    the quarantine. Every micro-batch writes one folder per table, named by
    its id and overwritten when the batch is repeated, so neither table loses
    or doubles an event. Returns both tables."""
    spark, names = records.sparkSession, ("results", "quarantine")

    def handle(batch, batch_id):
        batch = batch.persist()  # two tables, one read of the source
        for name, part in zip(names, streams.parse_results(batch)):
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        batch.unpersist()

    handle(spark.createDataFrame([], "value STRING"), -1)  # both tables exist, also without any event
    run_batches(records, handle, checkpoint or path + "-ckpt").awaitTermination()
    return tuple(spark.read.parquet(f"{path}/{name}").drop("batch") for name in names)


def run_batches(stream: DataFrame, handle, checkpoint: str, available_now: bool = True,
                interval: str = BATCH_INTERVAL):
    """H4: micro-batches of ``stream`` handed to ``handle(batch_df, batch_id)``;
    1 s batches by default, or all available data then stop."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def newest_frame_per_camera(batch: DataFrame) -> DataFrame:
    """D1 within one micro-batch: the newest frame of each camera, ties by
    partition and offset (last read wins)."""
    return latest_per_key(batch, ["camera_id"], ["event_ts", "partition", "offset"])


def replay_latest_per_day(spark: SparkSession, frames: DataFrame) -> DataFrame:
    """H4 + A1 + D1 as a stream: the frames of each day form one file, the
    stream takes one file per micro-batch, and each batch keeps the newest
    frame per camera and day. The sink holds one winner per batch; merging
    them gives the same rows as D1 with batch = day."""
    src = scratch_path(spark, "replay-days")
    f = frames.withColumn("_day", F.date_format("ts", "yyyy-MM-dd"))
    (TB.messages(f, keep=["_day"]).select("partition", "offset", "value", "_day")
     .write.partitionBy("_day").json(src))
    stream = streams.frame_source(spark, "json", path=src + "/*", streaming=True, max_files_per_trigger=1)
    out = scratch_path(spark, "replay-days-out")

    def handle(batch: DataFrame, batch_id: int):
        if batch.isEmpty():  # C6: nothing to process in this micro-batch
            return
        b = batch.withColumn("batch_day", F.date_format("event_ts", "yyyy-MM-dd"))
        r = latest_per_key(b.select("batch_day", "camera_id", "event_ts", "partition", "offset"),
                           ["batch_day", "camera_id"], ["event_ts", "partition", "offset"])
        (r.select("batch_day", F.col("camera_id").cast("bigint").alias("camera_id"),
                  F.col("offset").alias("frame_id"), codec.ts_text("event_ts").alias("ts"))
         .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))

    run_batches(stream, handle, out + "-ckpt").awaitTermination()
    merged = spark.read.parquet(out).drop("batch")
    return latest_per_key(merged, ["batch_day", "camera_id"], ["ts", "frame_id"]) \
        .select("batch_day", "camera_id", "frame_id", "ts")


def replay_with_late_rows(spark: SparkSession, frames: DataFrame, watermark: str = "1 day") -> DataFrame:
    """H5: frames replayed in two runs of one stream: first the newer half
    (from the midpoint of the time range on), then the older half. D2 (newest
    frame per camera per day window) runs with a watermark of ``watermark``:
    windows are emitted once the watermark passes their end, and the older
    rows, behind the watermark by then, are dropped as late.

    Event times are read as UTC wall-clock time, so the day windows do not
    depend on the session time zone; window starts are reported in epoch
    microseconds."""
    src = scratch_path(spark, "replay-late")
    out, ckpt = scratch_path(spark, "replay-late-out"), scratch_path(spark, "replay-late-ckpt")
    tz = spark.conf.get("spark.sql.session.timeZone")
    for i, part in enumerate(_halves(spark, frames)):
        part.write.json(f"{src}/f{i}")
        stream = streams.frame_source(spark, "json", path=src + "/*", streaming=True)
        stream = observe_batch_metrics(stream).withColumn("event_ts", F.from_utc_timestamp("event_ts", tz))
        d2 = latest_per_window(stream.select("camera_id", "event_ts", "partition", "offset"), "camera_id",
                               "event_ts", "1 day", order=["partition", "offset"], watermark=watermark)
        drain_to_table(d2, out, ckpt)
    return spark.read.parquet(out).select(F.unix_micros("window_start").alias("window_start_us"),
                                          F.col("camera_id").cast("bigint").alias("camera_id"),
                                          F.col("offset").alias("frame_id"))


def _halves(spark: SparkSession, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frames' messages from the midpoint of their time range on, and
    those before it."""
    recs = TB.messages(frames, keep=["ts"]).select("partition", "offset", "value", "ts")
    cut = frames.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(F.timestamp_add(
        "MICROSECOND", F.expr("timestampdiff(MICROSECOND, lo, hi) div 2"), F.col("lo"))).scalar()
    return recs.where(F.col("ts") >= cut).drop("ts"), recs.where(F.col("ts") < cut).drop("ts")


def split_late_halves(spark: SparkSession, frames: DataFrame, delay: str = "1 day"):
    """The newer half of the frames, then the older one, through ``LateSplit``
    by day windows: nearly all of the older half is late."""
    from .late import LateSplit
    src, out = scratch_path(spark, "split-late"), scratch_path(spark, "split-late-out")
    tz = spark.conf.get("spark.sql.session.timeZone")
    split = LateSplit(spark, out, delay=delay, window="1 day")
    for i, part in enumerate(_halves(spark, frames)):
        part.write.json(f"{src}/f{i}")
        stream = streams.frame_source(spark, "json", path=src + "/*", streaming=True)
        stream = stream.select("camera_id", F.from_utc_timestamp("event_ts", tz).alias("event_ts"), "partition", "offset")
        split.run(stream, out + "/ckpt").awaitTermination()
    return split


def count_labels(frames: DataFrame, lists, window: str = "1 day", watermark: str = "1 day", ts_col: str = "event_ts",
                 key: str = "camera_id") -> DataFrame:
    """G1 on a stream: detections per (window, camera, label) of the frames'
    lists, in append mode. A window is emitted and its state dropped once the
    watermark has passed its end, so state holds the open windows only. The
    counts are partial in each task before they are shuffled."""
    labels = F.explode(F.transform(lists, lambda d: d["label"])).alias("label")
    x = frames.withWatermark(ts_col, watermark).select(ts_col, key, labels)
    return (x.groupBy(F.window(ts_col, window).alias("window"), key, "label").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("window_start"), key, "label", "n"))


def count_samples(numbered: DataFrame, detectors, window: str = "1 day", watermark: str = "0 seconds",
                  ts_col: str = "event_ts", key: str = "camera_id") -> DataFrame:
    """E3 on a stream of numbered frames (``seq``, in time order): per
    (window, camera) the frames seen and the samples of each detector, in
    append mode. Numbering is keyed state of its own, and Spark allows no
    second stateful operator after it in a query, so the numbered frames are a
    table between two queries (``replay_cycles``)."""
    samples = [F.count_if(F.col("seq") % d.rate == 0).alias(f"n_{d.name}") for d in detectors]
    return (numbered.withWatermark(ts_col, watermark).groupBy(F.window(ts_col, window).alias("window"), key)
            .agg(F.count(F.lit(1)).alias("n_frames"), *samples)
            .select(F.col("window.start").alias("window_start"), key, "n_frames", *[f"n_{d.name}" for d in detectors]))


def _event_stream(spark: SparkSession, frames: DataFrame) -> DataFrame:
    """The frames as a stream: camera_id, event_ts, offset, k."""
    src, tz = scratch_path(spark, "replay-counts"), spark.conf.get("spark.sql.session.timeZone")
    TB.messages(frames).select("partition", "offset", "value").write.json(src)
    return streams.frame_source(spark, "json", path=src, streaming=True).select(
        "camera_id", F.from_utc_timestamp("event_ts", tz).alias("event_ts"), "offset",
        F.get_json_object(F.col("image").cast("string"), "$.k").cast("int").alias("k"))


def replay_counts(spark: SparkSession, frames: DataFrame) -> DataFrame:
    """The frames as a stream through ``count_labels``: windows that the
    watermark has closed."""
    from ..functions.lists import stub_prediction_list
    counts = count_labels(_event_stream(spark, frames), stub_prediction_list("k"))
    return drain_to_table(counts, scratch_path(spark, "replay-counts-out"))


def replay_cycles(spark: SparkSession, frames: DataFrame, detectors, delay: str = "1 day") -> DataFrame:
    """The frames numbered by one stream, which holds them back until the
    watermark passes them, and counted by a second one."""
    from .state import sample_every_n_stream
    numbered = sample_every_n_stream(_event_stream(spark, frames).drop("k"), 1, hold_back=True, watermark=delay)
    table = scratch_path(spark, "numbered")
    schema = drain_to_table(numbered, table).schema
    counts = count_samples(spark.readStream.schema(schema).parquet(table), detectors)
    return drain_to_table(counts, scratch_path(spark, "replay-cycles-out"))
