"""Batch/stream equality for the keyed-state operators, including a
restart from the checkpoint in the middle of the input."""

import tempfile

from pyspark.sql import functions as F

from sightline import config as C
from sightline.operators import combine, ordered, select
from sightline.sources import streams, tables as TB
from sightline.streaming import state

from .conftest import SF_SMALL


def _write_parts(df, order_col, n_parts, root):
    """Rows split into ``n_parts`` ranges of ``order_col``, one file each,
    written in order (a stream takes one file per micro-batch)."""
    bounds = df.approxQuantile(order_col, [i / n_parts for i in range(1, n_parts)], 0.0)
    lo = None
    for i, hi in enumerate(bounds + [None]):
        part = df
        if lo is not None:
            part = part.where(F.col(order_col) > lo)
        if hi is not None:
            part = part.where(F.col(order_col) <= hi)
        part.coalesce(1).write.mode("overwrite").parquet(f"{root}/p{i}")
        lo = hi


def _run(stream_df, out, ckpt):
    q = (stream_df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _frames_stream(spark, src):
    recs = spark.readStream.schema("partition INT, offset BIGINT, value STRING").option(
        "maxFilesPerTrigger", 1).parquet(src + "/*")
    return streams.parse_records(recs.withColumn("ingest_ts", F.current_timestamp()))[0]


def test_sample_every_n_stream_restart(spark):
    d = tempfile.mkdtemp(prefix="st-e1-")
    f = TB.frames(spark, SF_SMALL)
    msgs = TB.messages(f).select("partition", "offset", "value")
    _write_parts(msgs, "offset", 4, d + "/all")
    # first run sees only the first file; the second run resumes from state
    import shutil
    import os
    os.makedirs(d + "/src")
    shutil.copytree(d + "/all/p0", d + "/src/p0")
    out, ckpt = d + "/out", d + "/ckpt"
    s = state.sample_every_n_stream(_frames_stream(spark, d + "/src"), 5).select("camera_id", "offset", "seq")
    _run(s, out, ckpt)
    first = spark.read.parquet(out).count()
    for i in (1, 2, 3):
        shutil.copytree(f"{d}/all/p{i}", f"{d}/src/p{i}")
    s = state.sample_every_n_stream(_frames_stream(spark, d + "/src"), 5).select("camera_id", "offset", "seq")
    _run(s, out, ckpt)
    got = sorted((int(r.camera_id), r.offset, r.seq) for r in spark.read.parquet(out).collect())
    ref = select.sample_every_n(TB.frames_seq(spark, SF_SMALL), 5)
    exp = sorted((r.camera_id, r.frame_id, r.seq) for r in ref.collect())
    assert 0 < first < len(got)
    assert got == exp


def test_rolling_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="st-h1-")
    feats = TB.features(spark, SF_SMALL)
    _write_parts(feats, "vec_id", 3, d + "/src")
    s = spark.readStream.schema(feats.schema).option("maxFilesPerTrigger", 1).parquet(d + "/src/*")
    _run(state.rolling_stream(s, C.ACTIVITY_SEQUENCE_LENGTH).select("camera_id", "seq", "ids"),
         d + "/out", d + "/ckpt")
    got = sorted((r.camera_id, r.seq, tuple(r.ids)) for r in spark.read.parquet(d + "/out").collect())
    ref = ordered.rolling_features(TB.features_seq(spark, SF_SMALL)).collect()
    assert got == sorted((r.camera_id, r.seq, tuple(r.ids)) for r in ref)


def test_carry_text_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="st-h2-")
    f = TB.frames(spark, SF_SMALL).withColumn(
        "text", F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")))
    src = f.select("camera_id", "ts", "frame_id", "text")
    _write_parts(src, "frame_id", 3, d + "/src")
    s = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(d + "/src/*")
    _run(state.carry_text_stream(s, order=("ts", "frame_id")).select("frame_id", "shown_text"),
         d + "/out", d + "/ckpt")
    got = sorted(tuple(r) for r in spark.read.parquet(d + "/out").collect())
    fs = TB.frames_seq(spark, SF_SMALL, ["event_type"]).withColumn(
        "text", F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")))
    ref = sorted(tuple(r) for r in ordered.carry_forward_text(fs).select("frame_id", "shown_text").collect())
    assert got == ref


def test_asof_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="st-f5-")
    f = TB.frames(spark, SF_SMALL)
    fv = f.where(F.col("event_type") == "view")
    pv = f.where(F.col("event_type") == "signup")
    tagged = state.tag_sides(fv, pv, "camera_id", "ts", "frame_id", "value")
    _write_parts(tagged.withColumn("o", F.col("id")), "o", 3, d + "/src")
    s = spark.readStream.schema(tagged.schema.add("o", "long")).option("maxFilesPerTrigger", 1) \
        .parquet(d + "/src/*").drop("o")
    _run(state.asof_stream(s).select("id", "pred_id", "pred_value"), d + "/out", d + "/ckpt")
    got = sorted(tuple(r) for r in spark.read.parquet(d + "/out").collect())
    ref = combine.asof_prediction(fv.select("camera_id", "ts", "frame_id"),
                                  pv.select("camera_id", "ts", "frame_id", "value"),
                                  "camera_id", "ts", "frame_id", ["value"])
    exp = sorted((r.frame_id, r.pred_frame_id, r.pred_value) for r in ref.collect())
    assert got == exp


def test_idle_camera_state_is_evicted(spark):
    # Idle by processing time: camera 1 sends nothing while camera 2's batch
    # runs, so its state goes; run 2 (same checkpoint): camera 1 starts afresh.
    import os
    import shutil
    import time

    d = tempfile.mkdtemp(prefix="st-evict-")
    batches = [[(1, 0, 10), (1, 1, 11)], [(2, 2, 20)], [(1, 3, 30)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "camera_id int, offset long, t long") \
            .withColumn("event_ts", F.timestamp_seconds("t")).drop("t").coalesce(1) \
            .write.parquet(f"{d}/all/p{i}")

    def run(expected):
        s = spark.readStream.schema("camera_id int, offset long, event_ts timestamp") \
            .option("maxFilesPerTrigger", 1).parquet(d + "/src/*")
        q = (state.sample_every_n_stream(s, 1, idle_timeout="1 millisecond").writeStream.format("parquet")
             .option("path", d + "/out").option("checkpointLocation", d + "/ckpt")
             .trigger(processingTime="100 milliseconds").start())
        for _ in range(600):  # until all rows came out and one more batch evicted what is idle
            if os.path.isdir(d + "/out/_spark_metadata") and \
                    spark.read.schema("camera_id int").parquet(d + "/out").count() == expected:
                time.sleep(3)
                break
            time.sleep(0.2)
        q.stop()
    for i in (0, 1):
        shutil.copytree(f"{d}/all/p{i}", f"{d}/src/p{i}")
    run(3)
    shutil.copytree(f"{d}/all/p2", f"{d}/src/p2")
    run(4)
    got = sorted((r.camera_id, r.offset, r.seq) for r in spark.read.parquet(d + "/out").collect())
    assert got == [(1, 0, 0), (1, 1, 1), (1, 3, 0), (2, 2, 0)]


def _out_of_order_messages(spark, d):
    """Messages in 4 files: days 1-10 and 16-20, then days 11-15 (arriving
    late but within a 10-day watermark), then days 21-31, then one frame of
    another camera far in the future that moves the watermark past all."""
    import datetime as dt

    f = TB.frames(spark, SF_SMALL)
    m = TB.messages(f, keep=["ts"]).select("partition", "offset", "value", "ts")
    day = F.dayofmonth("ts")
    parts = [m.where((day <= 10) | ((day >= 16) & (day <= 20))), m.where((day >= 11) & (day <= 15)),
             m.where(day >= 21)]
    for i, p in enumerate(parts):
        p.drop("ts").coalesce(1).write.json(f"{d}/src/p{i}")
    closing = spark.createDataFrame([(0, 10 ** 9, dt.datetime(2024, 3, 1), -1, "{}")],
                                    "camera_id long, frame_id long, ts timestamp_ntz, k int, props string")
    TB.messages(closing).select("partition", "offset", "value").coalesce(1).write.json(f"{d}/src/p3")


def test_hold_back_orders_late_rows(spark):
    d = tempfile.mkdtemp(prefix="st-hold-")
    _out_of_order_messages(spark, d)
    s = streams.frame_source(spark, "json", path=d + "/src/*", streaming=True, max_files_per_trigger=1)
    e1 = state.sample_every_n_stream(s, 5, hold_back=True, watermark="10 days")
    q = (e1.select("camera_id", "offset", "seq").writeStream.format("parquet").option("path", d + "/out")
         .option("checkpointLocation", d + "/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert not q.isActive
    got = sorted((int(r.camera_id), r.offset, r.seq) for r in spark.read.parquet(d + "/out").collect()
                 if r.offset != 10 ** 9)
    ref = select.sample_every_n(TB.frames_seq(spark, SF_SMALL), 5)
    assert got == sorted((r.camera_id, r.frame_id, r.seq) for r in ref.collect())


def test_without_hold_back_late_rows_differ(spark):
    # The same input without hold-back numbers frames in arrival order.
    d = tempfile.mkdtemp(prefix="st-nohold-")
    _out_of_order_messages(spark, d)
    s = streams.frame_source(spark, "json", path=d + "/src/*", streaming=True, max_files_per_trigger=1)
    q = (state.sample_every_n_stream(s, 5).select("camera_id", "offset", "seq").writeStream
         .format("parquet").option("path", d + "/out").option("checkpointLocation", d + "/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted((int(r.camera_id), r.offset, r.seq) for r in spark.read.parquet(d + "/out").collect()
                 if r.offset != 10 ** 9)
    ref = select.sample_every_n(TB.frames_seq(spark, SF_SMALL), 5)
    assert got != sorted((r.camera_id, r.frame_id, r.seq) for r in ref.collect())
