"""Stream forms of aggregate operators: F6 in update mode, G3 observed
metrics, D2 with a watermark; Kafka option building."""

import tempfile

from pyspark.sql import functions as F

from sightline.operators import combine, summarize
from sightline.sources import streams, tables as TB

from .conftest import SF_SMALL


def _frames_stream(spark, d):
    f = TB.frames(spark, SF_SMALL)
    TB.messages(f).select("partition", "offset", "value").write.json(d + "/src")
    return streams.frame_source(spark, "json", path=d + "/src", streaming=True, max_files_per_trigger=2)


def test_prediction_state_update_mode(spark):
    d = tempfile.mkdtemp(prefix="st-f6-")
    s = _frames_stream(spark, d).withColumn("detector", F.lit("object"))
    state = combine.prediction_state(s, ["camera_id", "detector"], ["event_ts", "offset"], ["timestamp"])
    q = (state.writeStream.outputMode("update").format("memory").queryName("f6_state")
         .option("checkpointLocation", d + "/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.sql("SELECT * FROM f6_state").collect()
    latest = {}
    for r in rows:  # updates arrive in batch order; the last one stands
        latest[r.camera_id] = r.offset
    f = TB.frames(spark, SF_SMALL)
    exp = {str(r.camera_id): r.frame_id for r in
           f.groupBy("camera_id").agg(F.max_by("frame_id", F.struct("ts", "frame_id")).alias("frame_id")).collect()}
    assert latest == exp


def test_observed_batch_metrics(spark):
    d = tempfile.mkdtemp(prefix="st-g3-")
    s = summarize.observe_batch_metrics(_frames_stream(spark, d))
    q = (s.writeStream.format("noop").option("checkpointLocation", d + "/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    seen = [p["observedMetrics"]["batch_metrics"] for p in q.recentProgress
            if p.get("observedMetrics", {}).get("batch_metrics")]
    assert sum(m["n_messages"] for m in seen) == TB.frames(spark, SF_SMALL).count()
    assert all(m["n_cameras_approx"] > 0 for m in seen)


def test_kafka_options():
    o = streams.kafka_options("broker:9092", "test", max_offsets_per_trigger=100)
    assert o["kafka.bootstrap.servers"] == "broker:9092"
    assert o["subscribe"] == "test" and o["maxOffsetsPerTrigger"] == "100"
    assert o["startingOffsets"] == "latest" and o["failOnDataLoss"] == "true"
    assert streams.kafka_options("b", fail_on_data_loss=False)["failOnDataLoss"] == "false"


def test_processing_time_trigger_runs_batches(spark):
    # A running query with a 1 s trigger picks up files that arrive later.
    import time

    from sightline.streaming import pipeline
    d = tempfile.mkdtemp(prefix="st-h4-")
    s = _frames_stream(spark, d)
    seen = []

    def handle(batch, batch_id):
        seen.append((batch_id, pipeline.newest_frame_per_camera(batch).count()))

    def wait_for(n):
        deadline = time.time() + 60
        while time.time() < deadline and len(seen) < n:
            time.sleep(0.5)

    q = pipeline.run_batches(s, handle, d + "/ckpt", available_now=False, interval="1 second")
    try:
        wait_for(1)
        f = TB.frames(spark, SF_SMALL).limit(10)
        TB.messages(f).select("partition", "offset", "value").write.mode("append").json(d + "/src")
        wait_for(2)
    finally:
        q.stop()
    assert len(seen) >= 2 and all(n > 0 for _, n in seen[:2])
