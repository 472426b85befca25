"""The flagship as a stream equals the batch flagship over the frames the
stream keeps (the newest per camera in every micro-batch)."""

import datetime as dt
import json
import os
import random
import tempfile
import time

from pyspark.sql import functions as F

from sightline import config as C
from sightline.operators import scoring, select
from sightline.plans import annotate
from sightline.sources import streams
from sightline.sources import tables as TB
from sightline.streaming import annotation
from sightline.streaming.annotation import run_annotation, stub_scorers
from sightline.streaming.progress import ProgressTable

from .conftest import SF_SMALL

T0 = dt.datetime(2024, 1, 1)


def _write(spark, path, rows):
    """Rows (camera, frame, ts, k) as one file of frame records."""
    df = spark.createDataFrame(rows, "camera_id long, frame_id long, ts timestamp_ntz, k int")
    df = df.withColumn("props", F.format_string('{"k": %d}', "k"))
    TB.messages(df).select("partition", "offset", "value").coalesce(1).write.json(path)


def _run(spark, d, **kw):
    q = run_annotation(spark, d + "/src/*", d + "/out", d + "/ckpt", stub_scorers(),
                       **{"freshness": False, "max_files_per_trigger": 1, **kw})
    q.awaitTermination(300)
    assert not q.isActive and q.exception() is None
    return q


def _results(spark, d):
    rows = streams.result_source(spark, "json", d + "/out", streaming=False).collect()
    return sorted((r.camera_id, r.timestamp, r.prediction) for r in rows)


def test_stream_equals_batch_on_kept_frames(spark):
    for rates in ((5, 5), (5, 3)):
        cfg = C.PipelineConfig(detectors=(C.Detector("object", rates[0], C.OBJECT_THRESHOLD),
                                          C.Detector("firearm", rates[1], C.FIREARM_THRESHOLD)))
        d = tempfile.mkdtemp(prefix="st-i2-")
        f = TB.frames(spark, SF_SMALL).withColumn("_day", F.date_format("ts", "yyyy-MM-dd"))
        msgs = TB.messages(f, keep=["_day", "ts"])
        days = sorted(r._day for r in msgs.select("_day").distinct().collect())[:12]
        f = f.where(F.col("_day").isin(days))
        half = len(days) // 2
        for part in (days[:half], days[half:]):  # the second run restarts from the checkpoint
            for day in part:  # one file per day, written in day order
                (msgs.where(F.col("_day") == day).select("partition", "offset", "value")
                 .coalesce(1).write.json(f"{d}/src/{day}"))
            _run(spark, d, config=cfg, idle_timeout="30 days")
        kept = select.latest_per_key(f.select("_day", "camera_id", "ts", "frame_id", "k"),
                                     ["_day", "camera_id"], ["ts", "frame_id"]).drop("_day")
        ref = annotate.annotated_results(kept, cfg)
        assert _results(spark, d) == sorted((str(r.camera_id), r.timestamp, r.prediction) for r in ref.collect())


def test_lagging_and_returning_cameras_lose_nothing(spark):
    """Cameras behind others, a batch that jumps back in time and a camera
    that was silent: every newest frame comes out, whatever its time."""
    d = tempfile.mkdtemp(prefix="st-i2-lag-")
    files = [[(7, 1, T0 - dt.timedelta(days=1), 13), (8, 2, T0, 0)], [(7, 3, T0 - dt.timedelta(hours=9), 0), (8, 4, T0, 2)],
             [(8, 5, T0 - dt.timedelta(days=10), 1)], [(7, 6, T0, 0)]]
    for i, rows in enumerate(files):
        _write(spark, f"{d}/src/p{i}", rows)
    _run(spark, d, idle_timeout="30 days")
    got = _results(spark, d)
    assert len(got) == 6
    first = [p for c, _, p in got if c == "7"]
    assert first[0] != "" and len(set(first)) == 1  # the text stays


def test_idle_camera_starts_afresh(spark):
    d = tempfile.mkdtemp(prefix="st-i2-idle-")
    _write(spark, f"{d}/src/p0", [(7, 1, T0, 13), (8, 2, T0, 13)])
    _run(spark, d, idle_timeout=0)
    _write(spark, f"{d}/src/p1", [(8, 3, T0, 0)])  # camera 7 is silent and is forgotten
    _run(spark, d, idle_timeout=0)
    _write(spark, f"{d}/src/p2", [(7, 4, T0, 0)])
    _run(spark, d, idle_timeout=0)
    state = {r.camera_id: r for r in spark.read.parquet(d + "/ckpt/camera-state/changes").where("batch = 2").collect()}
    assert state["7"].seq == 0 and state["7"].prediction == ""


def test_stale_frames_are_dropped_by_a_clock_column(spark):
    rows = [("c", T0, "t1", b'{"k": 13}', 0, 1, T0 + dt.timedelta(seconds=5, milliseconds=900)),
            ("c", T0 + dt.timedelta(seconds=1), "t2", b'{"k": 2}', 0, 2, T0 + dt.timedelta(seconds=7)),
            ("d", T0, "t3", b'{"k": 13}', 0, 3, T0 - dt.timedelta(seconds=1))]
    df = spark.createDataFrame(rows, "camera_id string, event_ts timestamp_ntz, timestamp string, image binary, "
                                     "partition int, offset long, clock timestamp_ntz")
    got = annotation.annotate_batch(df, None, stub_scorers(), now="clock").collect()
    assert [(r.camera_id, r.offset, r.seq) for r in got] == [("c", 1, 0)]
    assert got[0].boxes[0].caption_y == got[0].boxes[0].y1 - 13 and bytes(got[0].image) == b'{"k": 13}'


def test_no_image_is_shuffled(spark, capsys):
    rows = [("c", T0, "t1", b'{"k": 13}', 0, 1)]
    df = spark.createDataFrame(rows, "camera_id string, event_ts timestamp_ntz, timestamp string, image binary, "
                                     "partition int, offset long")
    out = annotation.annotate_batch(df, None, stub_scorers(), freshness=False)
    out.explain("formatted")
    plan = capsys.readouterr().out
    exchanges = [p for p in plan.split("\n\n") if "Exchange" in p.split("\n")[0]]
    assert not any("image" in p for p in exchanges)


def test_rates_change_while_the_query_runs(spark):
    d = tempfile.mkdtemp(prefix="st-i2-cfg-")
    for i in range(4):
        _write(spark, f"{d}/src/p{i}", [(7, i, T0 + dt.timedelta(seconds=i), 1)])
    asked = []

    def config():
        asked.append(1)
        return C.PipelineConfig(detectors=(C.Detector("object", 1, 0.0, enabled=len(asked) > 2),))

    _run(spark, d, config=config)
    assert [bool(p) for _, _, p in _results(spark, d)] == [False, False, True, True]


def test_quarantine_is_a_second_sink_of_the_query(spark):
    d = tempfile.mkdtemp(prefix="st-i2-bad-")
    _write(spark, f"{d}/src/p0", [(7, 1, T0, 13)])
    spark.createDataFrame([(0, 9, "{broken")], "partition int, offset long, value string").coalesce(1).write.json(f"{d}/src/p1")
    _run(spark, d, quarantine_path=d + "/bad")
    bad = [json.loads(r.value) for r in spark.read.text(d + "/bad").collect()]
    assert [(b["offset"], b["reason"]) for b in bad] == [(9, "malformed_json")] and len(_results(spark, d)) == 1


def test_state_is_a_base_and_changes(spark, tmp_path, monkeypatch):
    """A batch writes its own cameras only; repeats and compactions keep the
    newest row of every camera."""
    monkeypatch.setattr(annotation.CameraState, "COMPACT", 3)
    kind = "camera_id string, seq long, prediction string, seen_ms long"
    store = annotation.CameraState(spark, str(tmp_path / "state"), spark.createDataFrame([], kind).schema)
    all_buckets = list(range(store.BUCKETS))
    want, rng = {}, random.Random(1)
    every = spark.createDataFrame([(str(c),) for c in range(40)] + [(None,)], "camera_id string")

    def rows(n):
        cams = rng.sample([*range(40), None], 3 if n else 41)
        return [(None if c is None else str(c), n * 100 + (c or 0), "x" * n, n) for c in cams]

    def check(n):
        got = store.rows(n, every, True, all_buckets).collect()
        assert {r.camera_id: (r.seq, r.prediction) for r in got} == want and len(got) == len(want)

    for n in range(11):
        batch = rows(n)
        for _ in range(2):  # a repeated batch sees what was before it and replaces its own
            if n:
                check(n)
            store.write(n, spark.createDataFrame(batch, kind))
        want.update({c: (s, p) for c, s, p, _ in batch})
        assert spark.read.parquet(f"{store.root}/changes/batch={n}").count() == len(batch)
    check(11)
    assert len(store.parts["changes"]) <= 2 * store.COMPACT and len(store.parts["base"]) == 2
    again = annotation.CameraState(spark, store.root, store.schema)  # as a restarted query finds it
    assert again.parts == store.parts
    two = every.where("camera_id in ('3', '7')")
    own = [r[0] for r in two.select(store.bucket("camera_id")).distinct().collect()]
    assert {r.camera_id for r in again.rows(11, two, False, own).collect()} == {"3", "7"}
    assert store.rows(11, every, True, all_buckets, oldest_ms=11).count() == 0


MODELS = annotation.FeatureModels(scoring.StubFeatureExtractor(8), scoring.formula_event_weights(8, 8, 5),
                                  scoring.formula_activity_weights(8, 20))
WITH_FEATURES = C.PipelineConfig(event_enabled=True, activity_enabled=True, detectors=(
    C.Detector("object", 2, C.OBJECT_THRESHOLD), C.Detector("firearm", 3, C.FIREARM_THRESHOLD),
    C.Detector("feature", 2, None, True, ("event", "activity"))))


def _one_camera_files(spark, d, n, cameras=2):
    """``n`` files, in each one frame of every camera; the frames by number."""
    rows = [[(c, 100 * i + c, T0 + dt.timedelta(seconds=i), (7 * i + 3 * c) % 100) for c in range(cameras)] for i in range(n)]
    for i, r in enumerate(rows):
        _write(spark, f"{d}/src/p{i:02d}", r)
    return spark.createDataFrame([r for part in rows for r in part], "camera_id long, frame_id long, ts timestamp_ntz, k int")


def test_events_and_activity_on_the_stream_equal_batch(spark):
    """Feature vectors, event classes and activity of the stream (H1, J3, J4),
    over a restart, are those of the batch chain."""
    d = tempfile.mkdtemp(prefix="st-j34-")
    f = _one_camera_files(spark, d, 11)
    out = []

    def write(r, n):
        out.extend(r.select("camera_id", "offset", "ring", "events", "activity").collect())

    for part in range(2):  # the second run restarts from the checkpoint
        if part:
            _write(spark, f"{d}/src/q0", [(0, 1100, T0 + dt.timedelta(seconds=11), 5), (1, 1101, T0 + dt.timedelta(seconds=11), 9)])
            f = f.unionByName(spark.createDataFrame([(0, 1100, T0 + dt.timedelta(seconds=11), 5), (1, 1101, T0 + dt.timedelta(seconds=11), 9)], f.schema))
        recs = streams.frame_records(spark, "json", d + "/src/*", streaming=True, max_files_per_trigger=1)
        annotation.annotate_stream(recs, write, d + "/ckpt", stub_scorers(), WITH_FEATURES, freshness=False,
                                   models=MODELS).awaitTermination()
    src = tempfile.mkdtemp(prefix="st-j34-src-") + "/f"
    f.withColumn("props", F.format_string('{"k": %d}', "k")).write.parquet(src)
    ref = {(r.camera_id, r.frame_id, r.detector): r.result
           for r in annotate.score_frames_sampled(spark, spark.read.parquet(src), WITH_FEATURES).collect()}
    assert len(out) == 24
    seen = 0
    for r in out:
        assert len(r.ring) <= 4 and [x.src for x in r.ring] == sorted(x.src for x in r.ring)
        newest = r.ring[-1].src
        cam = int(r.camera_id)
        assert r.events.src == newest
        assert ",".join(str(c.class_idx) for c in r.events.classes) == ref[cam, newest, "event"]
        if r.activity is not None:
            seen += 1
            assert r.activity.src == newest and len(r.ring) == 4
            assert r.activity.activity == ref[cam, newest, "activity"]
        else:
            assert (cam, newest, "activity") not in ref
    assert seen


def test_rates_valid_from_a_time_in_stream_and_batch(spark):
    """The rates of a frame are those of its time, the counter starts again
    with each interval, and a detector that is off shows nothing."""
    d = tempfile.mkdtemp(prefix="st-rates-")
    f = _one_camera_files(spark, d, 12)
    rates = spark.createDataFrame(
        [("object", 2, True, T0), ("firearm", 3, True, T0), ("object", 3, True, T0 + dt.timedelta(seconds=5)),
         ("firearm", 3, False, T0 + dt.timedelta(seconds=8))], "detector string, rate int, enabled boolean, valid_from timestamp_ntz")
    out = []

    def write(r, n):
        out.extend(r.select("camera_id", "offset", "seq", "epoch", F.col("latest_object.src").alias("object"),
                            F.col("latest_firearm.src").alias("firearm")).collect())

    recs = streams.frame_records(spark, "json", d + "/src/*", streaming=True, max_files_per_trigger=1)
    annotation.annotate_stream(recs, write, d + "/ckpt", stub_scorers(), freshness=False, rates=rates).awaitTermination()
    due = {}
    for r in select.schedule_over_time(f, rates, "camera_id", ["ts", "frame_id"]).collect():
        due.setdefault((r.camera_id, r.detector), []).append((r.frame_id, r.seq, r.epoch))
    assert [x[0] // 100 for x in sorted(due[0, "object"])] == [0, 2, 4, 5, 8, 11]
    assert [x[0] // 100 for x in sorted(due[0, "firearm"])] == [0, 3, 5]
    assert len(out) == 24
    for r in out:
        for name, src in (("object", r.object), ("firearm", r.firearm)):
            assert src == max(i for i, _, _ in due[int(r.camera_id), name] if i <= r.offset)
        assert r.epoch == (0 if r.offset // 100 < 5 else 1 if r.offset // 100 < 8 else 2)


def test_intervals_have_rates_and_cycle(spark):
    t = [T0 + dt.timedelta(days=x) for x in (0, 3, 40)]
    rates = spark.createDataFrame([("a", 4, True, t[0]), ("b", 6, True, t[0]), ("a", 10, True, t[1]), ("b", 6, False, t[2])],
                                  "detector string, rate int, enabled boolean, valid_from timestamp_ntz")
    iv = select.rate_intervals(rates)
    assert [(r.epoch, r.valid_to, r.rates, r.cycle) for r in iv.orderBy("epoch").collect()] == [
        (0, t[1], {"a": 4, "b": 6}, 12), (1, t[2], {"a": 10, "b": 6}, 30), (2, None, {"a": 10}, 10)]
    at = [(-400, None), (-0.1, None), (0, 0), (2.9, 0), (3, 1), (20, 1), (39.99, 1), (40, 2), (900, 2)]
    f = spark.createDataFrame([(i, T0 + dt.timedelta(days=x)) for i, (x, _) in enumerate(at)], "i int, ts timestamp_ntz")
    got = {r.i: r.epoch for r in select.in_interval(f, iv, "ts").collect()}
    assert got == {i: e for i, (_, e) in enumerate(at)}


def test_progress_table_has_one_row_a_batch(spark):
    d = tempfile.mkdtemp(prefix="st-g3-")
    _one_camera_files(spark, d, 3)
    table = ProgressTable(spark, d + "/progress", "cameras")
    spark.streams.addListener(table)
    try:
        _run(spark, d, progress=table)
        _write(spark, f"{d}/src/q0", [(5, 900 + i, T0 + dt.timedelta(seconds=60 + i), 1) for i in range(4)])
        _run(spark, d, progress=table)  # a restart goes on with the next batch
        end = time.time() + 60
        while time.time() < end and (not os.path.isdir(d + "/progress") or len(os.listdir(d + "/progress")) < 4):
            time.sleep(0.2)
        time.sleep(1)
    finally:
        spark.streams.removeListener(table)
    rows = sorted(table.read().collect(), key=lambda r: r.batch_id)
    assert [(r.query, r.batch_id, r.n_messages, r.n_kept, r.n_late) for r in rows] == [
        ("cameras", 0, 2, 2, 0), ("cameras", 1, 2, 2, 0), ("cameras", 2, 2, 2, 0), ("cameras", 3, 4, 1, 0)]
    assert all(abs(r.seconds / r.n_messages - r.seconds_per_message) < 1e-9 and r.seconds > 0 for r in rows)


def test_progress_of_a_repeated_batch_replaces_its_row(spark, tmp_path):
    class Event:
        def __init__(self, **kw):
            self.__dict__.update(kw)

    table = ProgressTable(spark, str(tmp_path / "p"))
    for seconds in (2000, 5000):
        table.batch_done(7, 10, 3)
        table.onQueryProgress(Event(progress=Event(batchId=7, timestamp="t", numInputRows=10, stateOperators=[],
                                                   durationMs={"triggerExecution": seconds, "addBatch": 1})))
    table.onQueryProgress(Event(progress=Event(batchId=8, durationMs={"triggerExecution": 1})))  # no data
    assert [(r.batch_id, r.n_kept, r.seconds, r.seconds_per_message) for r in table.read().collect()] == [(7, 3, 5.0, 0.5)]
