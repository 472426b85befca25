"""Predictions that take time (I2 with F5), and malformed results (A4)."""

import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from sightline import config as C
from sightline.operators.sequence import keyed_sequence
from sightline.plans import annotate
from sightline.sources import streams, tables as TB
from sightline.streaming import annotation, pipeline

from .conftest import SF_SMALL
from .test_annotation_stream import _one_camera_files, _write

T0 = dt.datetime(2024, 1, 1)


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


SHOWN = ["camera_id", "frame_id", "seq", "timestamp", "boxes", "prediction"]


@pytest.mark.parametrize("null", [False, True])
def test_no_delay_is_the_plain_pipeline(spark, null):
    delays = {"object": F.lit(None).cast("interval day to second")} if null else {}
    f = TB.frames(spark, SF_SMALL)
    got, plain = annotate.annotated_delayed(f, delays), annotate.annotated_results(f)
    assert _rows(got, *SHOWN) == _rows(plain, *SHOWN)
    assert _rows(got, "frame_id", "object_frame_id") == _rows(plain, "frame_id", "pred_frame_id")


def _frames(spark, n, cameras=1):
    rows = [(i % cameras, i, T0 + dt.timedelta(seconds=i // cameras), i * 7 % 100) for i in range(n)]
    return spark.createDataFrame(rows, "camera_id long, frame_id long, ts timestamp, k int")


def _plain(rows, seconds):
    """Shown object source per frame, by a scan of all predictions."""
    out = {}
    for cam, fid, ts, k, seq in rows:
        done = [(t + dt.timedelta(seconds=seconds(kk)), s, i) for c, i, t, kk, s in rows if c == cam and s % 5 == 0]
        done = [d for d in done if d[0] <= ts]
        out[fid] = max(done)[2] if done else None
    return out


@pytest.mark.parametrize("chunk_rows", [1, 7, None])
def test_the_last_completed_prediction_shows(spark, chunk_rows):
    f = _frames(spark, 120)  # one camera holds all frames; a slow prediction is overtaken
    r = annotate.annotated_delayed(f, {"object": F.make_dt_interval(secs=F.col("k") % 13 * 3)}, chunk_rows=chunk_rows)
    got = {x.frame_id: x.object_frame_id for x in r.collect()}
    rows = [(x.camera_id, x.frame_id, x.ts, x.k, x.seq) for x in keyed_sequence(f, ["camera_id"], ["ts", "frame_id"]).collect()]
    exp = _plain(rows, lambda k: k % 13 * 3)
    assert got == exp
    shown = [exp[i] for i in sorted(exp) if exp[i] is not None]
    assert shown != sorted(shown)  # an older frame's prediction came in after a newer one's


def test_detectors_wait_apart_and_text_stays(spark):
    f = _frames(spark, 60, cameras=3)
    r = annotate.annotated_delayed(f, {"object": F.make_dt_interval(secs=F.lit(3)), "firearm": F.make_dt_interval(days=F.lit(1))})
    rows = r.orderBy("camera_id", "seq").collect()
    assert all(x.firearm_frame_id is None for x in rows)
    assert all((x.object_frame_id is None) == (x.seq < 3) for x in rows)
    for a, b in zip(rows, rows[1:]):  # an empty prediction keeps the text
        if a.camera_id == b.camera_id and not b.boxes:
            assert b.prediction == a.prediction


def test_no_frames_and_no_detectors(spark):
    empty = annotate.annotated_delayed(_frames(spark, 5).where("false"), {})
    assert empty.collect() == []
    off = C.PipelineConfig(detectors=tuple(d for d in C.DEFAULT_CONFIG.detectors if d.name not in ("object", "firearm")))
    r = annotate.annotated_delayed(_frames(spark, 5), {}, off)
    assert [(x.object_frame_id, x.firearm_frame_id, x.boxes, x.prediction) for x in r.collect()] == [(None, None, [], "")] * 5


EVERY = C.PipelineConfig(detectors=(C.Detector("object", 1, C.OBJECT_THRESHOLD), C.Detector("firearm", 2, C.FIREARM_THRESHOLD)))


def _secs(k):
    return {"object": F.make_dt_interval(secs=k % 4 * 2), "firearm": F.make_dt_interval(secs=k % 3)}


def _stream(spark, d, config=EVERY, delays=None, **kw):
    """Rows of the stream over the files in ``d``, a micro-batch for each."""
    out = []

    def write(r, n):
        out.extend(r.select("camera_id", "offset", "seq", "boxes", "prediction", "waiting_object", F.col("latest_object.src").alias("object"),
                            F.col("latest_firearm.src").alias("firearm")).collect())

    recs = streams.frame_records(spark, "json", d + "/src/*", streaming=True, max_files_per_trigger=1)
    annotation.annotate_stream(recs, write, d + "/ckpt", annotation.stub_scorers(), config, freshness=False,
                               delays=delays or _secs(F.get_json_object(F.col("image").cast("string"), "$.k").cast("int")), **kw).awaitTermination()
    return out


@pytest.mark.parametrize("broadcast", [C.BROADCAST_CAMERAS, 2])
def test_predictions_under_way_wait_in_the_stream_state(spark, monkeypatch, broadcast):
    """The stream, over a restart, shows what the batch form shows; also where
    the waiting lists are too long to broadcast."""
    monkeypatch.setattr(C, "BROADCAST_CAMERAS", broadcast)
    d = tempfile.mkdtemp(prefix="st-late-")
    f = _one_camera_files(spark, d, 7)
    out = _stream(spark, d)
    more = [(c, 700 + c, T0 + dt.timedelta(seconds=9), 5 + c) for c in range(2)]
    _write(spark, f"{d}/src/q0", more)
    out += _stream(spark, d)  # goes on from the checkpoint
    f = f.unionByName(spark.createDataFrame(more, f.schema))
    ref = {r.frame_id: r for r in annotate.annotated_delayed(f, _secs(F.col("k")), EVERY).collect()}
    assert len(out) == len(ref) == 16
    for r in out:
        b = ref[r.offset]
        assert (r.seq, r.object, r.firearm, r.prediction) == (b.seq, b.object_frame_id, b.firearm_frame_id, b.prediction)
        assert r.boxes == b.boxes
        now = T0 + dt.timedelta(seconds=9 if r.offset >= 700 else r.offset // 100)
        assert all(w.done > now >= w.at for w in r.waiting_object) and len(r.waiting_object) <= 6  # those of one delay
    assert any(r.waiting_object for r in out) and any(r.object is not None and r.object < r.offset for r in out)


def test_a_shown_prediction_stands_when_time_steps_back(spark):
    d = tempfile.mkdtemp(prefix="st-back-")
    at = lambda s: T0 + dt.timedelta(seconds=s)
    for i, s in enumerate((0, 5, 1, 6)):
        _write(spark, f"{d}/src/p{i}", [(7, i, at(s), 2)])
    one = C.PipelineConfig(detectors=(C.Detector("object", 1, 0.0),))
    out = _stream(spark, d, one, {"object": F.make_dt_interval(secs=F.lit(2)), "unknown": F.lit(None)})
    assert [(r.offset, r.object, [w.src for w in r.waiting_object]) for r in sorted(out, key=lambda r: r.offset)] == [
        (0, None, [0]), (1, 0, [1]), (2, 0, [1, 2]), (3, 2, [1, 3])]


def test_predictions_of_a_detector_turned_off_still_complete(spark):
    d = tempfile.mkdtemp(prefix="st-off-")
    for i in range(3):
        _write(spark, f"{d}/src/p{i}", [(7, i, T0 + dt.timedelta(seconds=i), 2)])
    asked = []

    def config():
        asked.append(1)
        return C.PipelineConfig(detectors=(C.Detector("object", 1, 0.0, enabled=len(asked) < 2),))

    out = _stream(spark, d, config, {"object": F.make_dt_interval(secs=F.lit(2))})
    assert [(r.offset, r.object, len(r.waiting_object), len(r.boxes)) for r in sorted(out, key=lambda r: r.offset)] == [
        (0, None, 1, 0), (1, None, 1, 0), (2, 0, 0, 0)]


GOOD = {"timestamp": "2024-01-01T00:00:00.5", "camera_id": "c", "image": "aGk=", "prediction": None}
BROKEN = [
    ("{", "malformed_json"), ("", "malformed_json"), (" \n", "malformed_json"), (None, "malformed_json"), ("[1]", "malformed_json"),
    (json.dumps({**GOOD, "camera_id": None}), "missing_camera_id"),
    (json.dumps({k: v for k, v in GOOD.items() if k != "timestamp"}), "missing_timestamp"),
    (json.dumps({**GOOD, "image": None}), "missing_image"),
    (json.dumps({**GOOD, "timestamp": "now"}), "bad_timestamp"),
    (json.dumps({**GOOD, "image": "@"}), "bad_image"),
]


def test_results_without_defects_pass_and_others_say_why(spark):
    values = [v for v, _ in BROKEN] + [json.dumps(GOOD), json.dumps(GOOD)]
    good, bad = streams.parse_results(spark.createDataFrame([(v,) for v in values], "value string"))
    assert [tuple(r) for r in good.collect()] == [(GOOD["timestamp"], "c", bytearray(b"hi"), None)] * 2
    assert sorted(((r.value, r.reason) for r in bad.collect()), key=repr) == sorted(BROKEN, key=repr)


def test_drained_results_keep_every_event_over_a_restart(spark):
    root = tempfile.mkdtemp(prefix="results-")
    write = lambda vs, mode: spark.createDataFrame([("c", v) for v in vs], "camera_id string, value string").write \
        .mode(mode).json(f"{root}/in", ignoreNullFields=False)
    write([], "overwrite")
    records = lambda: streams.result_records(spark, "json", f"{root}/in")
    for part in pipeline.drain_results(records(), f"{root}/out"):
        assert part.count() == 0
    write([v for v, _ in BROKEN] + [json.dumps(GOOD)], "append")
    pipeline.drain_results(records(), f"{root}/out")
    write([json.dumps(GOOD), "{"], "append")
    good, bad = pipeline.drain_results(records(), f"{root}/out")  # goes on from the checkpoint
    assert (good.count(), bad.count()) == (2, len(BROKEN) + 1)
    again = pipeline.drain_results(records(), f"{root}/out")
    assert [p.count() for p in again] == [2, len(BROKEN) + 1]
