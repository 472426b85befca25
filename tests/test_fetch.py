"""Images fetched late, packed stills and the late split."""

import datetime as dt
import io
import random
import tarfile
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions import codec
from sightline.operators import fetch, select
from sightline.plans import annotate
from sightline.sources import stills, tables as TB
from sightline.streaming import pipeline
from sightline.streaming.late import LateSplit

from .conftest import SF_MID, SF_SMALL

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def files(spark):
    """The frames over several files."""
    path = tempfile.mkdtemp(prefix="late-images-") + "/f"
    TB.frames(spark, SF_MID).repartition(7).write.parquet(path)
    return spark.read.parquet(path)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rounds_hold_whole_blocks():
    counts = [(2, 0, 5), (1, 0, 4), (1, 1, 3), (3, 0, 20), (4, 0, 1)]
    assert fetch.rounds(counts, 8) == [[(1, 0), (1, 1)], [(2, 0)], [(3, 0)], [(4, 0)]]
    assert fetch.rounds([], 8) == []


@pytest.mark.parametrize("most", [None, 400, 37])
def test_fetch_gives_each_row_its_image(spark, files, most):
    chosen = fetch.located(files).where("frame_id % 9 = 0").select("frame_id", fetch.FILE, fetch.ROW)
    got = fetch.fetch(chosen, files, ["props"], most)
    assert got.columns == ["props", "frame_id"] or set(got.columns) == {"props", "frame_id"}
    assert _rows(got.select("frame_id", "props")) == _rows(files.where("frame_id % 9 = 0").select("frame_id", "props"))


def test_fetch_of_nothing(spark, files):
    chosen = fetch.located(files).where("false").select("frame_id", fetch.FILE, fetch.ROW)
    assert fetch.fetch(chosen, files, ["props"]).count() == 0


def _exchanges(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return [p for p in capsys.readouterr().out.split("\n\n") if "Exchange" in p.split("\n")[0]]


def test_no_image_in_exchange_or_checkpoint(spark, files, capsys, monkeypatch):
    """J5 and the batch flagship: what is written down or shuffled is narrow."""
    kept, plans = [], []
    real = type(files).checkpoint

    def checkpoint(self, *a, **k):
        kept.append(self.columns)
        plans.append(_exchanges(self, capsys))
        return real(self, *a, **k)

    monkeypatch.setattr(type(files), "checkpoint", checkpoint)
    scored = annotate.score_frames_sampled(spark, files)
    f = files.withColumn("image", F.col("props").cast("binary"))
    shown = annotate.annotated_images(f, annotate.stub_detectors(), batch=F.date_format("ts", "yyyy-MM-dd"))
    plans += [_exchanges(scored, capsys), _exchanges(shown, capsys)]
    assert kept and not {"image", "props", "content"} & {c for cols in kept for c in cols}
    assert any(plans) and not any("image" in p or "props" in p for exchanges in plans for p in exchanges)


def test_scoring_in_rounds_is_the_same(spark, files):
    want = _rows(annotate.score_frames_sampled(spark, files))
    assert _rows(annotate.score_frames_sampled(spark, files, fetch_rows=300)) == want


def test_scorers_see_due_frames_only(spark, files):
    """Rates 5 and 5: a fifth of a camera's frames, rounded up, is scored."""
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        def load(self):
            return self

        def predict(self, images):
            import pandas as pd
            seen.add(len(images))
            return pd.DataFrame({c: [] for c in ("_row", "pos", "label", "confidence", "x1", "y1", "x2", "y2")})

    f = files.withColumn("image", F.col("props").cast("binary"))
    annotate.annotated_images(f, {"object": Counting()}).count()
    per = files.groupBy("camera_id").count().collect()
    assert seen.value == sum(-(-r["count"] // C.OBJECT_SAMPLE_RATE) for r in per)


def test_batch_flagship_with_images_off_and_changed_rates(spark, files):
    f = files.withColumn("image", F.col("props").cast("binary")).where("camera_id < 5")
    for cfg in (C.PipelineConfig(detectors=()), C.PipelineConfig(detectors=(C.Detector("object", 2, 0.1), C.Detector("firearm", 3, 0.2)))):
        got = annotate.annotated_images(f, annotate.stub_detectors(), cfg)
        ref = annotate.annotated_results(f, cfg)
        cols = ["camera_id", "frame_id", "seq", "timestamp", "pred_frame_id", "prediction"]
        assert _rows(got.select(*cols)) == _rows(ref.select(*cols))
        assert _rows(got.select("frame_id", F.col("image").cast("string"))) == _rows(f.select("frame_id", "props"))


def _tar(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in members:
            m = tarfile.TarInfo(name)
            m.size, m.mtime = len(data), 1_700_000_000.25
            t.addfile(m, io.BytesIO(data))
    return out.getvalue()


def test_packed_stills_over_a_restart(spark, tmp_path):
    f = TB.frames(spark, SF_SMALL)
    content = F.when(F.col("frame_id") % 10 != 0, F.col("props").cast("binary")).otherwise(F.lit(b""))
    rows = f.select("camera_id", "frame_id", F.col("ts"), content.alias("content"))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert stills.write_archives(rows.where("frame_id < 600"), folder, archive_bytes=20_000) == f.where("frame_id < 600").count()
    assert len(list((tmp_path / "in").glob("*.tar"))) < 60
    pipeline.drain_to_table(stills.packed_stills(spark, folder, max_files_per_trigger=5), out)
    assert stills.write_archives(rows.where("frame_id >= 600").repartition(3), folder + "/more", archive_bytes=20_000)
    import shutil
    for p in (tmp_path / "in" / "more").glob("*.tar"):
        shutil.copy(p, tmp_path / "in" / f"second-{p.name}")
    got = pipeline.drain_to_table(stills.packed_stills(spark, folder), out)  # goes on from the checkpoint
    ev = codec.parse_frame_event("value")
    got = got.select("frame_id", ev["camera_id"].alias("c"), ev["timestamp"].alias("t"), codec.decode_image(ev["image"]).alias("i"), "reason")
    want = rows.select("frame_id", F.col("camera_id").cast("string"), codec.iso_timestamp("ts"), "content", F.lit(None).cast("string"))
    assert sorted(map(str, got.collect())) == sorted(str(r).replace("camera_id", "c", 1) for r in want.toDF("frame_id", "c", "t", "i", "reason").collect())


def test_damaged_archives_say_so(spark, tmp_path):
    good = _tar([("cam a/7.jpg", b"x" * 900), ("./b/name.png", b""), ("lonely.jpg", b"1")])
    (tmp_path / "a.tar").write_bytes(good)
    (tmp_path / "b.tar").write_bytes(good[:900])  # ends in the first still
    (tmp_path / "c.tar").write_bytes(b"no archive")
    (tmp_path / "d.tar").write_bytes(b"")
    (tmp_path / "e.txt").write_bytes(good)
    got = stills.packed_stills(spark, str(tmp_path), streaming=False).collect()
    fine = {(r.camera_id, r.frame_id) for r in got if r.reason is None}
    assert fine == {("cam a", 7), ("b", None)}
    assert all((r.value is None) == (r.reason is not None) for r in got)
    bad = [r.reason for r in got if r.reason is not None]
    assert sum("no camera" in b for b in bad) == 1 and any("b.tar" in b for b in bad) and any("c.tar" in b for b in bad)


def _stills(n):
    """Names, times (microseconds) and images: all plain ones, then odd ones."""
    us = 1_704_067_211_172_425
    plain = [(f"{i % 7}/{i}", us + 1_234_567 * i if i % 5 else us // 10 ** (i % 7) * 10 ** (i % 7), b"i" * (i * 97 % 1300)) for i in range(n)]
    odd = [("kamera ü/1", us, b"x"), ("c" * 95 + "/1234", us, b""), ("c" * 96 + "/1234", us, b"y" * 512), ("a/None", 0, b""),
           ("b/2", -1, b"z"), ("b/3", 1, b"z"), ("b/4", 9 * 10 ** 15, b"z"), ("/5", us // 10 ** 6 * 10 ** 6, b"z" * 513)]
    return plain, plain[:3] + odd + plain[3:]


def _blocks(rows):
    names, us, images = zip(*rows)
    return stills._tar_blocks(pa.array(names), np.array(us), pa.array(images, pa.binary())).tobytes()


def _by_tarfile(rows, fmt=tarfile.PAX_FORMAT, whole=float):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w", format=fmt) as tar:
        for name, us, image in rows:
            m = tarfile.TarInfo(name)
            m.size, m.mtime = len(image), whole(us / 1_000_000)
            tar.addfile(m, io.BytesIO(image))
    return held.getvalue()


def test_archives_are_those_of_tarfile():
    for rows in _stills(200):
        data = pa.py_buffer(_by_tarfile(rows))
        assert data.to_pybytes().rstrip(b"\0") == _blocks(rows).rstrip(b"\0")
        assert stills._any_members("p", data) == (tuple(zip(*rows)), None)
    rows = _stills(200)[0]
    for data, step in ((_by_tarfile(rows), 1), (_by_tarfile(rows, tarfile.GNU_FORMAT, int), 10 ** 6),
                       (_by_tarfile(rows, tarfile.USTAR_FORMAT, int), 10 ** 6)):
        assert list(zip(*stills._plain_members(pa.py_buffer(data)))) == [(n, us // step * step, i) for n, us, i in rows]


def test_number_of_single_headers_does_not_grow(monkeypatch):
    """Packing and reading are done by columns, not still by still in ``tarfile``."""
    calls, new = [], tarfile.TarInfo.__init__
    monkeypatch.setattr(tarfile.TarInfo, "__init__", lambda self, *a, **b: (calls.append(1), new(self, *a, **b))[1])
    made = []
    for n in (50, 1000):
        rows = _stills(n)[0]
        data = pa.py_buffer(_by_tarfile(rows))
        calls.clear()
        batch = stills._members("p", data)
        assert batch.num_rows == n and batch.column("reason").null_count == n
        made.append(len(calls))
        _blocks(rows)
        made.append(len(calls))
    assert made[:2] == made[2:]


def test_odd_archives_read_as_by_tarfile(monkeypatch):
    """Any byte of an archive may be wrong, and it may end anywhere."""
    draw = random.Random(5)
    whole = [_by_tarfile(r[:12]) for r in _stills(12)] + [_by_tarfile(_stills(9)[0], tarfile.GNU_FORMAT, int)]
    cases = [*whole, b"", bytes(512), bytes(10240)]
    for _ in range(600):
        data = bytearray(draw.choice(whole))
        if draw.random() < 0.2:
            del data[draw.randrange(len(data)):]
        else:
            for _ in range(draw.randint(1, 2)):
                at = draw.randrange(len(data) // 512) * 512 + draw.choice([0, 5, 30, 99, 124, 130, 134, 135, 140, 147, 150, 154, 156, 257, 262, 345, 500])
                data[at] = draw.choice(b"\0\n 0179x.=\xe9")  # a negative size keeps tarfile itself in a loop
            if draw.random() < 0.7:  # with checksums that hold
                for at in range(0, len(data), 512):
                    if data[at + 257:at + 262] == b"ustar":
                        data[at + 148:at + 156] = b" " * 8
                        data[at + 148:at + 156] = b"%06o\0 " % sum(data[at:at + 512])
        cases.append(bytes(data))

    def read(data):
        try:
            return stills._members("p", pa.py_buffer(data)).to_pylist()
        except Exception as e:
            return type(e)

    got = [read(c) for c in cases]
    taken = sum(stills._plain_members(pa.py_buffer(c)) is not None for c in cases)
    assert 0 < taken < len(cases)
    monkeypatch.setattr(stills, "_plain_members", lambda data: None)
    assert got == [read(c) for c in cases]


def test_a_still_without_time_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, None, b"x")], "camera_id long, frame_id long, ts timestamp, content binary")
    with pytest.raises(Exception, match="TypeError"):
        stills.write_archives(rows, str(tmp_path / "in"))


def test_stills_without_camera_number_or_image(spark, tmp_path):
    t = dt.datetime(2024, 1, 2, 3, 4, 5, 60)
    rows = spark.createDataFrame([(1, 1, t, None), (None, 2, t, b"x"), (3, None, t, b"y"), (3, 3, t, b"z"), (3, 3, t, b"z")],
                                 "camera_id long, frame_id long, ts timestamp, content binary").coalesce(1)
    assert stills.write_archives(rows, str(tmp_path / "in"), archive_bytes=2049) == 5
    assert len(list((tmp_path / "in").glob("*.tar"))) == 3  # 1024 + 1025, 1025 + 1025, 1025
    ev = codec.parse_frame_event("value")
    got = stills.packed_stills(spark, str(tmp_path / "in"), streaming=False).select("camera_id", "frame_id", codec.decode_image(ev["image"]), "reason")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [
        ("1", 1, b"", None), ("None", 2, b"x", None), ("3", None, b"y", None)] + 2 * [("3", 3, b"z", None)]))


def test_late_split_keeps_and_counts(spark, tmp_path):
    """Batches of hours from midnight; delay of two hours, windows of one."""
    hours = [[1.5, 2.2, None], [5.5, 3.2], [3.9, 1.1, 3.0, 4.0], [9.0, 2.5], [7.5, 6.9]]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    split = LateSplit(spark, out, delay="2 hours", window="1 hour")
    schema = "i int, event_ts timestamp"
    for n, part in enumerate(hours):
        rows = [(10 * n + k, None if h is None else T0 + dt.timedelta(hours=h)) for k, h in enumerate(part)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/p{n}")
        stream = spark.readStream.schema(schema).parquet(src + "/*")
        split.run(stream, out + "/ckpt").awaitTermination()  # each run goes on with the next batch
    want, newest = [], None
    for n, part in enumerate(hours):
        mark = None if newest is None else newest - 2
        want += [10 * n + k for k, h in enumerate(part) if h is not None and mark is not None and int(h) + 1 <= mark]
        newest = max([newest or 0, *[h for h in part if h is not None]])
    assert sorted(r.i for r in split.late().collect()) == want
    counts = split.counts().orderBy("batch").collect()
    assert sum(r.n_rows for r in counts) == sum(map(len, hours)) and sum(r.n_late for r in counts) == len(want)
    # A repeated batch replaces its rows and counts.
    split.handle(spark.read.parquet(f"{src}/p4"), 4)
    assert sorted(r.i for r in split.late().collect()) == want and split.counts().count() == 5
    # The stateful query after it drops nothing.
    d2 = select.latest_per_window(split.in_time(), "i", "event_ts", "1 hour", watermark="2 hours")
    q = (d2.writeStream.format("memory").queryName("late_d2").option("checkpointLocation", out + "/d2").trigger(availableNow=True).start())
    q.awaitTermination()
    assert sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"]) == 0


def test_late_and_in_time_rows_are_all_rows(spark):
    f = TB.frames(spark, SF_SMALL)
    split = pipeline.split_late_halves(spark, f)
    late, rows = split.late(), spark.read.parquet(f"{split.root}/rows")
    assert rows.count() == f.count() and 0 < late.count() < rows.count()
    assert sum(r.n_late for r in split.counts().collect()) == late.count()
