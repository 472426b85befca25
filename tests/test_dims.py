"""Dimension sources: line numbers across many file blocks and files,
stripping, model configs, label maps."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from sightline.sources import dims


def test_numbered_lines_many_blocks(spark):
    d = tempfile.mkdtemp(prefix="names-")
    lines = [f"label_{i:05d}" + (" " * (i % 3)) for i in range(20000)]
    with open(f"{d}/a.names", "w") as fh:
        fh.write("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # ~60 blocks
    try:
        t = dims.read_label_file(spark, f"{d}/a.names")
        assert spark.read.text(f"{d}/a.names").rdd.getNumPartitions() > 20
        got = sorted((r.label_id, r.label) for r in t.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, f"label_{i:05d}") for i in range(20000)]


def test_numbered_lines_across_part_files(spark):
    d = tempfile.mkdtemp(prefix="parts-")
    spark.range(5000).select(F.format_string("x%d", "id").alias("v")).orderBy(F.col("v").substr(2, 9).cast("int")) \
        .repartitionByRange(7, F.col("v").substr(2, 9).cast("int")).write.text(d + "/out")
    got = [r.value for r in dims.numbered_lines(spark, d + "/out").orderBy("line_no").collect()]
    assert got == [f"x{i}" for i in range(5000)]


def test_strip_like_python(spark):
    d = tempfile.mkdtemp(prefix="strip-")
    raw = ["Pistol ", "\tcar\t", " dog ", "", "  "]
    with open(f"{d}/n.names", "w", encoding="utf-8") as fh:
        fh.write("\n".join(raw) + "\n")
    got = [r.label for r in dims.read_label_file(spark, f"{d}/n.names").orderBy("label_id").collect()]
    assert got == [s.strip() for s in raw]


def test_model_registry_and_label_map(spark):
    d = tempfile.mkdtemp(prefix="models-")
    os.makedirs(f"{d}/Obj")
    os.makedirs(f"{d}/Gun")
    with open(f"{d}/Obj/Obj.json", "w") as fh:
        json.dump({"weights": "o.weights", "config": "o.cfg", "offset": 16, "classes": 80, "labels": "o.names"}, fh)
    with open(f"{d}/Gun/Gun.json", "w") as fh:
        json.dump({"pb": "g.pb", "meta": "g.meta", "offset": 16, "classes": 1, "labels": "g.names"}, fh)
    r = {x.model: x for x in dims.read_model_registry(spark, d).collect()}
    assert r["Obj"].classes == 80 and r["Obj"].weights_path.endswith("/Obj/o.weights")
    assert r["Gun"].pb_path.endswith("/Gun/g.pb") and r["Gun"].weights is None
    m = spark.createDataFrame([('{"0": "Parade", "12": "Riot"}',)], "value string")
    assert sorted(tuple(x) for x in dims.event_label_map(m).collect()) == [(0, "Parade"), (12, "Riot")]


def test_frame_ingest_from_stills(spark):
    import datetime as dt

    from sightline.functions import codec
    from sightline.sources import streams

    d = tempfile.mkdtemp(prefix="stills-")
    os.makedirs(f"{d}/cam7")
    with open(f"{d}/cam7/00042.jpg", "wb") as fh:
        fh.write(b"\xff\xd8jpegbytes")
    mtime = dt.datetime(2024, 1, 2, 3, 4, 5, 678901).replace(tzinfo=dt.timezone.utc).timestamp()
    os.utime(f"{d}/cam7/00042.jpg", (mtime, mtime))
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        r = streams.frame_ingest(spark, d, streaming=False, glob="*.jpg")
        row = r.withColumn("_ev", codec.parse_frame_event("value")).select(
            "camera_id", "frame_id", "_ev.timestamp", codec.decode_image("_ev.image").alias("img")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert (row.camera_id, row.frame_id) == ("cam7", 42)
    assert row.timestamp.startswith("2024-01-02T03:04:05")
    assert bytes(row.img) == b"\xff\xd8jpegbytes"
