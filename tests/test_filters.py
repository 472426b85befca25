"""Hand-made cases for parsing and filters."""

import datetime as dt

from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions import codec
from sightline.operators import filters


def test_freshness_edges(spark):
    now = dt.datetime(2024, 1, 2, 12, 0, 0)
    ages = [-1.0, 0.0, 5.0, 5.999, 6.0, 86399.0, 86400.0, 86406.0]
    rows = [(a, now - dt.timedelta(seconds=a)) for a in ages]
    df = spark.createDataFrame(rows, "age double, ts timestamp_ntz").withColumn(
        "now", F.lit(now).cast("timestamp_ntz"))
    fresh = {r.age for r in filters.freshness_filter(df, "ts", now=F.col("now")).collect()}
    wrap = {r.age for r in filters.freshness_filter(df, "ts", now=F.col("now"), day_wrapped=True).collect()}
    assert fresh == {0, 5, 5.999}
    # timedelta.seconds semantics: -1 s is 86399 s into the day before; a
    # whole day off passes.
    assert wrap == {0, 5, 5.999, 86400}


def test_event_time_formats(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00",), ("2024-01-01T00:00:00.123456",),
                                ("2024-01-01T00:00:00.5",), ("yesterday",), (None,)], "t string")
    got = [r.x for r in df.select(codec.ts_text(codec.parse_event_time("t")).alias("x")).collect()]
    assert got == ["2024-01-01 00:00:00.000000", "2024-01-01 00:00:00.123456", "2024-01-01 00:00:00.500000",
                   None, None]


def test_iso_timestamp_drops_zero_fraction(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1, 2, 3),), (dt.datetime(2024, 1, 1, 1, 2, 3, 5),)],
                               "ts timestamp_ntz")
    assert [r.x for r in df.select(codec.iso_timestamp("ts").alias("x")).collect()] == [
        "2024-01-01T01:02:03", "2024-01-01T01:02:03.000005"]


def test_bad_records_reasons(spark):
    good = '{"image": "eyJrIjogMX0=", "timestamp": "2024-01-01T00:00:00.5", "camera_id": "c"}'
    rows = [("{bad",), ('{"image": "eyJrIjogMX0=", "timestamp": "2024-01-01T00:00:00"}',),
            ('{"timestamp": "2024-01-01T00:00:00", "camera_id": "c"}',),
            ('{"image": "@@@=", "timestamp": "2024-01-01T00:00:00", "camera_id": "c"}',),
            ('{"image": "", "timestamp": "2024-01-01T00:00:00", "camera_id": "c"}',),
            ('{"image": "eyJrIjogMX0=", "timestamp": "yesterday", "camera_id": "c"}',), (good,)]
    df = spark.createDataFrame(rows, "value string")
    good_df, bad = filters.split_bad_records(df)
    assert [r.reason for r in bad.collect()] == ["malformed_json", "missing_camera_id", "missing_image",
                                                 "bad_image", "bad_timestamp"]
    # an empty image is valid base64; a one-digit fraction parses (as %f does)
    assert good_df.count() == 2


def test_lenient_base64(spark):
    df = spark.createDataFrame([("eyJr\nIjogMX0=",), ("ey*JrIjogMX0=",)], "t string")
    strict = [r.x for r in df.select(codec.decode_image("t").cast("string").alias("x")).collect()]
    lenient = [r.x for r in df.select(codec.decode_image("t", lenient=True).cast("string").alias("x")).collect()]
    assert lenient == ['{"k": 1}', '{"k": 1}']
    assert strict[1] is None


def test_encode_one_line(spark):
    df = spark.createDataFrame([(bytes(range(256)) * 2,)], "b binary")
    s = df.select(codec.encode_image("b").alias("s")).first().s
    assert "\n" not in s and len(s) == 684


def test_watchlist_modes(spark):
    rows = [(1, "Pistol"), (2, "pistol"), (3, "knife"), (4, " Traffic"), (5, "Traffic"), (6, "car")]
    df = spark.createDataFrame(rows, "frame_id int, label string")
    norm = {r.frame_id for r in filters.watchlist_flag(df, "frame_id", C.SUSPICIOUS_OBJECTS)
            .where("suspicious").collect()}
    exact = {r.frame_id for r in filters.watchlist_flag(df, "frame_id", C.SUSPICIOUS_OBJECTS, exact=True)
             .where("suspicious").collect()}
    assert norm == {1, 2, 3} and exact == {2, 3}
    events = spark.createDataFrame([(w,) for w in C.SUSPICIOUS_EVENTS], "label string")
    hit = {r.frame_id for r in filters.watchlist_events(df, events).collect()}
    assert hit == {4, 5}


def test_confidence_filter_strict(spark):
    df = spark.createDataFrame([("object", 0.25), ("object", 0.26), ("firearm", 0.54), ("firearm", 0.55),
                                ("feature", 0.0)], "detector string, confidence double")
    got = sorted(tuple(r) for r in filters.confidence_filter(df, C.DEFAULT_CONFIG.thresholds()).collect())
    assert got == [("feature", 0.0), ("firearm", 0.55), ("object", 0.26)]


def test_nonempty(spark):
    df = spark.createDataFrame([(1, []), (2, ["a"]), (3, None)], "id int, detections array<string>")
    assert [r.id for r in filters.nonempty_filter(df).collect()] == [2]


def test_broken_json_stops_a_fail_fast_read(spark):
    df = spark.createDataFrame([("{bad",)], "value string")
    good, bad = filters.split_bad_records(df)
    assert (good.count(), bad.first().reason) == (0, "malformed_json")
    good, _ = filters.split_bad_records(df, fail_fast=True)
    try:
        good.collect()
        raise AssertionError("broken JSON accepted")
    except Exception as e:
        assert "MALFORMED_RECORD" in str(e)


def test_missing_message_is_malformed(spark):
    df = spark.createDataFrame([(None, 1)], "value string, offset long")
    assert filters.split_bad_records(df)[1].first().reason == "malformed_json"


def test_a_message_is_parsed_once(spark, capsys):
    _, bad = filters.split_bad_records(spark.createDataFrame([("x",)], "value string"))
    bad.explain("extended")
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert plan.lower().count("from_json(") == 1


def test_row_local_list_forms_have_no_exchange(spark, capsys):
    from sightline.plans import queries as Q
    from .conftest import SF_SMALL
    for name in ("watchlist_flag", "union_detections", "label_counts", "summary_text"):
        Q.QUERIES[name](spark, SF_SMALL).explain()
        assert "Exchange" not in capsys.readouterr().out, name
