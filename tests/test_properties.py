"""Property tests over random small frame sets."""

import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.operators import ordered, select, summarize
from sightline.operators.sequence import keyed_sequence

T0 = dt.datetime(2024, 1, 1)

frames_st = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 500), st.integers(0, 3)),
                     min_size=0, max_size=40)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _df(spark, rows):
    data = [(c, i, T0 + dt.timedelta(seconds=s), b, k) for i, (c, s, b) in enumerate(rows)
            for k in [i % 7]]
    return spark.createDataFrame(data, "camera_id int, frame_id long, ts timestamp_ntz, batch int, k int")


@SETTINGS
@given(rows=frames_st, rate=st.integers(1, 6))
def test_sampling_and_newest(spark, rows, rate):
    df = _df(spark, rows)
    per_cam = {}
    for c, _, _ in rows:
        per_cam[c] = per_cam.get(c, 0) + 1
    seq = keyed_sequence(df, ["camera_id"], ["ts", "frame_id"], num_partitions=3)
    got = {r.camera_id: r.n for r in select.sample_every_n(seq, rate).groupBy("camera_id")
           .agg(F.count("*").alias("n")).collect()}
    assert got == {c: math.ceil(n / rate) for c, n in per_cam.items()}
    newest = select.latest_per_key(df, ["batch", "camera_id"], ["ts", "frame_id"])
    assert newest.groupBy("batch", "camera_id").count().where("count > 1").count() == 0
    assert newest.count() == len({(b, c) for c, _, b in rows})


@SETTINGS
@given(rows=frames_st)
def test_rolling_window_count(spark, rows):
    df = _df(spark, rows).withColumn("vec", F.array(F.col("k").cast("double")))
    seq = keyed_sequence(df, ["camera_id"], ["ts", "frame_id"], num_partitions=3)
    out = ordered.rolling_features(seq.withColumnRenamed("frame_id", "vec_id"))
    got = {r.camera_id: r.n for r in out.groupBy("camera_id").agg(F.count("*").alias("n")).collect()}
    per_cam = {}
    for c, _, _ in rows:
        per_cam[c] = per_cam.get(c, 0) + 1
    assert got == {c: n - 3 for c, n in per_cam.items() if n > 3}


@SETTINGS
@given(rows=frames_st)
def test_label_counts_sum(spark, rows):
    df = _df(spark, rows).withColumn("label", F.element_at(F.array(*map(F.lit, "abc")), F.col("k") % 3 + 1))
    counts = summarize.label_counts(df, ["batch"], pos_col=None)
    total = counts.agg(F.sum("n")).first()[0] or 0
    assert total == len(rows)
