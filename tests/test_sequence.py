"""The skew-safe ordered primitives equal plain per-camera windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators.sequence import carry_last, keyed_sequence, trailing_groups
from sightline.sources import tables as TB

from .conftest import SF_MID


def _window_seq(df, key, order):
    return df.withColumn("seq2", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("bigint"))


def test_keyed_sequence_matches_row_number(spark):
    f = TB.frames(spark, SF_MID)
    got = keyed_sequence(f, ["camera_id"], ["ts", "frame_id"])
    ref = _window_seq(f, "camera_id", ["ts", "frame_id"]).select("frame_id", "seq2")
    j = got.join(ref, "frame_id")
    assert j.count() == f.count()
    assert j.where("seq != seq2").count() == 0


def test_keyed_sequence_single_hot_key_spreads(spark):
    # Every frame on one camera: the numbering must still be 0..n-1 and the
    # work is split over several range partitions.
    f = TB.frames(spark, SF_MID).withColumn("camera_id", F.lit(7))
    got = keyed_sequence(f, ["camera_id"], ["ts", "frame_id"], num_partitions=8)
    n = f.count()
    r = got.agg(F.min("seq"), F.max("seq"), F.countDistinct("seq")).first()
    assert tuple(r) == (0, n - 1, n)
    ref = _window_seq(f, "camera_id", ["ts", "frame_id"]).select("frame_id", "seq2")
    assert got.join(ref, "frame_id").where("seq != seq2").count() == 0


def test_keyed_sequence_null_key(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (1, 2)], "k long, o long")
    got = sorted((tuple(r) for r in keyed_sequence(df, ["k"], ["o"]).collect()), key=repr)
    assert got == sorted([(None, 1, 0), (None, 3, 1), (1, 2, 0)], key=repr)


def test_carry_last_small_chunks_equals_window(spark):
    f = TB.frames_seq(spark, SF_MID, ["event_type"]).withColumn(
        "v", F.when(F.col("event_type") == "signup", F.col("frame_id")))
    w = Window.partitionBy("camera_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ref = f.select("frame_id", F.last("v", ignorenulls=True).over(w).alias("ref"))
    for chunk in (1, 3, 7, 1 << 20):
        got = carry_last(f, ["camera_id"], "seq", ["v"], ["c"], chunk_rows=chunk)
        bad = got.join(ref, "frame_id").where(~F.col("c").eqNullSafe(F.col("ref"))).count()
        assert bad == 0, chunk


def test_trailing_groups_equals_window(spark):
    f = TB.frames_seq(spark, SF_MID)
    w = Window.partitionBy("camera_id").orderBy("seq").rowsBetween(-2, 0)
    ref = (f.select("camera_id", "seq", F.collect_list("frame_id").over(w).alias("ids"))
           .where(F.size("ids") == 3).collect())
    exp = sorted((r.camera_id, r.seq, tuple(r.ids)) for r in ref)
    for chunk in (1, 2, 5, 1 << 20):
        g = trailing_groups(f, ["camera_id"], "seq", 3, ["frame_id"], end_col="seq", chunk_rows=chunk)
        got = sorted((r.camera_id, r.seq, tuple(x.frame_id for x in r.items)) for r in g.collect())
        assert got == exp, chunk


def test_hot_camera_spread_over_tasks(spark):
    # The range partitioning used by keyed_sequence cuts one camera's frames
    # by time, so a camera with every frame still fills many tasks.
    f = TB.frames(spark, SF_MID).withColumn("camera_id", F.lit(7))
    parts = (f.repartitionByRange(8, "camera_id", "ts", "frame_id")
             .groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(parts) >= 6
    assert max(r["count"] for r in parts) < 0.3 * f.count()


def test_chunk_size_from_session(spark):
    f = TB.frames_seq(spark, SF_MID, ["event_type"]).withColumn(
        "v", F.when(F.col("event_type") == "signup", F.col("frame_id")))
    ref = sorted(tuple(r) for r in carry_last(f, ["camera_id"], "seq", ["v"], ["c"]).select("frame_id", "c").collect())
    spark.conf.set("spark.sightline.scan.chunkRows", "3")
    try:
        small = carry_last(f, ["camera_id"], "seq", ["v"], ["c"], keep_chunk=True)
        assert small.where("_chunk != seq div 3").count() == 0
        got = sorted(tuple(r) for r in small.select("frame_id", "c").collect())
    finally:
        spark.conf.unset("spark.sightline.scan.chunkRows")
    assert got == ref
