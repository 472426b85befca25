"""A third of all frames on one camera: the skew-safe paths (range
partitions, many chunks per camera) give the same rows as SQL computed
with plain per-camera windows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sightline.operators import combine, ordered, overlay
from sightline.operators.sequence import keyed_sequence
from sightline.plans import annotate
from sightline.plans.oracle import ORACLE
from sightline.sources import tables as TB

from .conftest import SF_MID

HOT = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS camera_id"


def _skewed(spark):
    return TB.frames(spark, SF_MID).withColumn(
        "camera_id", F.when(F.col("frame_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("camera_id")))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF_MID}/events.parquet')")
    return c


def _sql(con, key):
    sql = ORACLE[key].replace("user_id AS camera_id", HOT)
    assert HOT in sql
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def _same(df, cols, rows):
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    order = sorted(cols)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    exp = sorted((tuple(norm(dict(zip(cols, r))[c]) for c in order) for r in rows), key=repr)
    return got == exp


def test_hot_camera_flagship(spark, con):
    f = _skewed(spark)
    assert f.where("camera_id = 0").count() > 3000
    cols, rows = _sql(con, "annotated_results")
    r = annotate.annotated_results(f, chunk_rows=500)
    r = r.withColumns({"n_boxes": F.size("boxes"), "boxes": overlay.boxes_text(F.col("boxes"))})
    assert _same(r, cols, rows)


def test_hot_camera_carry_forward(spark, con):
    f = keyed_sequence(_skewed(spark).select("camera_id", "frame_id", "ts", "event_type"),
                       ["camera_id"], ["ts", "frame_id"], num_partitions=8)
    f = f.withColumn("text", F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")))
    cols, rows = _sql(con, "carry_forward_text")
    assert _same(ordered.carry_forward_text(f, chunk_rows=300).select("frame_id", "shown_text"), cols, rows)


def test_hot_camera_asof(spark, con):
    f = _skewed(spark)
    fv = f.select("camera_id", "ts", "frame_id")
    pv = f.where(F.col("event_type") == "signup").select("camera_id", "ts", "frame_id", "value")
    r = combine.asof_prediction(fv, pv, "camera_id", "ts", "frame_id", ["value"], chunk_rows=200)
    cols, rows = _sql(con, "asof_prediction")
    assert _same(r.select("frame_id", "camera_id", "pred_frame_id", "pred_value"), cols, rows)
