"""Driver tables and the camera-stream views derived from them.

The driver's ``events`` table stands in for the frame stream (one event is
one frame of camera ``user_id``) and ``embeddings`` for feature vectors.
Everything here is derived by Spark from those tables, so the work of every
query grows with them. The derivations are defined in FIXTURES.md; the same
definitions exist in SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SUSPICIOUS_EVENTS
from ..functions.codec import encode_image, iso_timestamp, result_envelope
from ..operators.sequence import keyed_sequence

# Fixture vocabulary of the stand-in detector output (not model labels).
DETECTION_LABELS = ["person", "car", "knife", "Pistol", "dog"]
FIREARM_LABEL = "Pistol"
FRAME_HEIGHT = 480
# Stand-in class names of the event model: every other one is on the watchlist.
EVENT_CLASSES = [n for pair in zip(SUSPICIOUS_EVENTS, [f"Event_{i}" for i in range(len(SUSPICIOUS_EVENTS))])
                 for n in pair]
N_PARTITIONS_OF_TOPIC = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_DERIVED: dict[tuple, str] = {}


def derived_path(spark: SparkSession, sf_dir: str, source: str, name: str, write) -> str:
    """Folder of an input derived from driver table ``source`` by ``write(path)``.
    Written once per application and version of the source table (path,
    length and modification time of its files), then reused by later queries."""
    from ..session import scratch_path
    version = file_versions(spark, table(spark, sf_dir, source).inputFiles())
    key = (spark.sparkContext.applicationId, sf_dir, source, name, version)
    if key not in _DERIVED:
        path = scratch_path(spark, name)
        write(path)
        _DERIVED[key] = path
    return _DERIVED[key]


def file_versions(spark: SparkSession, files: list[str]) -> tuple:
    """(path, length, modification time) of files, from their file system."""
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    out = []
    for f in sorted(files):
        p = path_of(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        out.append((f, s.getLen(), s.getModificationTime()))
    return tuple(out)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per event: frame_id, camera_id, ts, event_type, value, k."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("frame_id"), F.col("user_id").alias("camera_id"), "ts",
        "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), "props")


def frames_seq(spark: SparkSession, sf_dir: str, cols=()) -> DataFrame:
    """Frames with ``seq``: position of the frame within its camera by time.
    Only ``cols`` (besides camera_id, frame_id, ts) are carried: the
    numbered rows are checkpointed, and a projection cannot prune below a
    checkpoint, so callers name what they need."""
    f = frames(spark, sf_dir).select("camera_id", "frame_id", "ts", *cols)
    return keyed_sequence(f, ["camera_id"], ["ts", "frame_id"])


def detection_columns(k, pos) -> dict:
    """The stand-in detector output for detection ``pos`` of a frame whose
    props hold ``k``. Shared by the view and the stub scorer's SQL check."""
    label = F.element_at(F.array(*[F.lit(x) for x in DETECTION_LABELS]),
                         ((k * (pos + 1) + pos) % 5 + 1).cast("int"))
    x1 = k * 3 + pos * 7
    y1 = k * 2 + pos * 5 - 10
    return {
        "label": label,
        "confidence": ((k * 7 + pos * 31) % 100) / F.lit(100.0),
        "x1": x1.cast("int"), "y1": y1.cast("int"),
        "x2": (x1 + 40).cast("int"), "y2": (y1 + 30).cast("int"),
        "detector": F.when(label == FIREARM_LABEL, F.lit("firearm")).otherwise(F.lit("object")),
    }


def detections(frames_df: DataFrame) -> DataFrame:
    """Exploded detections: ``k % 4`` per frame (0 to 3), so a quarter of the
    frames have an empty prediction. One row per (frame_id, pos)."""
    d = frames_df.select("camera_id", "frame_id", "ts", "k",
                         F.posexplode(F.array_repeat(F.lit(0), F.col("k") % 4)).alias("pos", "_z"))
    cols = detection_columns(F.col("k"), F.col("pos"))
    return d.select("camera_id", "frame_id", "ts", F.col("pos").cast("int").alias("pos"),
                    *[c.alias(n) for n, c in cols.items()])


def stub_colours():
    """Colours of the stand-in detectors' labels: objects, then firearms."""
    from ..operators.combine import palette_map
    return palette_map([[x for x in DETECTION_LABELS if x != FIREARM_LABEL], [FIREARM_LABEL]])


def aged(frames_df: DataFrame) -> DataFrame:
    """Frames with a processing clock ``now_ts``: ages from -8 s to +11.9 s,
    and a third of them a whole day later."""
    k, fid = F.col("k"), F.col("frame_id")
    age_us = ((k % 20) - 8) * F.lit(1_000_000) + (fid % 10) * F.lit(100_000) + \
        F.when(k % 3 == 0, F.lit(86_400_000_000)).otherwise(F.lit(0))
    return frames_df.withColumn("age_us", age_us.cast("bigint")) \
        .withColumn("now_ts", F.expr("timestampadd(MICROSECOND, age_us, ts)"))


def messages(frames_df: DataFrame, keep=()) -> DataFrame:
    """Frame events on the wire: Kafka-like (partition, offset, value) where
    value is the producer's JSON with the props text as image bytes."""
    m = frames_df.select(
        (F.col("camera_id") % N_PARTITIONS_OF_TOPIC).cast("int").alias("partition"),
        F.col("frame_id").alias("offset"),
        F.col("camera_id").cast("string").alias("camera_id"),
        iso_timestamp("ts").alias("timestamp"),
        encode_image(F.col("props").cast("binary")).alias("image"), "k", *keep)
    value = F.concat(F.lit('{"image": "'), F.col("image"), F.lit('", "timestamp": "'), F.col("timestamp"),
                     F.lit('", "camera_id": "'), F.col("camera_id"), F.lit('"}'))
    return m.select("partition", "offset", "k", value.alias("value"), *keep)


def broken_messages(frames_df: DataFrame) -> DataFrame:
    """Messages where k % 10 picks a defect: 0 cut short, 1 bad base64,
    2 no camera_id, 3 unparseable time, 4 no image, 5 time without fraction."""
    m = frames_df.select(
        F.col("frame_id").alias("offset"), "k", F.col("camera_id").cast("string").alias("cam"),
        iso_timestamp("ts").alias("tstamp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("tsec"),
        encode_image(F.col("props").cast("binary")).alias("img"))
    k10 = F.col("k") % 10

    def msg(img, ts, cam=True, image=True):
        parts = []
        if image:
            parts += [F.lit('"image": "'), img, F.lit('"')]
        parts += [F.lit(', ' if image else ''), F.lit('"timestamp": "'), ts, F.lit('"')]
        if cam:
            parts += [F.lit(', "camera_id": "'), F.col("cam"), F.lit('"')]
        return F.concat(F.lit("{"), *parts, F.lit("}"))

    good = msg(F.col("img"), F.col("tstamp"))
    value = (F.when(k10 == 0, F.expr("substring(value_good, 1, length(value_good) div 2)"))
             .when(k10 == 1, msg(F.lit("@@@="), F.col("tstamp")))
             .when(k10 == 2, msg(F.col("img"), F.col("tstamp"), cam=False))
             .when(k10 == 3, msg(F.col("img"), F.lit("yesterday")))
             .when(k10 == 4, msg(F.col("img"), F.col("tstamp"), image=False))
             .when(k10 == 5, msg(F.col("img"), F.col("tsec")))
             .otherwise(F.col("value_good")))
    return m.withColumn("value_good", good).select("offset", "k", value.alias("value"))


def broken_results(frames_df: DataFrame) -> DataFrame:
    """Result events where k % 11 picks a defect: 0 cut short, 1 bad base64,
    2 no camera, 3 no image, 4 an unparseable time, 5 no text at all, 6 a list;
    7 has no prediction, which is no defect."""
    k11, cam = F.col("k") % 11, F.col("camera_id").cast("string")
    none = F.lit(None).cast("string")
    img = encode_image(F.col("props").cast("binary"))
    event = result_envelope(
        F.when(k11 == 4, F.lit("yesterday")).otherwise(iso_timestamp("ts")), F.when(k11 != 2, cam),
        F.when(k11 == 1, F.lit("@@@=")).when(k11 != 3, img),
        F.when(k11 != 7, F.concat("event_type", F.lit(" (1)\n"))))
    x = frames_df.select("camera_id", k11.alias("k11"), event.alias("event"))
    cut = F.expr("substring(event, 1, length(event) div 2)")
    return x.select(F.col("camera_id").cast("string").alias("camera_id"), F.when(F.col("k11") == 0, cut)
                    .when(F.col("k11") == 5, none).when(F.col("k11") == 6, F.lit("[1]"))
                    .otherwise(F.col("event")).alias("value"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors: camera = label, ordered by vec_id within the camera."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("bigint").alias("camera_id"), "vec_id",
                    F.col("embedding").alias("vec"))


def features_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_sequence(features(spark, sf_dir), ["camera_id"], ["vec_id"])


def names_lines(frames_df: DataFrame) -> DataFrame:
    """Lines of a label names file derived from the frames, in frame order:
    one detection label per frame, with a trailing space on every other
    line (a names file is stripped when read)."""
    lab = F.element_at(F.array(*[F.lit(x) for x in DETECTION_LABELS]), (F.col("k") % 5 + 1).cast("int"))
    line = F.when(F.col("k") % 2 == 0, F.concat(lab, F.lit(" "))).otherwise(lab)
    return frames_df.select("frame_id", line.alias("line"))
