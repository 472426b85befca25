"""Frame and result streams (A1-A4): Kafka topics, or folders of files with
the same columns for tests and replays. Each reader works as a stream
(``readStream``) or as a batch (``read``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import FRAME_TOPIC, RESULT_TOPIC
from ..functions import codec
from ..operators.filters import split_bad_records

RECORD_SCHEMA = "partition INT, offset BIGINT, value STRING"
RESULT_RECORD_SCHEMA = "camera_id STRING, value STRING"
BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def kafka_options(endpoint: str, topic: str = FRAME_TOPIC, starting_offsets: str = "latest",
                  max_offsets_per_trigger: int | None = None, fail_on_data_loss: bool = True) -> dict[str, str]:
    """Options of the Kafka source. Offsets that the topic no longer has stop
    the query unless ``fail_on_data_loss`` is off. ``maxOffsetsPerTrigger`` bounds a
    micro-batch, the way the original drops all but the newest frame."""
    o = {"kafka.bootstrap.servers": endpoint, "subscribe": topic, "startingOffsets": starting_offsets,
         "failOnDataLoss": str(fail_on_data_loss).lower()}
    if max_offsets_per_trigger:
        o["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return o


def _reader(spark: SparkSession, streaming: bool):
    return spark.readStream if streaming else spark.read


def frame_records(spark: SparkSession, fmt: str = "kafka", path: str | None = None,
                  options: dict | None = None, streaming: bool = True,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw frame records: partition, offset, value (text), ingest_ts."""
    r = _reader(spark, streaming)
    if fmt == "kafka":
        return (r.format("kafka").options(**(options or {})).load()
                .select("partition", "offset", F.col("value").cast("string").alias("value"),
                        F.col("timestamp").alias("ingest_ts")))
    r = r.schema(RECORD_SCHEMA)
    if streaming and max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return (r.format(fmt).load(path)
            .withColumn("ingest_ts", F.col("_metadata.file_modification_time")))


def parse_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B1-B3 and B6 on raw records: (frames, quarantined). Frames have
    camera_id, timestamp (wire text), event_ts, image (bytes), partition,
    offset, ingest_ts."""
    good, bad = split_bad_records(records, "value")
    frames = good.select("partition", "offset", "ingest_ts", "camera_id", "timestamp",
                         codec.parse_event_time("timestamp").alias("event_ts"),
                         codec.decode_image("image").alias("image"))
    return frames, bad


def frame_source(spark: SparkSession, fmt: str = "kafka", path: str | None = None,
                 options: dict | None = None, streaming: bool = True,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A1: parsed frames from the frame topic (or a folder of records)."""
    frames, _ = parse_records(frame_records(spark, fmt, path, options, streaming, max_files_per_trigger))
    return frames


def result_sink(results: DataFrame, fmt: str = "kafka", path: str | None = None,
                options: dict | None = None, checkpoint: str | None = None,
                available_now: bool = False, interval: str | None = None) -> StreamingQuery:
    """A2: write result events (``camera_id``, ``value`` JSON text), keyed by
    camera. Kafka is at-least-once; the file sink is exactly-once."""
    out = results.select(F.col("camera_id").alias("key"), "value") if fmt == "kafka" else \
        results.select("camera_id", "value")
    w = out.writeStream.option("checkpointLocation", checkpoint)
    if fmt == "kafka":
        w = w.format("kafka").options(**(options or {}))
        if not (options or {}).get("topic"):
            w = w.option("topic", RESULT_TOPIC)
    else:
        w = w.format(fmt).option("path", path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval or "1 second")
    return w.start()


def frame_ingest(spark: SparkSession, stills_dir: str, streaming: bool = True,
                 glob: str | None = None) -> DataFrame:
    """A3: a folder of still images, one file per frame under a folder per
    camera, to frame records (value = the producer's JSON). The file's
    modification time is the frame time. Camera: a ``camera_id=`` folder if
    the path has one, else the file's folder; frame id: a ``frame_id=``
    folder, else the file name when it is a number."""
    r = _reader(spark, streaming).format("binaryFile").option("recursiveFileLookup", "true")
    if streaming:
        r = r.schema(BINARY_FILE_SCHEMA)
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(stills_dir)
    parts = F.split("path", "/")

    def tagged(name):  # value of a ``name=value`` folder in the path, else NULL
        return F.nullif(F.regexp_extract("path", f"/{name}=([^/]+)/", 1), F.lit(""))

    camera = F.coalesce(tagged("camera_id"), F.element_at(parts, -2))
    stem = F.regexp_extract(F.element_at(parts, -1), r"^([^.]+)", 1)
    frame = F.coalesce(tagged("frame_id").try_cast("bigint"), stem.try_cast("bigint"))
    msg = codec.frame_message(codec.encode_image("content"), codec.iso_timestamp("modificationTime"), camera)
    return files.select(camera.alias("camera_id"), frame.alias("frame_id"), msg.alias("value"))


def result_records(spark: SparkSession, fmt: str = "kafka", path: str | None = None,
                   options: dict | None = None, streaming: bool = True) -> DataFrame:
    """Raw result records: one column ``value`` (text)."""
    r = _reader(spark, streaming)
    if fmt == "kafka":
        return r.format("kafka").options(**(options or {})).load().select(F.col("value").cast("string").alias("value"))
    return r.schema(RESULT_RECORD_SCHEMA).format(fmt).load(path).select("value")


def parse_results(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4 on raw result records: (results, quarantined). A viewer cannot show
    an event that is not JSON or lacks a camera, a time or a readable image;
    such rows keep their ``value`` and a ``reason`` (B6). The prediction may
    be null, as the envelope (B5) writes it."""
    good, bad = split_bad_records(records.select("value"), schema=codec.RESULT_EVENT_SCHEMA)
    results = good.select("timestamp", "camera_id", codec.decode_image("image").alias("image"), "prediction")
    return results, bad


def result_source(spark: SparkSession, fmt: str = "kafka", path: str | None = None,
                  options: dict | None = None, streaming: bool = True) -> DataFrame:
    """A4: result events parsed, image decoded to bytes. Malformed events are
    left out; ``parse_results`` returns them, ``drain_results`` stores them."""
    results, _ = parse_results(result_records(spark, fmt, path, options, streaming))
    return results
