"""Column functions for the wire format of frame and result events.

All are built-in Spark expressions, so they run inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EVENT_TIME_PATTERN

FRAME_EVENT_SCHEMA = T.StructType([
    T.StructField("image", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("camera_id", T.StringType()),
])

# Parsing adds a column that holds the text of a malformed record, so one
# from_json tells both the fields and whether the JSON was well formed.
CORRUPT_FIELD = "_corrupt"

RESULT_EVENT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("camera_id", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("prediction", T.StringType()),
])

_B64_ALPHABET_COMPLEMENT = "[^A-Za-z0-9+/=]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_frame_event(value, schema: T.StructType = FRAME_EVENT_SCHEMA, fail_fast: bool = False) -> Column:
    """B1: JSON text (or Kafka value bytes) to a struct. Malformed text gives
    NULL fields and the text in ``_corrupt``, which ``bad_record_reason``
    reports; with ``fail_fast`` it is an error."""
    if fail_fast:
        ev = F.from_json(_c(value).cast("string"), schema, {"mode": "FAILFAST"})
        return F.struct(*[ev[f.name].alias(f.name) for f in schema.fields],
                        F.lit(None).cast("string").alias(CORRUPT_FIELD))
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT_FIELD, T.StringType())])
    return F.from_json(_c(value).cast("string"), with_corrupt,
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_FIELD})


def parse_event_time(text) -> Column:
    """B2: the wire time stamp, with or without the fractional part; NULL
    when it does not parse. Interpreted in the session time zone."""
    return F.try_to_timestamp(_c(text), F.lit(EVENT_TIME_PATTERN))


def decode_image(text, lenient: bool = False) -> Column:
    """base64 text to bytes, NULL when invalid. ``lenient`` drops
    characters outside the base64 alphabet first, as a permissive decoder does."""
    t = _c(text)
    if lenient:
        t = F.regexp_replace(t, _B64_ALPHABET_COMPLEMENT, "")
    return F.try_to_binary(t, F.lit("base64"))


def encode_image(data) -> Column:
    """Bytes to base64 text on one line."""
    return F.regexp_replace(F.base64(_c(data)), r"\s", "")


def iso_timestamp(ts) -> Column:
    """Time stamp as ``YYYY-MM-DDTHH:MM:SS[.ffffff]``: the fraction is left
    out when it is zero, as the frame producer writes it."""
    t = _c(ts)
    frac = F.date_format(t, "SSSSSS")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")))


def ts_text(ts) -> Column:
    """Time stamp as text with microseconds, for reports and oracle checks."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def frame_message(image_b64, timestamp, camera_id) -> Column:
    """Frame event JSON as the producer serialises it (keys image, timestamp,
    camera_id; ``", "`` and ``": "`` separators)."""
    return F.to_json(F.struct(_c(image_b64).alias("image"), _c(timestamp).alias("timestamp"),
                              _c(camera_id).alias("camera_id")))


def result_envelope(timestamp, camera_id, image_b64, prediction) -> Column:
    """The result event as JSON text; NULL fields are kept as null."""
    return F.to_json(
        F.struct(_c(timestamp).alias("timestamp"), _c(camera_id).alias("camera_id"),
                 _c(image_b64).alias("image"), _c(prediction).alias("prediction")),
        {"ignoreNullFields": "false"})


def bad_record_reason(parsed="_ev", missing=None) -> Column:
    """Why a frame message cannot be processed, NULL when it can.
    ``parsed`` is the struct produced by ``parse_frame_event`` or its fields
    by name; ``missing`` says that there was no message at all."""
    p = _c(parsed) if isinstance(parsed, (str, Column)) else parsed
    if missing is None:
        missing = p.isNull()
    return (F.when(missing | p[CORRUPT_FIELD].isNotNull(), F.lit("malformed_json"))
            .when(p["camera_id"].isNull(), F.lit("missing_camera_id"))
            .when(p["timestamp"].isNull(), F.lit("missing_timestamp"))
            .when(p["image"].isNull(), F.lit("missing_image"))
            .when(parse_event_time(p["timestamp"]).isNull(), F.lit("bad_timestamp"))
            .when(decode_image(p["image"]).isNull(), F.lit("bad_image")))
