"""SQL checks (DuckDB dialect) for the registered queries.

Each statement reads the driver tables and rebuilds the stand-in views of
FIXTURES.md in SQL, then computes the operator the direct way (window
functions, ASOF JOIN, ...). Column names equal those of ``queries.py``.
Every key has an entry.
"""

from __future__ import annotations

from .. import config as C
from ..sources.tables import DETECTION_LABELS, EVENT_CLASSES, FRAME_HEIGHT

_EVENTS = "[" + ", ".join(f"'{x}'" for x in EVENT_CLASSES) + "]"
_LABELS = "[" + ", ".join(f"'{x}'" for x in DETECTION_LABELS) + "]"

FRAMES = """frames AS (
  SELECT event_id AS frame_id, user_id AS camera_id, ts, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props
  FROM events)"""

FRAMES_SEQ_BODY = """frames_seq AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY camera_id ORDER BY ts, frame_id) - 1 AS BIGINT) AS seq
  FROM frames)"""
FRAMES_SEQ = FRAMES + ",\n" + FRAMES_SEQ_BODY

DETECTIONS_BODY = f"""det0 AS (SELECT camera_id, frame_id, ts, k, CAST(unnest(range(k % 4)) AS INTEGER) AS pos FROM frames),
detections AS (
  SELECT camera_id, frame_id, ts, pos,
         {_LABELS}[((k * (pos + 1) + pos) % 5) + 1] AS label,
         ((k * 7 + pos * 31) % 100) / 100.0::DOUBLE AS confidence,
         k * 3 + pos * 7 AS x1, k * 2 + pos * 5 - 10 AS y1,
         k * 3 + pos * 7 + 40 AS x2, k * 2 + pos * 5 - 10 + 30 AS y2,
         CASE WHEN {_LABELS}[((k * (pos + 1) + pos) % 5) + 1] = 'Pistol' THEN 'firearm' ELSE 'object' END
           AS detector
  FROM det0)"""
DETECTIONS = FRAMES + ",\n" + DETECTIONS_BODY

THRESHOLD = (f"CASE detector WHEN 'object' THEN {C.OBJECT_THRESHOLD} "
             f"WHEN 'firearm' THEN {C.FIREARM_THRESHOLD} END")

ISO_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 " \
         "THEN '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END"

MESSAGES = FRAMES + f""",
messages AS (
  SELECT CAST(camera_id % 4 AS INTEGER) AS partition, frame_id AS "offset", k, ts,
         '{{"image": "' || to_base64(encode(props)) || '", "timestamp": "' || ({ISO_TS})
           || '", "camera_id": "' || CAST(camera_id AS VARCHAR) || '"}}' AS value
  FROM frames)"""

BROKEN = FRAMES + f""",
parts AS (
  SELECT frame_id AS "offset", k, CAST(camera_id AS VARCHAR) AS cam, ({ISO_TS}) AS tstamp,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') AS tsec, to_base64(encode(props)) AS img FROM frames),
good AS (SELECT *, '{{"image": "' || img || '", "timestamp": "' || tstamp || '", "camera_id": "' || cam || '"}}'
         AS value_good FROM parts),
broken AS (
  SELECT "offset", k, CASE k % 10
    WHEN 0 THEN substring(value_good, 1, length(value_good) // 2)
    WHEN 1 THEN '{{"image": "@@@=", "timestamp": "' || tstamp || '", "camera_id": "' || cam || '"}}'
    WHEN 2 THEN '{{"image": "' || img || '", "timestamp": "' || tstamp || '"}}'
    WHEN 3 THEN '{{"image": "' || img || '", "timestamp": "yesterday", "camera_id": "' || cam || '"}}'
    WHEN 4 THEN '{{"timestamp": "' || tstamp || '", "camera_id": "' || cam || '"}}'
    WHEN 5 THEN '{{"image": "' || img || '", "timestamp": "' || tsec || '", "camera_id": "' || cam || '"}}'
    ELSE value_good END AS value
  FROM good),
parsed AS (
  SELECT "offset", value, json_valid(value) AS ok,
         CASE WHEN json_valid(value) THEN json_extract_string(value, '$.camera_id') END AS camera_id,
         CASE WHEN json_valid(value) THEN json_extract_string(value, '$.timestamp') END AS tstamp,
         CASE WHEN json_valid(value) THEN json_extract_string(value, '$.image') END AS image
  FROM broken)"""

PARSE_TS = "try_strptime(tstamp, ['%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S'])"
TS_TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"

NAMES = FRAMES + f""",
names AS (
  SELECT CAST(row_number() OVER (ORDER BY frame_id) - 1 AS BIGINT) AS label_id,
         {_LABELS}[(k % 5) + 1] AS label FROM frames)"""

PALETTE = NAMES + """,
n AS (SELECT count(*) AS n, CAST(ceil(pow(count(*), 1.0::DOUBLE / 3.0::DOUBLE)) AS BIGINT) AS b FROM names),
palette AS (
  SELECT label_id, label,
         abs(2.0 - label_id / (b * b)) * 127 AS blue,
         abs(2.0 - (label_id % (b * b)) / b) * 127 AS red,
         CAST(abs(2 - (label_id % (b * b)) % b) * 127 AS DOUBLE) AS green
  FROM names, n),
colours AS (SELECT label, arg_max(blue, label_id) AS blue, arg_max(red, label_id) AS red,
                   arg_max(green, label_id) AS green FROM palette GROUP BY label)"""

FEATURES_SEQ = """features AS (
  SELECT CAST(label AS BIGINT) AS camera_id, vec_id, embedding AS vec,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS seq
  FROM embeddings)"""


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _event_net_ctes(src: str, keys: str, n_hidden: int = 8, n_out: int = 5) -> list[str]:
    """J3 with formula weights over table ``src`` (``keys``, vec): ranked
    classes in ``erank``."""
    by = ", ".join(str(i + 1) for i in range(len(keys.split(",")) + 1))
    return [
        f"""ex AS (SELECT {keys}, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS i,
                  CAST(unnest(vec) AS DOUBLE) AS v FROM {src})""",
        f"""hid AS (
  SELECT {keys}, h, 1.0 / (1.0 + exp(-(sum(v * sin(7 * i + 3 * h) / 10.0) + cos(h) / 10.0))) AS a
  FROM ex, range({n_hidden}) t(h) GROUP BY {by})""",
        f"""eout AS (
  SELECT {keys}, c, 1.0 / (1.0 + exp(-(sum(a * cos(5 * h + 2 * c) / 10.0) + c / 20.0))) AS score
  FROM hid, range({n_out}) t(c) GROUP BY {by})""",
        f"""erank AS (SELECT {keys}, CAST(c AS INTEGER) AS class_idx, score,
             CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, c) AS INTEGER) AS rank FROM eout)"""]


def _event_net_sql() -> str:
    """J3 with formula weights (64 -> 8 -> 5) as SQL."""
    return _w("src AS (SELECT vec_id, embedding AS vec FROM embeddings)", *_event_net_ctes("src", "vec_id")) + \
        "SELECT vec_id, rank, class_idx, round(score, 6) AS score FROM erank WHERE rank <= 3"


def _activity_ctes(src: str, units: int = 20, steps: int = 4) -> list[str]:
    """J4 (LSTM with formula weights, hard-sigmoid gates) over every full
    window of ``steps`` rows of ``src`` (camera_id, seq, vec), unrolled step
    by step; the last hidden state is in ``h{steps-1}`` keyed by
    (camera_id, end_seq, u)."""
    g4 = 4 * units
    hs = "least(greatest(0.2 * ({}) + 0.5, 0.0), 1.0)"
    ctes = [f"""x AS (
  SELECT camera_id, seq, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS a, CAST(unnest(vec) AS DOUBLE) AS v
  FROM {src})""", f"""zx AS (
  SELECT camera_id, seq, g, sum(v * sin(3 * a + g) / 8.0) AS zx FROM x, range({g4}) t(g) GROUP BY 1, 2, 3)""",
            f"win AS (SELECT camera_id, seq AS end_seq FROM {src} WHERE seq >= {steps - 1})"]
    for t in range(steps):
        rec = ""
        if t:
            ctes.append(f"""rec{t} AS (
  SELECT p.camera_id, p.end_seq, gg.g, sum(p.h * cos(2 * p.u + gg.g) / 8.0) AS zr
  FROM h{t - 1} p, range({g4}) gg(g) GROUP BY 1, 2, 3)""")
            rec = f" LEFT JOIN rec{t} r ON r.camera_id = w.camera_id AND r.end_seq = w.end_seq AND r.g = zx.g"
        zr = "coalesce(r.zr, 0.0)" if t else "0.0"
        ctes.append(f"""z{t} AS (
  SELECT w.camera_id, w.end_seq, zx.g,
         zx.zx + CASE WHEN zx.g BETWEEN {units} AND {2 * units - 1} THEN 1.0 ELSE 0.0 END + {zr} AS z
  FROM win w JOIN zx ON zx.camera_id = w.camera_id AND zx.seq = w.end_seq - {steps - 1 - t}{rec})""")
        ctes.append(f"""gates{t} AS (
  SELECT camera_id, end_seq, u.u,
         max(CASE WHEN g = u.u THEN {hs.format('z')} END) AS i,
         max(CASE WHEN g = u.u + {units} THEN {hs.format('z')} END) AS f,
         max(CASE WHEN g = u.u + {2 * units} THEN tanh(z) END) AS cand,
         max(CASE WHEN g = u.u + {3 * units} THEN {hs.format('z')} END) AS o
  FROM z{t}, range({units}) u(u) GROUP BY 1, 2, 3)""")
        prev_c = "coalesce(p.c, 0.0)" if t else "0.0"
        join = (f" LEFT JOIN h{t - 1} p ON p.camera_id = q.camera_id AND p.end_seq = q.end_seq AND p.u = q.u"
                if t else "")
        ctes.append(f"""h{t} AS (
  SELECT q.camera_id, q.end_seq, q.u, q.f * {prev_c} + q.i * q.cand AS c,
         q.o * tanh(q.f * {prev_c} + q.i * q.cand) AS h
  FROM gates{t} q{join})""")
    return ctes


_ACT_SCORE = "1.0 / (1.0 + exp(-(sum(h * sin(u + 1.0) / 2.0) + 0.1)))"


def _activity_sql() -> str:
    return _w(FEATURES_SEQ, *_activity_ctes("features")) + f"""SELECT camera_id, end_seq AS seq,
       round({_ACT_SCORE}, 6) AS activity_score,
       CASE WHEN {_ACT_SCORE} > 0.5 THEN 'Abnormal Activity' ELSE 'Normal Activity' END AS activity
FROM h3 GROUP BY camera_id, end_seq"""


def _sampled_chain_sql() -> str:
    """Detections on frames due for objects/firearms, event classes and
    activity on frames due for features (stub features of size 8)."""
    feat = """feat AS (
  SELECT camera_id, frame_id, CAST(seq // 15 AS BIGINT) AS seq,
         [sin(k * d) / 2.0 FOR d IN range(1, 9)] AS vec
  FROM frames_seq WHERE seq % 15 = 0)"""
    ctes = [DETECTIONS, FRAMES_SEQ_BODY, feat, *_event_net_ctes("feat", "camera_id, frame_id"),
            *_activity_ctes("feat")]
    return _w(*ctes) + f"""SELECT d.camera_id, d.frame_id, d.detector, string_agg(d.label, ',' ORDER BY d.pos) AS result
FROM detections d JOIN frames_seq f ON f.frame_id = d.frame_id WHERE f.seq % 5 = 0
GROUP BY d.camera_id, d.frame_id, d.detector
UNION ALL
SELECT camera_id, frame_id, 'event', string_agg(CAST(class_idx AS VARCHAR), ',' ORDER BY rank)
FROM erank WHERE rank <= 3 GROUP BY camera_id, frame_id
UNION ALL
SELECT a.camera_id, feat.frame_id, 'activity',
       CASE WHEN a.score > {C.ACTIVITY_THRESHOLD} THEN 'Abnormal Activity' ELSE 'Normal Activity' END
FROM (SELECT camera_id, end_seq, {_ACT_SCORE} AS score FROM h3 GROUP BY camera_id, end_seq) a
JOIN feat ON feat.camera_id = a.camera_id AND feat.seq = a.end_seq"""


# A box as text: caption, corners, caption place, colour. Label number i of
# five, objects first: b = ceil(5^(1/3)) = 2.
BOX_TEXT = """label || ' ' || CAST(confidence AS VARCHAR) || ' ' || x1 || ',' || y1 || ',' || x2 || ',' || y2
       || ' ' || x1 || ',' || (y1 - 13) || ' ' || CAST(round(abs(2 - i / 4.0) * 127) AS INTEGER) || ','
       || CAST(round(abs(2 - (i % 4) / 2.0) * 127) AS INTEGER) || ',' || CAST(abs(2 - (i % 4) % 2) * 127 AS INTEGER)"""


def _annotated_sql(frames_body: str = FRAMES_SEQ_BODY, ids: str = "frame_id") -> str:
    """I2 over the numbered frames that ``frames_body`` defines as frames_seq."""
    d = DETECTIONS + ",\n" + frames_body
    return _w(d, f"""kept AS (
  SELECT d.*, CASE WHEN detector = 'object' THEN 0 ELSE 1 END AS dord,
         list_position(['person', 'car', 'knife', 'dog', 'Pistol'], label) - 1 AS i FROM detections d
  WHERE confidence > {THRESHOLD.replace('detector', 'd.detector')}),
sampled AS (
  SELECT f.camera_id, f.frame_id, f.seq,
         (SELECT count(*) FROM kept WHERE kept.frame_id = f.frame_id) AS n_boxes,
         (SELECT string_agg({BOX_TEXT}, '; ' ORDER BY dord, pos)
            FROM kept WHERE kept.frame_id = f.frame_id) AS boxes
  FROM frames_seq f WHERE f.seq % 5 = 0),
lab AS (SELECT frame_id, label, count(*) AS n, min(dord * 100 + pos) AS first FROM kept GROUP BY frame_id, label),
txt AS (SELECT frame_id, string_agg(label || ' (' || CAST(n AS VARCHAR) || ')' || chr(10), '' ORDER BY first)
          AS summary FROM lab GROUP BY frame_id),
per AS (
  SELECT f.*, s.frame_id AS pred_frame_id, s.n_boxes, s.boxes, s.seq AS pred_seq
  FROM frames_seq f JOIN sampled s ON s.camera_id = f.camera_id AND s.seq = f.seq - f.seq % 5),
withtext AS (
  SELECT per.*, last_value(CASE WHEN per.n_boxes > 0 THEN per.pred_frame_id END IGNORE NULLS)
           OVER (PARTITION BY camera_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS text_src
  FROM per)
SELECT w.camera_id, w.{ids}, w.seq, {ISO_TS.replace('ts', 'w.ts')} AS timestamp, w.pred_frame_id,
       CAST(w.n_boxes AS INTEGER) AS n_boxes, coalesce(w.boxes, '') AS boxes,
       coalesce(t.summary, '') AS prediction
FROM withtext w LEFT JOIN txt t ON t.frame_id = w.text_src""")


# Frames that the stream keeps: fresh by the clock of FIXTURES (age of 0 to
# 5 whole seconds), the newest of each camera and day, numbered by day.
STREAM_SEQ_BODY = """fresh AS (
  SELECT * FROM (
    SELECT *, (k % 20 - 8) * 1000000 + (frame_id % 10) * 100000
              + CASE WHEN k % 3 = 0 THEN 86400000000 ELSE 0 END AS age FROM frames)
  WHERE age >= 0 AND age < 6000000),
newest AS (
  SELECT date_trunc('day', ts) AS day, arg_max(frame_id, (ts, frame_id)) AS frame_id FROM fresh
  GROUP BY date_trunc('day', ts), camera_id),
frames_seq AS (
  SELECT f.*, CAST(row_number() OVER (PARTITION BY camera_id ORDER BY day) - 1 AS BIGINT) AS seq
  FROM newest n JOIN frames f ON f.frame_id = n.frame_id)"""


ORACLE: dict[str, str] = {
    "frame_source": _w(MESSAGES) + f"""
SELECT "offset", partition, CAST(camera_id AS VARCHAR) AS camera_id, tstamp AS timestamp,
       {TS_TEXT.format(PARSE_TS)} AS event_ts, decode(from_base64(image)) AS image
FROM (SELECT "offset", partition, json_extract_string(value, '$.camera_id') AS camera_id,
             json_extract_string(value, '$.timestamp') AS tstamp, json_extract_string(value, '$.image') AS image
      FROM messages)""",
    "result_sink": _w(FRAMES) + f"""
SELECT CAST(camera_id AS VARCHAR) AS camera_id, {ISO_TS} AS timestamp, props AS image,
       CASE WHEN k % 4 <> 0 THEN event_type || ' (1)' || chr(10) END AS prediction FROM frames""",
    "result_source": _w(FRAMES) + f"""
SELECT CAST(camera_id AS VARCHAR) AS camera_id, {ISO_TS} AS timestamp, props AS image,
       CASE WHEN k % 4 <> 0 THEN event_type || ' (1)' || chr(10) END AS prediction FROM frames""",
    "frame_ingest": _w(FRAMES) + """
SELECT CAST(camera_id AS VARCHAR) AS camera_id, frame_id, props AS image FROM frames""",
    "label_dim": _w(NAMES) + "SELECT label_id, label FROM names",
    "model_registry": _w(FRAMES) + """
SELECT event_type AS model, event_type || '.weights' AS weights, event_type || '.cfg' AS config,
       event_type || '.names' AS labels, min(k) AS "offset", CAST(count(*) AS INTEGER) AS classes,
       true AS resolved
FROM frames GROUP BY event_type""",
    "event_label_map": _w(FRAMES) + f"""
SELECT frame_id * 2 AS label_id, event_type AS name FROM frames
UNION ALL SELECT frame_id * 2 + 1, {_LABELS}[(k % 5) + 1] FROM frames""",
    "parse_frames": _w(MESSAGES) + """
SELECT "offset", json_extract_string(value, '$.camera_id') AS camera_id,
       json_extract_string(value, '$.timestamp') AS timestamp, json_extract_string(value, '$.image') AS image
FROM messages""",
    "parse_event_time": _w(BROKEN) + f"""
SELECT "offset", tstamp AS timestamp, {TS_TEXT.format(PARSE_TS)} AS event_ts FROM parsed""",
    "image_decode": _w(BROKEN) + """
SELECT "offset", decode(try(from_base64(image))) AS image FROM parsed""",
    "image_encode": _w(FRAMES) + "SELECT frame_id, to_base64(encode(props)) AS image FROM frames",
    "result_envelope": _w(FRAMES) + f"""
SELECT frame_id, {ISO_TS} AS timestamp, CAST(camera_id AS VARCHAR) AS camera_id, props AS image,
       CASE WHEN k % 4 <> 0 THEN event_type || ' (1)' || chr(10) END AS prediction,
       true AS has_prediction_key FROM frames""",
    "bad_records": _w(BROKEN) + f"""
SELECT "offset", reason FROM (
  SELECT "offset", CASE
    WHEN NOT ok THEN 'malformed_json'
    WHEN camera_id IS NULL THEN 'missing_camera_id'
    WHEN tstamp IS NULL THEN 'missing_timestamp'
    WHEN image IS NULL THEN 'missing_image'
    WHEN {PARSE_TS} IS NULL THEN 'bad_timestamp'
    WHEN try(from_base64(image)) IS NULL THEN 'bad_image' END AS reason
  FROM parsed) WHERE reason IS NOT NULL""",
    "freshness_filter": _w(FRAMES) + """
SELECT frame_id, camera_id, age_us FROM (
  SELECT frame_id, camera_id, CAST(((k % 20) - 8) * 1000000 + (frame_id % 10) * 100000
         + CASE WHEN k % 3 = 0 THEN 86400000000 ELSE 0 END AS BIGINT) AS age_us FROM frames)
WHERE age_us >= 0 AND floor(age_us / 1000000) <= 5""",
    "freshness_filter_wrap": _w(FRAMES) + """
SELECT frame_id, camera_id, age_us FROM (
  SELECT frame_id, camera_id, CAST(((k % 20) - 8) * 1000000 + (frame_id % 10) * 100000
         + CASE WHEN k % 3 = 0 THEN 86400000000 ELSE 0 END AS BIGINT) AS age_us FROM frames)
WHERE ((floor(age_us / 1000000) % 86400) + 86400) % 86400 <= 5""",
    "confidence_filter": _w(DETECTIONS) + f"""
SELECT frame_id, pos, detector, label, confidence FROM detections WHERE confidence > {THRESHOLD}""",
    "watchlist_flag": _w(DETECTIONS) + """
SELECT frame_id, bool_or(lower(trim(label)) IN ('pistol', 'knife')) AS suspicious,
       bool_or(label IN ('pistol', 'knife')) AS suspicious_exact
FROM detections GROUP BY frame_id""",
    "watchlist_events": f"""
WITH s AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS class_idx,
                  CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class_idx) AS INTEGER) AS rank FROM s)
SELECT vec_id, rank, class_idx, {_EVENTS}[class_idx % {len(EVENT_CLASSES)} + 1] AS label
FROM r WHERE rank <= 3 AND class_idx % 2 = 0""",
    "nonempty_filter": _w(DETECTIONS) + f"""
SELECT frame_id, CAST(count(*) AS INTEGER) AS n FROM detections WHERE confidence > {THRESHOLD}
GROUP BY frame_id""",
    "latest_per_camera": _w(FRAMES) + f"""
SELECT strftime(ts, '%Y-%m-%d') AS batch_day, camera_id, arg_max(frame_id, (ts, frame_id)) AS frame_id,
       {TS_TEXT.format('max(ts)')} AS ts
FROM frames GROUP BY 1, 2""",
    "latest_per_camera_window": _w(FRAMES) + f"""
SELECT {TS_TEXT.format("date_trunc('day', ts)")} AS window_start, camera_id,
       arg_max(frame_id, (ts, frame_id)) AS frame_id
FROM frames GROUP BY date_trunc('day', ts), camera_id""",
    "event_topk": _w(FRAMES) + f""",
s AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS class_idx,
             CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class_idx) AS INTEGER) AS rank
      FROM s),
names AS (SELECT frame_id * 2 AS label_id, event_type AS name FROM frames
          UNION ALL SELECT frame_id * 2 + 1, {_LABELS}[(k % 5) + 1] FROM frames)
SELECT r.vec_id, r.rank, r.class_idx, r.score, n.name FROM r LEFT JOIN names n ON n.label_id = r.class_idx
WHERE r.rank <= 3""",
    "activity_threshold": _w(DETECTIONS) + """
SELECT frame_id, pos, CASE WHEN confidence > 0.5 THEN 'Abnormal Activity' ELSE 'Normal Activity' END
       AS activity FROM detections""",
    "sample_every_n": _w(FRAMES_SEQ) + "SELECT camera_id, frame_id, seq FROM frames_seq WHERE seq % 5 = 0",
    "sampling_schedule": _w(FRAMES_SEQ) + """
SELECT camera_id, frame_id, seq, detector FROM frames_seq,
  (VALUES ('object', 5), ('firearm', 5), ('feature', 15)) d(detector, rate)
WHERE seq % rate = 0""",
    "sampling_cycle": _w(FRAMES_SEQ) + """
SELECT camera_id, CAST(floor(seq / 15) AS BIGINT) AS cycle, count(*) AS n_frames,
       CAST(sum(CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_object,
       CAST(sum(CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_firearm,
       CAST(sum(CASE WHEN seq % 15 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_feature
FROM frames_seq GROUP BY 1, 2""",
    "union_detections": _w(DETECTIONS) + """
SELECT frame_id, detector, pos,
       CAST(row_number() OVER (PARTITION BY frame_id ORDER BY CASE WHEN detector = 'object' THEN 0 ELSE 1 END,
                               pos) - 1 AS INTEGER) AS union_pos
FROM detections""",
    "label_lookup": _w(NAMES) + """
SELECT f.frame_id, CAST(f.k AS BIGINT) AS k, n.label FROM frames f LEFT JOIN names n ON n.label_id = f.k""",
    "label_palette": _w(PALETTE) + "SELECT label_id, label, blue, red, green FROM palette",
    "color_lookup": _w(PALETTE + ",\n" + DETECTIONS_BODY) + """
SELECT d.frame_id, d.pos, d.label, coalesce(c.blue, 255.0) AS blue, coalesce(c.red, 0.0) AS red,
       coalesce(c.green, 0.0) AS green
FROM detections d LEFT JOIN colours c ON c.label = d.label""",
    "asof_prediction": _w(FRAMES) + """
SELECT f.frame_id, f.camera_id, p.frame_id AS pred_frame_id, p.value AS pred_value
FROM frames f
ASOF LEFT JOIN (SELECT * FROM frames WHERE event_type = 'signup') p
  ON f.camera_id = p.camera_id AND f.ts >= p.ts""",
    "prediction_state": _w(DETECTIONS + ",\n" + FRAMES_SEQ_BODY) + """,
lists AS (
  SELECT camera_id, ts, frame_id, 'object' AS detector FROM frames_seq WHERE seq % 5 = 0
  UNION ALL SELECT camera_id, ts, frame_id, 'firearm' FROM frames_seq WHERE seq % 5 = 0
  UNION ALL SELECT camera_id, ts, frame_id, 'event' FROM frames_seq WHERE seq % 15 = 0
  UNION ALL SELECT camera_id, ts, frame_id, 'activity' FROM frames_seq WHERE seq % 15 = 0),
last AS (SELECT camera_id, detector, arg_max(frame_id, (ts, frame_id)) AS frame_id FROM lists GROUP BY ALL),
found AS (
  SELECT frame_id, detector, pos, label, confidence FROM detections
  UNION ALL SELECT frame_id, 'event', 0, event_type, k / 100.0::DOUBLE FROM frames WHERE k % 4 <> 0
  UNION ALL SELECT frame_id, 'activity', 0,
                   CASE WHEN k / 100.0::DOUBLE > 0.5 THEN 'Abnormal Activity' ELSE 'Normal Activity' END,
                   k / 100.0::DOUBLE FROM frames)
SELECT l.camera_id, l.detector, l.frame_id, CAST(count(f.label) AS INTEGER) AS n_boxes,
       coalesce(string_agg(f.label || ' ' || CAST(f.confidence AS VARCHAR), '; ' ORDER BY f.pos), '') AS boxes
FROM last l LEFT JOIN found f ON f.frame_id = l.frame_id AND f.detector = l.detector
GROUP BY ALL""",
    "detector_toggle": _w(FRAMES_SEQ) + """
SELECT camera_id, frame_id, detector FROM frames_seq,
  (VALUES ('object', 5), ('feature', 15)) d(detector, rate) WHERE seq % rate = 0""",
    "label_counts": _w(DETECTIONS) + "SELECT frame_id, label, count(*) AS n FROM detections GROUP BY 1, 2",
    "summary_text": _w(DETECTIONS) + """
SELECT frame_id, string_agg(label || ' (' || CAST(n AS VARCHAR) || ')' || chr(10), '' ORDER BY first)
       AS summary
FROM (SELECT frame_id, label, count(*) AS n, min(pos) AS first FROM detections GROUP BY 1, 2)
GROUP BY frame_id""",
    "batch_metrics": _w(FRAMES) + """
SELECT strftime(ts, '%Y-%m-%d') AS batch_day, count(*) AS n_messages, count(DISTINCT camera_id) AS n_processed
FROM frames GROUP BY 1""",
    "rolling_features": _w(FEATURES_SEQ) + """
SELECT camera_id, seq, ids FROM (
  SELECT camera_id, seq,
         string_agg(CAST(vec_id AS VARCHAR), ',') OVER w AS ids, count(*) OVER w AS n
  FROM features WINDOW w AS (PARTITION BY camera_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
WHERE n = 4""",
    "carry_forward_text": _w(FRAMES_SEQ) + """
SELECT frame_id, coalesce(last_value(NULLIF(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, '')
       IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       '') AS shown_text
FROM frames_seq""",
    "latest_feature": _w(FEATURES_SEQ) + """
SELECT camera_id, arg_max(vec_id, seq) AS vec_id,
       round(list_reduce(list_transform(arg_max(vec, seq), lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b), 6)
       AS vec_sum
FROM features GROUP BY camera_id""",
    "box_overlays": _w(PALETTE + ",\n" + DETECTIONS_BODY) + f"""
SELECT d.frame_id, d.pos, d.x1, d.y1, d.x2, d.y2, d.label || ' ' || CAST(d.confidence AS VARCHAR) AS caption,
       d.x1 AS caption_x, d.y1 - 13 AS caption_y, {FRAME_HEIGHT} * 0.001::DOUBLE AS font_scale,
       coalesce(c.blue, 255.0) AS blue, coalesce(c.red, 0.0) AS red, coalesce(c.green, 0.0) AS green
FROM detections d LEFT JOIN colours c ON c.label = d.label""",
    "annotated_results": _annotated_sql(),
    "annotated_stream": f"""
SELECT CAST(camera_id AS VARCHAR) AS camera_id, timestamp, prediction, n_boxes, boxes,
       props AS image FROM ({_annotated_sql(STREAM_SEQ_BODY)}) r JOIN (SELECT event_id, props FROM events) e
  ON e.event_id = r.frame_id""",
    "score_detections": _w(DETECTIONS) + """
SELECT frame_id AS "offset", pos, label, confidence, x1, y1, x2, y2 FROM detections""",
    "score_features": _w(FRAMES) + """
SELECT frame_id AS "offset",
       round(list_reduce([sin(k * d) / 2.0 FOR d IN range(1, 9)], lambda a, b: a + b), 6) AS v_sum,
       round(sin(k * 1) / 2.0, 6) AS v0
FROM frames""",
    "score_events": _event_net_sql(),
    "score_activity": _activity_sql(),
    "score_frames_sampled": _sampled_chain_sql(),
}
RATE_CTES = """changes AS (
  SELECT * FROM (VALUES ('object', 5, true, 0), ('firearm', 5, true, 0), ('feature', 15, true, 0), ('object', 3, true, 1),
                        ('feature', 15, false, 1), ('firearm', 2, true, 2), ('feature', 4, true, 2)) v(detector, rate, enabled, n)),
range_ AS (SELECT min(ts) AS lo, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM frames),
epochs AS (SELECT n AS epoch, lo + to_microseconds(us * n // 3) AS valid_from,
                  CASE WHEN n < 2 THEN lo + to_microseconds(us * (n + 1) // 3) END AS valid_to
           FROM range_, range(3) r(n)),
rates AS (
  SELECT CAST(epoch AS INTEGER) AS epoch, detector, arg_max(rate, n) AS rate FROM epochs JOIN changes ON n <= epoch
  GROUP BY epoch, detector HAVING arg_max(enabled, n))"""
ORACLE["rate_changes"] = _w(FRAMES, RATE_CTES) + """,
tagged AS (
  SELECT f.camera_id, f.frame_id, CAST(e.epoch AS INTEGER) AS epoch,
         CAST(row_number() OVER (PARTITION BY camera_id, e.epoch ORDER BY ts, frame_id) - 1 AS BIGINT) AS seq
  FROM frames f JOIN epochs e ON f.ts >= e.valid_from AND (e.valid_to IS NULL OR f.ts < e.valid_to))
SELECT t.camera_id, t.frame_id, t.epoch, t.seq, r.detector FROM tagged t JOIN rates r ON r.epoch = t.epoch AND t.seq % r.rate = 0"""
ORACLE["rate_intervals"] = _w(FRAMES, RATE_CTES) + f""",
per AS (SELECT epoch, string_agg(detector || ' ' || rate, ', ' ORDER BY detector) AS rates,
               CAST(list_reduce(list(rate), lambda a, b: lcm(a, b)) AS INTEGER) AS cycle FROM rates GROUP BY epoch)
SELECT p.epoch, {TS_TEXT.format('e.valid_from')} AS valid_from, p.rates, p.cycle, count(*) AS n_frames
FROM per p JOIN epochs e ON e.epoch = p.epoch
JOIN frames f ON f.ts >= e.valid_from AND (e.valid_to IS NULL OR f.ts < e.valid_to) GROUP BY ALL"""
ORACLE["stream_events"] = _w(
    FRAMES, STREAM_SEQ_BODY, """feat AS (
  SELECT camera_id, frame_id, CAST(seq // 2 AS BIGINT) AS seq, [sin(k * d) / 2.0 FOR d IN range(1, 9)] AS vec
  FROM frames_seq WHERE seq % 2 = 0)""", *_event_net_ctes("feat", "camera_id, frame_id"), *_activity_ctes("feat")) + f""",
best AS (SELECT frame_id, string_agg(CAST(class_idx AS VARCHAR), ',' ORDER BY rank) AS events FROM erank WHERE rank <= 3 GROUP BY 1),
act AS (SELECT camera_id, end_seq, CASE WHEN {_ACT_SCORE} > {C.ACTIVITY_THRESHOLD} THEN 'Abnormal Activity' ELSE 'Normal Activity' END
               AS activity FROM h3 GROUP BY camera_id, end_seq)
SELECT CAST(f.camera_id AS VARCHAR) AS camera_id, f.frame_id, v.frame_id AS event_frame_id, b.events, a.activity
FROM frames_seq f JOIN feat v ON v.camera_id = f.camera_id AND v.seq = f.seq // 2 JOIN best b ON b.frame_id = v.frame_id
LEFT JOIN act a ON a.camera_id = v.camera_id AND a.end_seq = v.seq"""
ORACLE["micro_batch_trigger"] = ORACLE["latest_per_camera"]
ORACLE["late_data"] = _w(FRAMES) + """,
b AS (SELECT min(ts) + to_microseconds((epoch_us(max(ts)) - epoch_us(min(ts))) // 2) AS cut, max(ts) AS hi
      FROM frames),
newer AS (SELECT f.*, b.hi FROM frames f, b WHERE f.ts >= b.cut)
SELECT epoch_us(date_trunc('day', ts)) AS window_start_us, camera_id,
       arg_max(frame_id, (ts, frame_id)) AS frame_id
FROM newer GROUP BY date_trunc('day', ts), camera_id, hi
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= hi - INTERVAL 1 DAY"""

ORACLE["annotated_images"] = ORACLE["annotated_stream"]
ORACLE["late_rows"] = _w(FRAMES) + """,
b AS (SELECT min(ts) + to_microseconds((epoch_us(max(ts)) - epoch_us(min(ts))) // 2) AS cut, max(ts) AS hi FROM frames)
SELECT frame_id, camera_id, epoch_us(ts) AS event_us FROM frames, b
WHERE ts < cut AND date_trunc('day', ts) + INTERVAL 1 DAY <= hi - INTERVAL 1 DAY"""
_CLOSED = "date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM frames) - INTERVAL 1 DAY"
ORACLE["label_counts_stream"] = _w(DETECTIONS) + f"""
SELECT epoch_us(date_trunc('day', ts)) AS window_start_us, camera_id, label, count(*) AS n
FROM detections WHERE {_CLOSED} GROUP BY ALL"""
# Frames up to the watermark (whole milliseconds) are numbered; the newest of
# them closes the days before it.
ORACLE["sampling_cycle_stream"] = _w(FRAMES_SEQ) + """,
passed AS (SELECT *, max(ts) OVER () AS newest FROM frames_seq
           WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) - 86400000 FROM frames))
SELECT epoch_us(date_trunc('day', ts)) AS window_start_us, camera_id, count(*) AS n_frames,
       count(*) FILTER (seq % 5 = 0) AS n_object, count(*) FILTER (seq % 5 = 0) AS n_firearm, count(*) FILTER (seq % 15 = 0) AS n_feature
FROM passed WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= newest GROUP BY date_trunc('day', ts), camera_id"""
ORACLE["bad_results"] = _w(FRAMES) + f"""
SELECT CASE WHEN reason IS NULL THEN CAST(camera_id AS VARCHAR) END AS camera_id,
       CASE WHEN reason IS NULL THEN {ISO_TS} END AS timestamp, CASE WHEN reason IS NULL THEN props END AS image,
       CASE WHEN reason IS NULL AND k % 11 <> 7 THEN event_type || ' (1)' || chr(10) END AS prediction, reason
FROM (SELECT *, CASE WHEN k % 11 IN (0, 5, 6) THEN 'malformed_json' WHEN k % 11 = 1 THEN 'bad_image'
                     WHEN k % 11 = 2 THEN 'missing_camera_id' WHEN k % 11 = 3 THEN 'missing_image'
                     WHEN k % 11 = 4 THEN 'bad_timestamp' END AS reason FROM frames)"""


def _delayed_sql(frames_body: str, columns: str) -> str:
    """I2 where predictions take time: every frame against all predictions of
    its camera that completed before it."""
    return _w(DETECTIONS, frames_body) + f""",
kept AS (
  SELECT d.*, CASE WHEN detector = 'object' THEN 0 ELSE 1 END AS dord,
         list_position(['person', 'car', 'knife', 'dog', 'Pistol'], label) - 1 AS i FROM detections d
  WHERE confidence > {THRESHOLD.replace('detector', 'd.detector')}),
preds AS (
  SELECT camera_id, frame_id, seq, 'object' AS detector, ts + to_hours(k % 7 * 9) AS done FROM frames_seq WHERE seq % 5 = 0
  UNION ALL SELECT camera_id, frame_id, seq, 'firearm', ts + to_hours(k % 5 * 17) FROM frames_seq WHERE seq % 5 = 0),
shown AS (
  SELECT f.frame_id, p.detector, arg_max(p.frame_id, (p.done, p.seq)) AS src
  FROM frames_seq f JOIN preds p ON p.camera_id = f.camera_id AND p.done <= f.ts GROUP BY f.frame_id, p.detector),
boxes AS (
  SELECT s.frame_id, k.* EXCLUDE (frame_id) FROM shown s JOIN kept k ON k.frame_id = s.src AND k.detector = s.detector),
lab AS (SELECT frame_id, label, count(*) AS n, min(dord * 100 + pos) AS first FROM boxes GROUP BY frame_id, label),
txt AS (SELECT frame_id, string_agg(label || ' (' || CAST(n AS VARCHAR) || ')' || chr(10), '' ORDER BY first) AS summary
        FROM lab GROUP BY frame_id),
agg AS (SELECT frame_id, count(*) AS n_boxes, string_agg({BOX_TEXT}, '; ' ORDER BY dord, pos) AS boxes FROM boxes GROUP BY frame_id)
SELECT {columns},
       o.src AS object_frame_id, a.src AS firearm_frame_id,
       CAST(coalesce(g.n_boxes, 0) AS INTEGER) AS n_boxes, coalesce(g.boxes, '') AS boxes,
       coalesce(last_value(t.summary IGNORE NULLS) OVER (PARTITION BY f.camera_id ORDER BY f.seq
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS prediction
FROM frames_seq f LEFT JOIN shown o ON o.frame_id = f.frame_id AND o.detector = 'object'
LEFT JOIN shown a ON a.frame_id = f.frame_id AND a.detector = 'firearm'
LEFT JOIN agg g ON g.frame_id = f.frame_id LEFT JOIN txt t ON t.frame_id = f.frame_id"""


ORACLE["annotated_delayed"] = _delayed_sql(FRAMES_SEQ_BODY, f"f.camera_id, f.frame_id, f.seq, {ISO_TS.replace('ts', 'f.ts')} AS timestamp")
ORACLE["stream_delayed"] = _delayed_sql(STREAM_SEQ_BODY, "CAST(f.camera_id AS VARCHAR) AS camera_id, f.frame_id, f.seq")
