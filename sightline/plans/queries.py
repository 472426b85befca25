"""Registered queries: one per operator of SURVEY §2, each reading the
driver tables (or data Spark derives from them) at ``sf_dir``.

Every function takes (spark, sf_dir) and returns a DataFrame whose columns
match the SQL check of the same name in ``oracle.py``. Time stamps are
reported as text and list-valued results as scalars or text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import codec
from ..functions.lists import (counts_of_list, held, keep_confident, of_detector, on_watchlist_list, stub_prediction_list,
                               summary_of_list, union_of_lists)
from ..operators import combine, filters, ordered, overlay, scoring, select, summarize
from ..session import scratch_path
from ..sources import dims, tables as TB
from . import annotate

_DEFAULT = C.DEFAULT_CONFIG


def _frames(spark, sf):
    return TB.frames(spark, sf)


# --- A: sources and sinks -------------------------------------------------

def label_dim(spark: SparkSession, sf: str) -> DataFrame:
    path = TB.derived_path(spark, sf, "events", "names", lambda p: TB.names_lines(_frames(spark, sf))
                           .orderBy("frame_id").select("line").write.text(p))
    return dims.read_label_file(spark, path)


def model_registry(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "models")
    cfg = (TB.frames(spark, sf).groupBy(F.col("event_type").alias("model"))
           .agg(F.min("k").alias("offset"), F.count(F.lit(1)).cast("int").alias("classes"))
           .select("model", F.concat("model", F.lit(".weights")).alias("weights"),
                   F.concat("model", F.lit(".cfg")).alias("config"), "offset", "classes",
                   F.concat("model", F.lit(".names")).alias("labels")))
    cfg.write.partitionBy("model").json(path)
    r = dims.read_model_registry(spark, path)
    resolved = F.col("weights_path").endswith(
        F.concat(F.lit("/model="), F.col("model"), F.lit("/"), F.col("weights")))
    return r.select("model", "weights", "config", "labels", "offset", "classes", resolved.alias("resolved"))


def event_label_map(spark: SparkSession, sf: str) -> DataFrame:
    def write(path):
        f = _frames(spark, sf)
        lab = F.element_at(F.array(*[F.lit(x) for x in TB.DETECTION_LABELS]), (F.col("k") % 5 + 1).cast("int"))
        obj = F.to_json(F.create_map((F.col("frame_id") * 2).cast("string"), F.col("event_type"),
                                     (F.col("frame_id") * 2 + 1).cast("string"), lab))
        f.select(obj.alias("value")).write.text(path)
    return dims.event_label_map(spark.read.text(TB.derived_path(spark, sf, "events", "eventlabels", write)))


def frame_source(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import streams
    from ..streaming import pipeline
    src = scratch_path(spark, "frames-in")
    TB.messages(_frames(spark, sf)).select("partition", "offset", "value").write.json(src)
    stream = streams.frame_source(spark, "json", path=src, streaming=True)
    out = pipeline.drain_to_table(stream, scratch_path(spark, "frames-out"))
    return out.select("offset", "partition", "camera_id", "timestamp",
                      codec.ts_text("event_ts").alias("event_ts"),
                      F.col("image").cast("string").alias("image"))


def _result_events(spark, sf):
    f = _frames(spark, sf)
    pred = F.when(F.col("k") % 4 != 0, F.concat(F.col("event_type"), F.lit(" (1)\n")))
    return f.select("frame_id", F.col("camera_id").cast("string").alias("camera_id"),
                    codec.result_envelope(codec.iso_timestamp("ts"), F.col("camera_id").cast("string"),
                                          codec.encode_image(F.col("props").cast("binary")), pred)
                    .alias("value"))


def result_sink(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import streams
    src = scratch_path(spark, "results-in")
    _result_events(spark, sf).write.parquet(src)
    sink = scratch_path(spark, "results-out")
    q = streams.result_sink(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src),
                            "json", path=sink, checkpoint=scratch_path(spark, "results-ckpt"),
                            available_now=True)
    q.awaitTermination()
    return streams.result_source(spark, "json", sink, streaming=False).select(
        "camera_id", "timestamp", F.col("image").cast("string").alias("image"), "prediction")


def result_source(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import streams
    from ..streaming import pipeline
    src = scratch_path(spark, "results-topic")
    _result_events(spark, sf).select("camera_id", "value").write.json(src)
    stream = streams.result_source(spark, "json", src, streaming=True)
    out = pipeline.drain_to_table(stream, scratch_path(spark, "results-read"))
    return out.select("camera_id", "timestamp", F.col("image").cast("string").alias("image"), "prediction")


def bad_results(spark: SparkSession, sf: str) -> DataFrame:
    """A4 with malformed events: the readable results and the quarantine of one stream."""
    from ..sources import streams
    from ..streaming import pipeline
    src = scratch_path(spark, "broken-results")
    TB.broken_results(_frames(spark, sf)).write.json(src, ignoreNullFields=False)
    good, bad = pipeline.drain_results(streams.result_records(spark, "json", src), scratch_path(spark, "results-split"))
    none = F.lit(None).cast("string")
    return good.select("camera_id", "timestamp", F.col("image").cast("string").alias("image"), "prediction", none.alias("reason")) \
        .unionByName(bad.select(*[none.alias(c) for c in ("camera_id", "timestamp", "image", "prediction")], "reason"))


def frame_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """A3: the frames packed as archives of stills, unpacked by a stream."""
    from ..sources import stills
    from ..streaming import pipeline
    folder = scratch_path(spark, "stills")
    stills.write_archives(_frames(spark, sf).select("camera_id", "frame_id", "ts", F.col("props").cast("binary").alias("content")), folder)
    out = pipeline.drain_to_table(stills.packed_stills(spark, folder), scratch_path(spark, "stills-out"))
    parsed = out.withColumn("_ev", codec.parse_frame_event("value"))
    return parsed.select(F.col("_ev.camera_id").alias("camera_id"), F.col("frame_id"),
                         codec.decode_image("_ev.image").cast("string").alias("image"))


# --- B: parsing -------------------------------------------------------------

def _broken_topic(spark, sf):
    """The broken messages as a stored topic (written once per session)."""
    path = TB.derived_path(spark, sf, "events", "broken-topic",
                           lambda p: TB.broken_messages(_frames(spark, sf)).write.parquet(p))
    return spark.read.parquet(path)


def parse_frames(spark, sf):
    m = TB.messages(_frames(spark, sf)).withColumn("_ev", codec.parse_frame_event("value"))
    return m.select("offset", F.col("_ev.camera_id").alias("camera_id"),
                    F.col("_ev.timestamp").alias("timestamp"), F.col("_ev.image").alias("image"))


def parse_event_time(spark, sf):
    m = _broken_topic(spark, sf).withColumn("_ev", codec.parse_frame_event("value"))
    return m.select("offset", F.col("_ev.timestamp").alias("timestamp"),
                    codec.ts_text(codec.parse_event_time("_ev.timestamp")).alias("event_ts"))


def image_decode(spark, sf):
    m = _broken_topic(spark, sf).withColumn("_ev", codec.parse_frame_event("value"))
    return m.select("offset", codec.decode_image("_ev.image").cast("string").alias("image"))


def image_encode(spark, sf):
    return _frames(spark, sf).select("frame_id", codec.encode_image(F.col("props").cast("binary")).alias("image"))


def result_envelope(spark, sf):
    r = _result_events(spark, sf)
    ev = F.from_json("value", codec.RESULT_EVENT_SCHEMA)
    return r.select("frame_id", ev["timestamp"].alias("timestamp"), ev["camera_id"].alias("camera_id"),
                    codec.decode_image(ev["image"]).cast("string").alias("image"),
                    ev["prediction"].alias("prediction"),
                    F.col("value").contains('"prediction":').alias("has_prediction_key"))


def bad_records(spark, sf):
    _, bad = filters.split_bad_records(_broken_topic(spark, sf))
    return bad.select("offset", "reason")


# --- C: filters -------------------------------------------------------------

def freshness_filter(spark, sf):
    a = TB.aged(_frames(spark, sf))
    return filters.freshness_filter(a, "ts", now=F.col("now_ts")).select("frame_id", "camera_id", "age_us")


def freshness_filter_wrap(spark, sf):
    a = TB.aged(_frames(spark, sf))
    return filters.freshness_filter(a, "ts", now=F.col("now_ts"), day_wrapped=True) \
        .select("frame_id", "camera_id", "age_us")


def _detections(spark, sf):
    return TB.detections(_frames(spark, sf))


def confidence_filter(spark, sf):
    d = filters.confidence_filter(_detections(spark, sf), _DEFAULT.thresholds())
    return d.select("frame_id", "pos", "detector", "label", "confidence")


def _lists(spark, sf):
    """Frames with a non-empty prediction list: the list is in the row, so
    what is asked of one frame needs no shuffle; it is put together once."""
    return filters.nonempty_filter(held(_frames(spark, sf).select("frame_id", "k"), detections=stub_prediction_list("k")))


def watchlist_flag(spark, sf):
    return _lists(spark, sf).select(
        "frame_id", on_watchlist_list("detections", C.SUSPICIOUS_OBJECTS).alias("suspicious"),
        on_watchlist_list("detections", C.SUSPICIOUS_OBJECTS, exact=True).alias("suspicious_exact"))


def watchlist_events(spark, sf):
    """C5 over D3's output: the named best classes that are on the events
    watchlist. Class i is named by the i-th of ``EVENT_CLASSES``, in turn."""
    e = TB.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double"))
                                                 .alias("scores"))
    names = F.array(*[F.lit(x) for x in TB.EVENT_CLASSES])
    top = select.event_topk(e, "scores", C.EVENT_TOP_COUNT).withColumn(
        "label", F.element_at(names, (F.col("class_idx") % len(TB.EVENT_CLASSES) + 1).cast("int")))
    watch = spark.createDataFrame([(w,) for w in C.SUSPICIOUS_EVENTS], "label string")
    return filters.watchlist_events(top, watch).select("vec_id", "rank", "class_idx", "label")


def nonempty_filter(spark, sf):
    f = held(_frames(spark, sf).select("frame_id", "k"),
             detections=keep_confident(stub_prediction_list("k"), _DEFAULT.thresholds()))
    return filters.nonempty_filter(f).select("frame_id", F.size("detections").alias("n"))


# --- D, E: newest per camera, top-k, thresholds, sampling -----------------

def latest_per_camera(spark, sf):
    f = _frames(spark, sf).withColumn("batch_day", F.date_format("ts", "yyyy-MM-dd"))
    r = select.latest_per_key(f.select("batch_day", "camera_id", "ts", "frame_id"),
                              ["batch_day", "camera_id"], ["ts", "frame_id"])
    return r.select("batch_day", "camera_id", "frame_id", codec.ts_text("ts").alias("ts"))


def latest_per_camera_window(spark, sf):
    f = _frames(spark, sf).select("camera_id", "ts", "frame_id")
    r = select.latest_per_window(f, "camera_id", "ts", "1 day", order=["frame_id"])
    return r.select(codec.ts_text("window_start").alias("window_start"), "camera_id", "frame_id")


def event_topk(spark, sf):
    e = TB.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double"))
                                                 .alias("scores"))
    top = select.event_topk(e, "scores", C.EVENT_TOP_COUNT)
    # class index -> event name (A7); only ids below the class count can
    # match, so the dimension is bounded by the model's classes.
    n_classes = e.agg(F.max(F.size("scores"))).scalar()
    names = event_label_map(spark, sf).where(F.col("label_id") < n_classes)
    return combine.label_lookup(top, names, "class_idx", label_col="name") \
        .select("vec_id", "rank", "class_idx", "score", "name")


def activity_threshold(spark, sf):
    d = _detections(spark, sf)
    return d.select("frame_id", "pos", select.activity_label(F.col("confidence"), 0.5).alias("activity"))


def _fseq(spark, sf, *cols):
    return TB.frames_seq(spark, sf, cols)


def sample_every_n(spark, sf):
    return select.sample_every_n(_fseq(spark, sf), C.OBJECT_SAMPLE_RATE).select("camera_id", "frame_id", "seq")


def sampling_schedule(spark, sf):
    s = select.sampling_schedule(_fseq(spark, sf), list(_DEFAULT.detectors))
    return s.select("camera_id", "frame_id", "seq", "detector")


def sampling_cycle(spark, sf):
    return select.sampling_cycle(_fseq(spark, sf), "camera_id", list(_DEFAULT.detectors))


def _rate_changes(spark, sf):
    """Changes of the detectors' settings at the first frame, a third and two
    thirds of the frames' time range later."""
    b = _frames(spark, sf).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    at = lambda n: F.timestamp_add("MICROSECOND", F.expr(f"timestampdiff(MICROSECOND, lo, hi) * {n} div 3"), F.col("lo"))
    changes = [("object", 5, True, 0), ("firearm", 5, True, 0), ("feature", 15, True, 0),
               ("object", 3, True, 1), ("feature", 15, False, 1), ("firearm", 2, True, 2), ("feature", 4, True, 2)]
    rows = F.array(*[F.struct(F.lit(d).alias("detector"), F.lit(r).alias("rate"), F.lit(e).alias("enabled"),
                              at(n).alias("valid_from")) for d, r, e, n in changes])
    return b.select(F.inline(rows))


def rate_changes(spark, sf):
    """E2, F7 over time: the schedule under rates and toggles that change."""
    f = _frames(spark, sf).select("camera_id", "frame_id", "ts")
    s = select.schedule_over_time(f, _rate_changes(spark, sf), "camera_id", ["ts", "frame_id"])
    return s.select("camera_id", "frame_id", F.col("epoch").cast("int").alias("epoch"), "seq", "detector")


def rate_intervals(spark, sf):
    """E3 over time: per interval its length in frames, the detectors that are
    on with their rates, and the cycle after which their schedule repeats."""
    iv = select.rate_intervals(_rate_changes(spark, sf))
    n = select.in_interval(_frames(spark, sf).select("ts"), iv, "ts").groupBy("epoch").agg(F.count(F.lit(1)).alias("n_frames"))
    on = F.array_join(F.transform(F.array_sort(F.map_entries("rates")), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"))), ", ")
    return iv.join(n, "epoch").select(F.col("epoch").cast("int").alias("epoch"), codec.ts_text("valid_from").alias("valid_from"),
                                      on.alias("rates"), F.col("cycle").cast("int").alias("cycle"), "n_frames")


# --- F: unions, lookups, as-of, state ---------------------------------------

def union_detections(spark, sf):
    both = union_of_lists([of_detector("detections", "object"), of_detector("detections", "firearm")])
    return (_lists(spark, sf).select("frame_id", F.posexplode(both).alias("union_pos", "d"))
            .select("frame_id", "d.detector", "d.pos", "union_pos"))


def label_lookup(spark, sf):
    labels = label_dim(spark, sf)
    f = _frames(spark, sf).select("frame_id", F.col("k").cast("bigint").alias("k"))
    return combine.label_lookup(f, labels, "k").select("frame_id", "k", "label")


def label_palette(spark, sf):
    return combine.label_palette(label_dim(spark, sf)).select("label_id", "label", "blue", "red", "green")


def color_lookup(spark, sf):
    colours = combine.colour_table(combine.label_palette(label_dim(spark, sf)))
    d = _detections(spark, sf).select("frame_id", "pos", "label")
    return combine.color_lookup(d, colours).select("frame_id", "pos", "label", "blue", "red", "green")


def asof_prediction(spark, sf):
    f = _frames(spark, sf)
    frames_v = f.select("camera_id", "ts", "frame_id")
    preds = f.where(F.col("event_type") == "signup").select("camera_id", "ts", "frame_id", "value")
    r = combine.asof_prediction(frames_v, preds, "camera_id", "ts", "frame_id", ["value"])
    return r.select("frame_id", "camera_id", "pred_frame_id", "pred_value")


def prediction_state(spark, sf):
    """The standing prediction of the four detectors: whole lists, empty ones
    included, of the frames on which each is due."""
    k, lst = F.col("k"), stub_prediction_list("k")
    one = lambda label, conf: F.array(F.struct(label.alias("label"), conf.alias("confidence")))
    share = k / F.lit(100.0)
    narrow = lambda c: F.transform(c, lambda d: F.struct(d["label"].alias("label"), d["confidence"].alias("confidence")))
    lists = {"object": (C.OBJECT_SAMPLE_RATE, narrow(of_detector(lst, "object"))),
             "firearm": (C.FIREARM_SAMPLE_RATE, narrow(of_detector(lst, "firearm"))),
             "event": (C.FEATURE_SAMPLE_RATE, F.when(k % 4 == 0, F.array().cast("array<struct<label:string,confidence:double>>"))
                       .otherwise(one(F.col("event_type"), share))),
             "activity": (C.FEATURE_SAMPLE_RATE, one(select.activity_label(share, 0.5), share))}
    per = F.array(*[F.struct(F.lit(n).alias("detector"), F.lit(r).alias("rate"), c.alias("list")) for n, (r, c) in lists.items()])
    due = (_fseq(spark, sf, "k", "event_type").select("camera_id", "ts", "frame_id", "seq", F.inline(per))
           .where(F.col("seq") % F.col("rate") == 0))
    r = combine.prediction_state(due, ["camera_id", "detector"], ["ts", "frame_id"], ["list"])
    text = F.array_join(F.transform("list", lambda d: F.concat(d["label"], F.lit(" "), d["confidence"].cast("string"))), "; ")
    return r.select("camera_id", "detector", "frame_id", F.size("list").alias("n_boxes"), text.alias("boxes"))


def detector_toggle(spark, sf):
    cfg = C.PipelineConfig(detectors=(
        C.Detector("object", C.OBJECT_SAMPLE_RATE, C.OBJECT_THRESHOLD),
        C.Detector("firearm", C.FIREARM_SAMPLE_RATE, C.FIREARM_THRESHOLD, enabled=False),
        C.Detector("feature", C.FEATURE_SAMPLE_RATE, None, True, ("event", "activity"))),
        activity_enabled=True)
    return select.detector_toggle(_fseq(spark, sf), cfg).select("camera_id", "frame_id", "detector")


# --- G: aggregation -----------------------------------------------------------

def label_counts(spark, sf):
    return _lists(spark, sf).select("frame_id", F.inline(counts_of_list("detections")))


def summary_text(spark, sf):
    return _lists(spark, sf).select("frame_id", summary_of_list("detections").alias("summary"))


def batch_metrics(spark, sf):
    f = _frames(spark, sf).withColumn("batch_day", F.date_format("ts", "yyyy-MM-dd"))
    return summarize.batch_metrics(f, "batch_day")


# --- H: ordered -----------------------------------------------------------------

def rolling_features(spark, sf):
    r = ordered.rolling_features(TB.features_seq(spark, sf))
    return r.select("camera_id", "seq", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
                    .alias("ids"))


def carry_forward_text(spark, sf):
    f = _fseq(spark, sf, "event_type").withColumn(
        "text", F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")))
    return ordered.carry_forward_text(f).select("frame_id", "shown_text")


def latest_feature(spark, sf):
    # Newest by vec_id, the order of a camera's vectors: no numbering needed.
    r = ordered.latest_feature(TB.features(spark, sf), seq_col="vec_id")
    vsum = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return r.select("camera_id", "vec_id", F.round(vsum, 6).alias("vec_sum"))


def micro_batch_trigger(spark, sf):
    from ..streaming import pipeline
    return pipeline.replay_latest_per_day(spark, _frames(spark, sf))


def late_data(spark, sf):
    from ..streaming import pipeline
    return pipeline.replay_with_late_rows(spark, _frames(spark, sf))


def late_rows(spark, sf):
    """H5 kept: the rows that are late for their day's window."""
    from ..streaming import pipeline
    late = pipeline.split_late_halves(spark, _frames(spark, sf)).late()
    return late.select(F.col("offset").alias("frame_id"), F.col("camera_id").cast("bigint").alias("camera_id"),
                       F.unix_micros("event_ts").alias("event_us"))


def label_counts_stream(spark, sf):
    from ..streaming import pipeline
    r = pipeline.replay_counts(spark, _frames(spark, sf))
    return r.select(F.unix_micros("window_start").alias("window_start_us"), F.col("camera_id").cast("bigint").alias("camera_id"),
                    "label", "n")


def sampling_cycle_stream(spark, sf):
    from ..streaming import pipeline
    r = pipeline.replay_cycles(spark, _frames(spark, sf), _DEFAULT.detectors)
    return r.select(F.unix_micros("window_start").alias("window_start_us"), F.col("camera_id").cast("bigint").alias("camera_id"),
                    "n_frames", "n_object", "n_firearm", "n_feature")


# --- I: annotation --------------------------------------------------------------

def box_overlays(spark, sf):
    colours = combine.colour_table(combine.label_palette(label_dim(spark, sf)))
    d = _detections(spark, sf).withColumn("height", F.lit(TB.FRAME_HEIGHT))
    o = overlay.box_overlays(d, colours)
    return o.select("frame_id", "pos", "x1", "y1", "x2", "y2", "caption", "caption_x", "caption_y",
                    "font_scale", "blue", "red", "green")


def annotated_results(spark, sf):
    r = annotate.annotated_results(_frames(spark, sf))
    return r.select("camera_id", "frame_id", "seq", "timestamp", "pred_frame_id", F.size("boxes").alias("n_boxes"),
                    overlay.boxes_text(F.col("boxes")).alias("boxes"), "prediction")


def _delays(k):
    return {"object": F.make_dt_interval(hours=k % 7 * 9), "firearm": F.make_dt_interval(hours=k % 5 * 17)}


def annotated_delayed(spark, sf):
    """I2 where a prediction takes 0 to 6 times 9 (objects) or 0 to 4 times
    17 hours (firearms), so later ones may complete first."""
    r = annotate.annotated_delayed(_frames(spark, sf), _delays(F.col("k")))
    return r.select("camera_id", "frame_id", "seq", "timestamp", "object_frame_id", "firearm_frame_id",
                    F.size("boxes").alias("n_boxes"), overlay.boxes_text(F.col("boxes")).alias("boxes"), "prediction")


def annotated_stream(spark, sf):
    """I2 as a stream: one day of frames per micro-batch, the clock of a frame
    set so that a known part is stale (C1), newest per camera (D1), state,
    scorers, envelope and sink, read back from the sink."""
    from ..streaming import annotation
    return annotation.replay_days(spark, _frames(spark, sf))


def annotated_images(spark, sf):
    """I2 in batch with C1, D1, the scorers on due frames and the images: the
    same rows as ``annotated_stream``."""
    f = TB.aged(_frames(spark, sf)).withColumn("image", F.col("props").cast("binary"))
    r = annotate.annotated_images(f, annotate.stub_detectors(), now="now_ts", batch=F.date_format("ts", "yyyy-MM-dd"))
    return r.select(F.col("camera_id").cast("string").alias("camera_id"), "timestamp", "prediction", F.size("boxes").alias("n_boxes"),
                    overlay.boxes_text(F.col("boxes")).alias("boxes"), F.col("image").cast("string").alias("image"))


def stream_events(spark, sf):
    """H1, J3 and J4 on the stream: per frame the best event classes of the
    camera's newest feature vector and the activity of its last four, both
    standing until the next, read back from the sink."""
    from ..streaming import annotation
    return annotation.replay_days(spark, _frames(spark, sf), events=True)


def stream_delayed(spark, sf):
    """I2 as a stream where predictions take the times of
    ``annotated_delayed`` and wait in the camera's state until a frame is
    shown after their completion, read back from the sink."""
    from ..streaming import annotation
    k = F.get_json_object(F.col("image").cast("string"), "$.k").cast("int")
    return annotation.replay_days(spark, _frames(spark, sf), delays=_delays(k))


# --- J: scoring -----------------------------------------------------------------

def _decoded_messages(spark, sf):
    m = TB.messages(_frames(spark, sf)).withColumn("_ev", codec.parse_frame_event("value"))
    return m.select("offset", codec.decode_image("_ev.image").alias("image"))


def score_detections(spark, sf):
    d = scoring.score_detections(_decoded_messages(spark, sf), scoring.StubDetector(TB.DETECTION_LABELS),
                                 keep=["offset"])
    return d.select("offset", "pos", "label", "confidence", "x1", "y1", "x2", "y2")


def score_features(spark, sf):
    udf = scoring.feature_udf(scoring.StubFeatureExtractor(8))
    v = _decoded_messages(spark, sf).select("offset", udf("image").alias("vec"))
    return v.select("offset", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("v_sum"),
                    F.round(F.col("vec")[0], 6).alias("v0"))


def score_events(spark, sf):
    w = scoring.formula_event_weights(64, 8, 5)
    e = TB.table(spark, sf, "embeddings").select("vec_id", "embedding")
    r = scoring.score_events(e, "embedding", w)
    return r.select("vec_id", "rank", "class_idx", F.round("score", 6).alias("score"))


def score_activity(spark, sf):
    w = scoring.formula_activity_weights(64, 20)
    r = ordered.rolling_features(TB.features_seq(spark, sf))
    a = scoring.score_activity(r, "vectors", w, 0.5)
    return a.select("camera_id", "seq", F.round("activity_score", 6).alias("activity_score"), "activity")


def score_frames_sampled(spark, sf):
    return annotate.score_frames_sampled(spark, _frames(spark, sf))


QUERIES = {name: globals()[name] for name in [
    "frame_source", "result_sink", "frame_ingest", "result_source", "bad_results", "label_dim", "model_registry",
    "event_label_map",
    "parse_frames", "parse_event_time", "image_decode", "image_encode", "result_envelope", "bad_records",
    "freshness_filter", "freshness_filter_wrap", "confidence_filter", "watchlist_flag", "watchlist_events",
    "nonempty_filter",
    "latest_per_camera", "latest_per_camera_window", "event_topk", "activity_threshold",
    "sample_every_n", "sampling_schedule", "sampling_cycle", "rate_changes", "rate_intervals",
    "union_detections", "label_lookup", "label_palette", "color_lookup", "asof_prediction",
    "prediction_state", "detector_toggle",
    "label_counts", "summary_text", "batch_metrics",
    "rolling_features", "carry_forward_text", "latest_feature", "micro_batch_trigger", "late_data",
    "late_rows", "label_counts_stream", "sampling_cycle_stream",
    "box_overlays", "annotated_results", "annotated_stream", "stream_events", "stream_delayed",
    "annotated_images", "annotated_delayed",
    "score_detections", "score_features", "score_events", "score_activity", "score_frames_sampled",
]}
