"""The annotation pipeline as a stream (I2, stream form; H4).

One query; every micro-batch goes through ``foreachBatch``:

1. parse (B1-B3); malformed messages go to the quarantine (B6); stale frames
   are dropped by a plain filter (C1), before anything is shuffled;
2. newest frame per camera (D1): a map-side combined ``max_by`` over narrow
   columns;
3. the kept frames' keys meet the cameras' state (sampling counter, latest
   predictions, text) - narrow rows too - and are broadcast to the frames, so
   the image of a kept frame stays in the task that read it;
4. due frames are scored (E1/E2, J1, C3); latest prediction of each detector
   (F6), boxes of all, objects first (F1, I1), summary text kept over empty
   predictions (G2, H2): expressions over the row;
5. result envelopes (B5) to the sink (A2), and the new state, narrow again.

State is a table in the checkpoint folder: a base and one folder of changes per
micro-batch id, with that batch's cameras only. A batch that is repeated after
a failure reads the state before it and replaces its own output and changes, so
file sinks hold each result once; Kafka is at-least-once. State is dropped by processing time only
(``idle_timeout``), which loses no frame, however late.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import config as C
from ..functions import codec
from ..functions.lists import summary_of_list
from ..operators import scoring
from ..operators.filters import freshness_filter
from ..operators.overlay import overlay_list
from ..operators.select import activity_label, in_interval, latest_per_key, rate_intervals, top_k_classes
from ..sources import streams
from ..sources import tables as TB
from .pipeline import run_batches
from .progress import ProgressTable
from .state import duration_ms

_LIST = scoring.BOX_LIST
_LATEST = T.StructType([T.StructField("src", T.LongType()), T.StructField("list", _LIST)])
# A prediction that takes time, ordered by its completion, then its frame.
_TIMED = T.StructType([T.StructField("done", T.TimestampNTZType()), T.StructField("at", T.TimestampNTZType()), *_LATEST.fields])
_RING = T.ArrayType(T.StructType([T.StructField("src", T.LongType()), T.StructField("vec", scoring.VECTOR)]))
_EVENTS = T.StructType([T.StructField("src", T.LongType()), T.StructField("classes", T.ArrayType(T.StructType([
    T.StructField("class_idx", T.IntegerType()), T.StructField("score", T.DoubleType())])))])
_ACTIVITY = T.StructType([T.StructField("src", T.LongType()), T.StructField("score", T.DoubleType()),
                          T.StructField("activity", T.StringType())])


@dataclass(frozen=True)
class FeatureModels:
    """J2 and what is scored from its vectors: events (J3) and activity (J4);
    weights as in ``operators.scoring``."""
    extractor: object
    event_weights: tuple | None = None
    activity_weights: tuple | None = None
    length: int = C.ACTIVITY_SEQUENCE_LENGTH
    threshold: float = C.ACTIVITY_THRESHOLD


def annotate_batch(frames: DataFrame, state: Callable[[DataFrame, bool, list[int]], DataFrame | None] | None, scorers: dict,
                   config: C.PipelineConfig = C.DEFAULT_CONFIG, freshness: bool = True, now: str | None = None,
                   colours=None, height: int = TB.FRAME_HEIGHT, held: list[DataFrame] | None = None,
                   models: FeatureModels | None = None, rates: DataFrame | None = None,
                   stats: dict | None = None, delays: dict[str, Column] | None = None) -> DataFrame:
    """One micro-batch: a row per camera that has a frame to show, with
    camera_id, offset, seq, timestamp, image, boxes, prediction, and the
    camera's new state (``latest_<detector>``). ``state(ids, few, buckets)``
    gives the state rows of the cameras in ``ids`` (``CameraState.rows``), or
    is None.
    ``now`` names a column with the clock to judge freshness by (default: the
    batch's clock). Tables kept in memory are added to ``held``, to be
    released after the batch; ``stats`` gets the number of frames kept.

    With ``models`` and a feature detector that is on, a due frame's vector
    goes into the camera's ring of the last ``models.length`` ones (H1, H3);
    ``events`` are the best classes of the newest vector (J3, D3), ``activity``
    is scored once the ring is full (J4, D4); both stand until the next.

    With ``rates`` (``select.rate_intervals``) the detectors, their rates and
    whether they are on are those of the interval of the frame's time, not
    those of ``config``; the camera's counter starts again with an interval.

    ``delays`` gives detectors the time from a due frame to its prediction, an
    interval column over the frame (null is no time), as in
    ``plans.annotate.annotate_completed``: a frame shows the prediction that
    completed last at or before its time. Predictions under way wait in the
    camera's state (``waiting_<detector>``): as many as are due within one delay.
    One that was shown stands until one that completed later, also where a
    camera's time steps back."""
    delays = {n: d for n, d in (delays or {}).items() if n in scorers}
    on = {d.name: d for d in config.active_detectors()}
    feature = models is not None and (rates is not None or "feature" in on)
    thresholds = config.thresholds()
    names = [n for n in scorers if rates is not None or n in on]
    x = frames.select(F.col("camera_id").cast("string").alias("camera_id"), "event_ts", "timestamp", "image",
                      "partition", "offset", *([F.col(now).alias("now")] if now else []))
    if freshness:
        x = freshness_filter(x, now="now" if now else None, limit_s=config.freshness_seconds)
    # Narrow rows, at most one per camera, held once: counted, then broadcast
    # while few, so that no image is shuffled.
    first = latest_per_key(x.select("camera_id", "event_ts", "partition", "offset"), ["camera_id"],
                           ["event_ts", "partition", "offset"]).persist()
    if held is not None:
        held.append(first)
    n_kept, buckets = first.agg(F.count(F.lit(1)), F.collect_set(CameraState.bucket("camera_id"))).first()
    few = n_kept <= C.BROADCAST_CAMERAS
    if stats is not None:
        stats["n_kept"] = n_kept
    kept = in_interval(first, rates, "event_ts").drop("event_ts", "cycle") if rates is not None else \
        first.drop("event_ts").withColumn("epoch", F.lit(None).cast("int"))
    before = {f.name: f.dataType for f in state_schema(scorers, models, delays) if f.name not in ("camera_id", "seen_ms")}
    old = state(first.select("camera_id"), few, buckets) if state is not None else None
    kept = kept.withColumnRenamed("camera_id", "cam")
    if delays and few and old is not None:  # lists of any length: they are counted, too
        old = old.persist()
        if held is not None:
            held.append(old)
        lengths = [F.greatest(F.size(f"waiting_{n}"), F.lit(0)) for n in delays]
        few = (old.agg(F.sum(reduce(Column.__add__, lengths, F.lit(0)))).first()[0] or 0) <= C.BROADCAST_CAMERAS
    if old is None:
        kept = kept.withColumns({f"old_{k}": F.lit(None).cast(t) for k, t in before.items()})
    else:
        old = old.select(F.col("camera_id").alias("_cam"), *[F.col(k).alias(f"old_{k}") for k in before])
        kept = kept.join(old, kept["cam"].eqNullSafe(old["_cam"]), "left").drop("_cam")
    side = F.broadcast(kept) if few else kept
    match = [x["camera_id"].eqNullSafe(side["cam"]), x["partition"].eqNullSafe(side["partition"]), x["offset"] == side["offset"]]
    seq = F.when(F.col("old_epoch").eqNullSafe(F.col("epoch")), F.coalesce("old_seq", F.lit(-1)) + 1).otherwise(F.lit(0))
    y = x.join(side, match).select(x["camera_id"], x["offset"], "timestamp", "image", seq.cast("bigint").alias("seq"), "epoch",
                                   *([x["event_ts"].cast("timestamp_ntz").alias("at")] if delays else []), *(["rates"] if rates is not None else []), *[f"old_{k}" for k in before if k not in ("seq", "epoch")])

    def due(name: str) -> Column:
        rate = F.element_at("rates", name) if rates is not None else F.lit(on[name].rate)
        return F.coalesce(F.col("seq") % rate == 0, F.lit(False))

    flags = {f"due_{n}": due(n) for n in [*names, *(["feature"] if feature else [])]}
    y = scoring.score_due(y.withColumns(flags), {n: scorers[n] for n in names}, thresholds,
                          models.extractor if feature else None)
    empty, lists = F.array().cast(_LIST), []
    for n in names:
        new = F.struct(F.col("offset").alias("src"), F.col(f"found_{n}").alias("list"))
        if n in delays:
            y = _complete(y, n, delays[n])
        else:
            y = y.withColumn(f"latest_{n}", F.when(F.col(f"found_{n}").isNotNull(), new).otherwise(F.col(f"old_latest_{n}")))
        shown = F.coalesce(F.col(f"latest_{n}.list"), empty)
        lists.append(F.when(F.map_contains_key("rates", n), shown).otherwise(empty) if rates is not None else shown)
    off = [n for n in scorers if n not in names]
    for n in off:  # what is under way still completes, for when the detector is on again
        y = _complete(y.withColumn(f"found_{n}", F.lit(None).cast(_LIST)), n, delays[n]) if n in delays else \
            y.withColumn(f"latest_{n}", F.col(f"old_latest_{n}"))
    y = y.withColumn("shown", F.concat(empty, *lists))
    extra = []
    if models is not None:
        y = _score_features(y, models) if feature else y.withColumns({k: F.col(f"old_{k}") for k in ("ring", "events", "activity")})
        extra = ["ring", "events", "activity"]
    text = F.when(F.size("shown") > 0, summary_of_list("shown")).otherwise(F.coalesce("old_prediction", F.lit("")))
    return y.select("camera_id", "offset", "seq", "epoch", "timestamp", "image",
                    overlay_list(F.col("shown"), TB.stub_colours() if colours is None else colours, height).alias("boxes"),
                    text.alias("prediction"), *[f"latest_{n}" for n in scorers], *[f"waiting_{n}" for n in delays], *extra)


def _complete(y: DataFrame, n: str, delay: Column) -> DataFrame:
    """F5 on a camera's row at time ``at``: the standing prediction of detector
    ``n`` and those still under way, from what waited and the frame's own."""
    none = F.array().cast(T.ArrayType(_TIMED))
    own = F.struct((F.col("at") + F.coalesce(delay, F.expr("INTERVAL '0' SECOND"))).alias("done"), "at",
                   F.col("offset").alias("src"), F.col(f"found_{n}").alias("list"))
    own = F.when(F.col(f"found_{n}").isNotNull(), F.array(own)).otherwise(none)
    y = y.withColumn("_under_way", F.concat(F.coalesce(f"old_waiting_{n}", none), own))
    done = F.filter("_under_way", lambda p: p["done"] <= F.col("at"))
    return y.withColumns({
        f"latest_{n}": F.array_max(F.concat(F.array_compact(F.array(f"old_latest_{n}")), done)),
        f"waiting_{n}": F.filter("_under_way", lambda p: p["done"] > F.col("at"))}).drop("_under_way")


def _score_features(y: DataFrame, models: FeatureModels) -> DataFrame:
    """H1, J3 and J4 on the rows that have a new vector; the others keep
    their camera's ring and results."""
    spark, new, n = y.sparkSession, F.col("vec").isNotNull(), models.length
    # One generated row: the ring is put together once for its three uses.
    grown = F.concat(F.coalesce("old_ring", F.array().cast(_RING)), F.array(F.struct(F.col("offset").alias("src"), "vec")))
    ring = F.when(new, F.slice(grown, F.greatest(F.lit(1), F.size(grown) - (n - 1)), n)).otherwise(F.col("old_ring"))
    y = y.withColumn("ring", ring)
    events, activity = F.lit(None).cast(_EVENTS), F.lit(None).cast(_ACTIVITY)
    if models.event_weights is not None:
        y = y.withColumn("_scores", scoring.event_scores_udf(spark, models.event_weights)("vec"))
        events = F.when(new, F.struct(F.col("offset").alias("src"), top_k_classes(F.col("_scores")).alias("classes")))
    if models.activity_weights is not None:
        full = F.when(new & (F.size("ring") == n), F.transform("ring", lambda r: r["vec"]))
        y = y.withColumn("_window", full)
        y = y.withColumn("_act", scoring.activity_udf(spark, models.activity_weights)("_window"))
        activity = F.when(F.col("_act").isNotNull(), F.struct(F.col("offset").alias("src"), F.col("_act").alias("score"),
                                                              activity_label(F.col("_act"), models.threshold).alias("activity")))
    return y.withColumns({"events": F.coalesce(events, "old_events"), "activity": F.coalesce(activity, "old_activity")})


def state_schema(scorers: dict, models: FeatureModels | None, delays=()) -> T.StructType:
    """The columns of a camera's state; ``delays`` names detectors that take time."""
    kinds = {"camera_id": T.StringType(), "seq": T.LongType(), "epoch": T.IntegerType(), "prediction": T.StringType(),
             **{f"latest_{n}": _TIMED if n in delays else _LATEST for n in scorers},
             **{f"waiting_{n}": T.ArrayType(_TIMED) for n in scorers if n in delays}}
    if models is not None:
        kinds |= {"ring": _RING, "events": _EVENTS, "activity": _ACTIVITY}
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()] + [T.StructField("seen_ms", T.LongType())])


def state_rows(results: DataFrame, seen_ms: int) -> DataFrame:
    """The state of the cameras of a batch: narrow columns of its results."""
    keep = [c for c in results.columns if c in ("prediction", "epoch", "ring", "events", "activity") or c.startswith(("latest_", "waiting_"))]
    return results.select("camera_id", "seq", *keep, F.lit(seen_ms).cast("bigint").alias("seen_ms"))


def result_events(results: DataFrame) -> DataFrame:
    """B5 over annotated rows: (camera_id, value) ready for the sink."""
    return results.select("camera_id", codec.result_envelope(
        F.col("timestamp"), F.col("camera_id"), codec.encode_image(F.col("image")),
        F.col("prediction")).alias("value"))


class CameraState:
    """The cameras' state as Parquet under ``root``: a base with all cameras,
    in folders by a hash of the camera, and one folder of changes per
    micro-batch with the rows of its cameras only. What a batch writes follows
    the cameras it had; every ``COMPACT`` batches base and changes become a
    new base. A camera's newest row counts. A repeated batch replaces its own
    changes and reads what was before it: older parts are deleted only when a
    newer base than the one it needs is complete."""

    COMPACT, BUCKETS = 16, 16

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        """``schema`` are the columns of a row with ``camera_id`` and
        ``seen_ms``; what an older part lacks is NULL."""
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        path = self._path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        # Listed once: from here on the parts are those that this query writes.
        self.parts = {part: self._list(part) for part in ("base", "changes")}

    def _list(self, part: str) -> set[int]:
        """Batch ids of the complete folders of ``base`` or ``changes``."""
        path = self._path(f"{self.root}/{part}")
        if not self.fs.exists(path):
            return set()
        names = [s.getPath() for s in self.fs.listStatus(path)]
        return {int(n.getName()[6:]) for n in names
                if n.getName().startswith("batch=") and self.fs.exists(self._path(n, "_SUCCESS"))}

    def _before(self, batch_id: int) -> tuple[int | None, list[int]]:
        """The newest base before a batch, and the changes after it."""
        base = max([i for i in self.parts["base"] if i < batch_id], default=None)
        return base, sorted(i for i in self.parts["changes"] if i < batch_id and (base is None or i > base))

    def _all(self, base: int | None, changes: list[int], buckets: list[int] | None) -> DataFrame | None:
        parts = []
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        for part, ids in (("base", [base] if base is not None else []), ("changes", changes)):
            if ids:
                df = (self.spark.read.schema(schema).option("basePath", f"{self.root}/{part}")
                      .parquet(*[f"{self.root}/{part}/batch={i}" for i in ids])).select(schema.names)
                parts.append(df.where(F.col("bucket").isin(buckets)) if buckets is not None else df)
        return reduce(DataFrame.unionByName, parts) if parts else None

    def rows(self, batch_id: int, ids: DataFrame, few: bool, buckets: list[int], oldest_ms: int | None = None) -> DataFrame | None:
        """The newest rows before a batch of the cameras in ``ids``, which are
        in ``buckets``, if seen since ``oldest_ms``. Folders of the base
        without such a camera are not read."""
        df = self._all(*self._before(batch_id), buckets)
        if df is None:
            return None
        ids = ids.select(F.col("camera_id").alias("_asked"))
        df = df.join(F.broadcast(ids) if few else ids, df["camera_id"].eqNullSafe(F.col("_asked")), "left_semi")
        df = latest_per_key(df.drop("bucket"), ["camera_id"], ["batch"]).drop("batch")
        return df if oldest_ms is None else df.where(F.col("seen_ms") >= oldest_ms)

    def write(self, batch_id: int, rows: DataFrame, oldest_ms: int | None = None) -> None:
        """Store the rows of a batch's cameras; from time to time a new base,
        without the cameras not seen since ``oldest_ms``."""
        rows.withColumn("bucket", self.bucket("camera_id")).write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch_id}")
        self.parts["changes"].add(batch_id)
        base, changes = self._before(batch_id + 1)
        if len(changes) < self.COMPACT:
            return
        df = latest_per_key(self._all(base, changes, None), ["camera_id"], ["batch"]).drop("batch")
        df = df if oldest_ms is None else df.where(F.col("seen_ms") >= oldest_ms)
        df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/base/batch={batch_id}")
        self.parts["base"].add(batch_id)
        # This batch may be repeated and then reads from the base before it.
        if base is not None:
            for i in [i for i in self.parts["base"] if i < base]:
                self._delete("base", i)
            for i in [i for i in self.parts["changes"] if i <= base]:
                self._delete("changes", i)

    def _delete(self, part: str, i: int) -> None:
        self.fs.delete(self._path(f"{self.root}/{part}/batch={i}"), True)
        self.parts[part].discard(i)

    @classmethod
    def bucket(cls, col: str) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(cls.BUCKETS)).cast("int").alias("bucket")


def annotate_stream(records: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, scorers: dict,
                    config: C.PipelineConfig | Callable[[], C.PipelineConfig] = C.DEFAULT_CONFIG,
                    freshness: bool = True, now: Callable[[DataFrame], DataFrame] | None = None,
                    idle_timeout: str | int | None = None, quarantine: str | None = None,
                    available_now: bool = True, state_root: str | None = None, first_batch: int = 0,
                    models: FeatureModels | None = None, rates: DataFrame | None = None,
                    progress: ProgressTable | None = None, delays: dict[str, Column] | None = None) -> StreamingQuery:
    """Start the stream over raw ``records`` (partition, offset, value).
    ``write(results, batch_id)`` stores the annotated rows. ``config`` may be
    a function, asked anew for every micro-batch, so rates and toggles can
    change while the query runs (E2, F7). ``now`` may add a column ``now``.
    ``models`` adds events and activity, ``rates`` are changes of the
    detectors' settings valid from a time (``select.rate_intervals``),
    ``progress`` a table of the batches (G3), ``delays`` the time that
    detectors take (``annotate_batch``).
    A query with another checkpoint continues an earlier one's cameras when
    it is given its ``state_root`` and the number after its last batch."""
    store = CameraState(records.sparkSession, state_root or f"{checkpoint}/camera-state", state_schema(scorers, models, delays or ()))
    idle_ms = duration_ms(idle_timeout) if idle_timeout is not None else None
    intervals = rate_intervals(rates) if rates is not None else None

    def handle(batch: DataFrame, batch_id: int) -> None:
        seen_ms, number, stats = int(time.time() * 1000), first_batch + batch_id, {}
        oldest = None if idle_ms is None else seen_ms - idle_ms
        read = Observation()  # of the first scan of the batch; later ones read it again
        frames, bad = streams.parse_records(batch.observe(read, F.count(F.lit(1)).alias("n")))
        if quarantine:
            bad.write.mode("overwrite").json(f"{quarantine}/batch={number}")
        frames = now(frames) if now else frames
        held: list[DataFrame] = []
        r = annotate_batch(frames, lambda *asked: store.rows(number, *asked, oldest), scorers,
                           config() if callable(config) else config, freshness, "now" if now else None, held=held,
                           models=models, rates=intervals, stats=stats, delays=delays).persist()
        try:
            write(r, number)
            store.write(number, state_rows(r, seen_ms), oldest)
        finally:
            for t in [r, *held]:
                t.unpersist()
        if progress is not None:
            progress.batch_done(batch_id, read.get["n"], stats["n_kept"])

    return run_batches(records, handle, checkpoint, available_now)


def run_annotation(spark: SparkSession, source_path: str | None, sink_path: str | None, checkpoint: str, scorers: dict,
                   config=C.DEFAULT_CONFIG, freshness: bool = True, available_now: bool = True,
                   max_files_per_trigger: int | None = None, quarantine_path: str | None = None, idle_timeout=None,
                   source_format: str = "json", source_options: dict | None = None,
                   sink_format: str = "json", sink_options: dict | None = None, models: FeatureModels | None = None,
                   rates: DataFrame | None = None, progress: ProgressTable | None = None,
                   delays: dict[str, Column] | None = None) -> StreamingQuery:
    """One command from frame records to result events (A1 -> I2 -> B5 -> A2),
    files or Kafka at either end: with ``"kafka"`` the options name the
    brokers and topic (``streams.kafka_options``). A file sink holds one
    folder per micro-batch. Malformed messages go to ``quarantine_path``."""
    recs = streams.frame_records(spark, source_format, source_path, source_options, streaming=True,
                                 max_files_per_trigger=max_files_per_trigger)

    def write(results: DataFrame, batch_id: int) -> None:
        out = result_events(results)
        if sink_format == "kafka":
            options = {"topic": C.RESULT_TOPIC, **(sink_options or {})}
            out.select(F.col("camera_id").alias("key"), "value").write.format("kafka").options(**options).save()
        else:
            out.write.mode("overwrite").format(sink_format).save(f"{sink_path}/batch={batch_id}")

    return annotate_stream(recs, write, checkpoint, scorers, config, freshness, None, idle_timeout,
                           quarantine_path, available_now, models=models, rates=rates, progress=progress, delays=delays)


def stub_scorers() -> dict:
    """The stand-in object and firearm detectors."""
    from ..plans.annotate import stub_detectors
    return stub_detectors()


def stub_models(size: int = 8) -> FeatureModels:
    """The stand-in extractor with formula weights for events and activity."""
    return FeatureModels(scoring.StubFeatureExtractor(size), scoring.formula_event_weights(size, 8, 5),
                         scoring.formula_activity_weights(size, 20))


def replay_days(spark: SparkSession, frames: DataFrame, events: bool = False,
                delays: dict[str, Column] | None = None) -> DataFrame:
    """The frames replayed with one micro-batch per day; a frame is judged by
    its own clock (``tables.aged``). The sink's rows, with the boxes as text;
    with ``events`` instead camera_id, frame_id, the frame of the standing
    event result, its classes and the activity, as every camera's feature
    detector runs on every second frame. With ``delays``, which may use ``k``,
    camera_id, frame_id, seq, the frame of each detector's standing prediction,
    the boxes and the text."""
    from ..operators.overlay import boxes_text
    from ..session import scratch_path
    root = scratch_path(spark, "annotated-stream")
    day = F.date_format("ts", "yyyy-MM-dd")
    (TB.messages(TB.aged(frames).withColumn("_day", day), keep=["_day"]).select("partition", "offset", "value", "_day")
     .write.partitionBy("_day").json(f"{root}/in"))
    days = sorted(r["_day"] for r in spark.read.json(f"{root}/in").select("_day").distinct().collect())
    out = f"{root}/out"
    config = C.PipelineConfig(event_enabled=True, activity_enabled=True, detectors=(
        C.Detector("feature", EVENT_REPLAY_RATE, None, True, ("event", "activity")),)) if events else C.DEFAULT_CONFIG

    def write(results: DataFrame, batch_id: int) -> None:
        if events:
            classes = F.transform("events.classes", lambda c: c["class_idx"].cast("string"))
            rows = results.select("camera_id", F.col("offset").alias("frame_id"), F.col("events.src").alias("event_frame_id"),
                                  F.array_join(classes, ",").alias("events"), F.col("activity.activity").alias("activity"))
        elif delays is not None:
            rows = results.select("camera_id", F.col("offset").alias("frame_id"), "seq",
                                  *[F.col(f"latest_{n}.src").alias(f"{n}_frame_id") for n in stub_scorers()],
                                  F.size("boxes").alias("n_boxes"), boxes_text(F.col("boxes")).alias("boxes"), "prediction")
        else:
            ev = F.from_json(codec.result_envelope(F.col("timestamp"), F.col("camera_id"), codec.encode_image(F.col("image")),
                                                   F.col("prediction")), codec.RESULT_EVENT_SCHEMA)
            rows = (results.select(ev.alias("e"), F.size("boxes").alias("n_boxes"), boxes_text(F.col("boxes")).alias("boxes"))
                    .select("e.camera_id", "e.timestamp", "e.prediction", "n_boxes", "boxes",
                            codec.decode_image(F.col("e.image")).cast("string").alias("image")))
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def clock(f: DataFrame) -> DataFrame:
        k = F.get_json_object(F.col("image").cast("string"), "$.k").cast("int")
        a = TB.aged(f.select("*", F.col("offset").alias("frame_id"), k.alias("k"), F.col("event_ts").alias("ts")))
        return a.withColumnRenamed("now_ts", "now")

    # One run per day, in day order: file listings of one run have no order
    # by name. Each run continues the state of the one before.
    for n, d in enumerate(days):
        recs = streams.frame_records(spark, "json", f"{root}/in/_day={d}", streaming=True)
        annotate_stream(recs, write, f"{root}/ckpt-{n}", {} if events else stub_scorers(), config, now=clock,
                        state_root=f"{root}/state", first_batch=n, models=stub_models() if events else None,
                        delays=delays).awaitTermination()
    return spark.read.parquet(out).drop("batch")


#: Rate of the feature detector in ``replay_days`` with events.
EVENT_REPLAY_RATE = 2
