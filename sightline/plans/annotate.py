"""The annotation pipeline (I2) and the sampled scoring chain (J5), batch form.

I2, per frame of every camera:
  sample (E2) -> detect (J1 output: one list per detector) -> confidence (C3)
  -> latest completed prediction per detector (F5/F6, carried forward)
  -> boxes of both detectors, objects first (F1) -> captions (I1)
  -> summary text, kept over empty predictions (G2, H2).
The frame image never enters a shuffle: ordered work runs on narrow columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import codec
from ..functions.lists import keep_confident, of_detector, stub_prediction_list, summary_of_list
from ..operators import ordered, scoring, select
from ..operators.fetch import FILE, ROW, fetch, located
from ..operators.filters import freshness_filter
from ..operators.overlay import overlay_list
from ..operators.select import latest_per_key
from ..operators.sequence import carry_last, keyed_sequence
from ..sources import tables as TB


def due_lists(names: list[str], rates: dict[str, int], lists: dict, seq, src, thresholds: dict) -> dict:
    """Per detector: STRUCT<src, list> on frames where it is due, else NULL."""
    return {n: F.when(seq % rates[n] == 0, F.struct(src.alias("src"), keep_confident(lists[n], thresholds).alias("list")))
            for n in names}


def annotate_frames(f: DataFrame, predictions: dict[str, F.Column], config: C.PipelineConfig,
                    colours=None, height: int = TB.FRAME_HEIGHT, chunk_rows: int | None = None, keep=()) -> DataFrame:
    """Core of I2 over frames that already carry ``seq``. ``predictions``
    maps detector name to the list column that detector returns for a
    frame; it is evaluated only on frames where the detector is due. With
    all detectors off every frame has no boxes and an empty text."""
    kw = {"chunk_rows": chunk_rows} if chunk_rows else {}
    colours = TB.stub_colours() if colours is None else colours
    rates = {d.name: d.rate for d in config.active_detectors()}
    names = [n for n in predictions if n in rates]
    out = ["camera_id", "frame_id", "seq", codec.iso_timestamp("ts").alias("timestamp"), *keep]
    if not names:
        none = F.array().cast(f.select(overlay_list(stub_prediction_list(F.lit(0)), colours, height).alias("b")).schema["b"].dataType)
        return f.select(*out, F.lit(None).cast("bigint").alias("pred_frame_id"), none.alias("boxes"),
                        F.lit("").alias("prediction"))
    due = due_lists(names, rates, predictions, F.col("seq"), F.col("frame_id"), config.thresholds())
    x = f.withColumns({f"_p_{n}": c for n, c in due.items()})
    carried, latest = [f"_p_{n}" for n in names], [f"_l_{n}" for n in names]
    if len({rates[n] for n in names}) == 1:
        # Every detector is due on the same frames, so at a due frame the
        # combined list is the frame's own: the text candidate is row-local
        # and one scan carries predictions and text together.
        own = F.concat(*[F.col(f"{c}.list") for c in carried])
        x = x.withColumn("_cand", F.when(F.size(own) > 0, summary_of_list(own)))
        x = carry_last(x, ["camera_id"], "seq", carried + ["_cand"], latest + ["_text"], **kw)
        x = x.withColumn("prediction", F.coalesce("_text", F.lit("")))
        x = x.withColumn("_boxes", _joined(latest))
    else:
        # Latest completed prediction of each detector (an empty list
        # counts); then the text, which needs the other detectors' latest
        # lists, in a second scan over the same chunks.
        x = carry_last(x, ["camera_id"], "seq", carried, latest, keep_chunk=True, **kw)
        x = x.withColumn("_boxes", _joined(latest)).withColumn(
            "_text", F.coalesce(F.when(F.size("_boxes") > 0, summary_of_list(F.col("_boxes"))), F.lit("")))
        x = ordered.carry_forward_text(x, "camera_id", "seq", "_text", "prediction", **kw)
    return x.select(*out, F.col(f"{latest[0]}.src").alias("pred_frame_id"),
                    overlay_list(F.col("_boxes"), colours, height).alias("boxes"), "prediction")


def _joined(latest: list[str]):
    """F1 of the detectors' latest lists; a detector not yet run has none."""
    return F.concat(*[F.coalesce(F.col(f"{c}.list"), F.array()) for c in latest])


def annotated_results(frames: DataFrame, config: C.PipelineConfig = C.DEFAULT_CONFIG,
                      chunk_rows: int | None = None) -> DataFrame:
    """I2 over the stand-in frames: the stand-in detector gives each frame
    a list, split by detector."""
    f = keyed_sequence(frames.select("camera_id", "frame_id", "ts", "k"), ["camera_id"], ["ts", "frame_id"])
    lst = stub_prediction_list(F.col("k"))
    return annotate_frames(f, {n: of_detector(lst, n) for n in ("object", "firearm")}, config, chunk_rows=chunk_rows)


def annotate_completed(f: DataFrame, predictions: dict[str, Column], delays: dict[str, Column],
                       config: C.PipelineConfig = C.DEFAULT_CONFIG, colours=None, height: int = TB.FRAME_HEIGHT,
                       chunk_rows: int | None = None) -> DataFrame:
    """I2 when scoring takes time, over frames that carry ``seq`` and ``ts``:
    a frame shows, of each detector, the prediction that was the last to complete at
    or before the frame's time (F5), which may be one of an older frame.
    ``delays`` gives each detector's time from a due frame to its prediction
    as an interval column; none of a detector or a null one is no time. Of
    predictions that complete together the newer frame's counts, and a
    prediction may overtake an older one, as with several workers.

    Frames and completed predictions of a camera are one sequence by time,
    numbered and carried in chunks, so no task holds a camera."""
    kw = {"chunk_rows": chunk_rows} if chunk_rows else {}
    colours = TB.stub_colours() if colours is None else colours
    rates = {d.name: d.rate for d in config.active_detectors()}
    names = [n for n in predictions if n in rates]
    out = ["camera_id", "frame_id", "seq", codec.iso_timestamp("ts").alias("timestamp")]
    if not names:
        bare = annotate_frames(f, {}, config, colours, height, chunk_rows)
        return bare.drop("pred_frame_id").select("*", *[F.lit(None).cast("bigint").alias(f"{n}_frame_id") for n in predictions])
    due = due_lists(names, rates, predictions, F.col("seq"), F.col("frame_id"), config.thresholds())
    no_time = F.expr("INTERVAL '0' SECOND")
    x = f.select("camera_id", "frame_id", "seq", "ts", *[c.alias(f"_p_{n}") for n, c in due.items()],
                 *[(F.col("ts") + F.coalesce(delays.get(n, no_time), no_time)).alias(f"_d_{n}") for n in names])

    def step(order, at, name=None):  # a frame (order last), or the completion of one prediction of it
        return F.struct(F.lit(order).alias("_order"), at.alias("_at"), *[
            (F.col(f"_p_{n}") if n == name else F.lit(None).cast(x.schema[f"_p_{n}"].dataType)).alias(f"_q_{n}") for n in names])

    done = [F.when(F.col(f"_p_{n}").isNotNull(), step(i, F.col(f"_d_{n}"), n)) for i, n in enumerate(names)]
    steps = F.array_compact(F.array(*done, step(len(names), F.col("ts"))))
    y = x.select("camera_id", "frame_id", "seq", "ts", F.inline(steps))
    # A prediction that completes at a frame's time is seen by that frame.
    y = y.withColumn("_side", (F.col("_order") == len(names)).cast("int"))
    y = keyed_sequence(y, ["camera_id"], ["_at", "_side", "seq", "_order"], "_step")
    latest = [f"_l_{n}" for n in names]
    z = carry_last(y, ["camera_id"], "_step", [f"_q_{n}" for n in names], latest, keep_chunk=True, **kw)
    is_frame = F.col("_side") == 1
    z = z.withColumn("_boxes", F.when(is_frame, _joined(latest)))
    z = z.withColumn("_text", F.when(F.size("_boxes") > 0, summary_of_list(F.col("_boxes"))))
    z = ordered.carry_forward_text(z, "camera_id", "_step", "_text", "prediction", **kw).where(is_frame)
    return z.select(*out, *[(F.col(f"_l_{n}.src") if n in names else F.lit(None).cast("bigint")).alias(f"{n}_frame_id")
                            for n in predictions],
                    overlay_list(F.col("_boxes"), colours, height).alias("boxes"), "prediction")


def annotated_delayed(frames: DataFrame, delays: dict[str, Column], config: C.PipelineConfig = C.DEFAULT_CONFIG,
                      chunk_rows: int | None = None) -> DataFrame:
    """``annotate_completed`` over the stand-in frames; ``delays`` may use ``k``."""
    f = keyed_sequence(frames.select("camera_id", "frame_id", "ts", "k"), ["camera_id"], ["ts", "frame_id"])
    lst = stub_prediction_list(F.col("k"))
    return annotate_completed(f, {n: of_detector(lst, n) for n in ("object", "firearm")}, delays, config, chunk_rows=chunk_rows)


def stub_detectors() -> dict:
    """The stand-in object and firearm detectors."""
    return {"object": scoring.StubDetector(TB.DETECTION_LABELS, exclude=(TB.FIREARM_LABEL,)),
            "firearm": scoring.StubDetector(TB.DETECTION_LABELS, only=(TB.FIREARM_LABEL,))}


def annotated_images(frames: DataFrame, scorers: dict, config: C.PipelineConfig = C.DEFAULT_CONFIG,
                     now: str | None = None, batch: Column | None = None, fetch_rows: int | None = None,
                     chunk_rows: int | None = None) -> DataFrame:
    """I2 in batch with all its steps, over a scan of frame files
    (camera_id, frame_id, ts, image): fresh frames by the clock column ``now``
    (C1), the newest of a camera in each ``batch`` (D1), the scorers on due
    frames only (E2, J1, C3), and each frame's image in the result.

    Ordered work runs on keys; images are fetched twice, once to score the
    due frames and once for the result, and never shuffled."""
    rates = {d.name: d.rate for d in config.active_detectors() if d.name in scorers}
    keys = located(frames)
    if now:
        keys = freshness_filter(keys, "ts", now=F.col(now), limit_s=config.freshness_seconds)
    kept = keys.select("camera_id", "frame_id", "ts", FILE, ROW, *([batch.alias("_batch")] if batch is not None else []))
    if batch is not None:
        kept = latest_per_key(kept, ["_batch", "camera_id"], ["ts", "frame_id"]).drop("_batch")
    fseq = keyed_sequence(kept, ["camera_id"], ["ts", "frame_id"])
    source = frames.select("image", F.col("_metadata"))
    if not rates:
        done = annotate_frames(fseq, {}, config, chunk_rows=chunk_rows, keep=[FILE, ROW])
        return fetch(done, source, ["image"], fetch_rows)
    due = fseq.where(reduce(lambda a, b: a | b, [F.col("seq") % r == 0 for r in set(rates.values())]))
    shown = fetch(due.select(F.col("frame_id").alias("_id"), "seq", FILE, ROW), source, ["image"], fetch_rows)
    flags = {f"due_{n}": F.col("seq") % r == 0 for n, r in rates.items()}
    found = scoring.score_due(shown.withColumns(flags).drop("seq"), {n: scorers[n] for n in rates}, {}, keep_image=False)
    x = fseq.join(found.checkpoint(), F.col("frame_id") == F.col("_id"), "left").drop("_id")  # narrow on both sides
    of = lambda n: lambda d: d.withField("detector", F.lit(n))
    lists = {n: F.transform(f"found_{n}", of(n)) for n in rates}
    done = annotate_frames(x, lists, config, chunk_rows=chunk_rows, keep=[FILE, ROW])
    return fetch(done, source, ["image"], fetch_rows)


def score_frames_sampled(spark: SparkSession, frames: DataFrame, config: C.PipelineConfig | None = None,
                         feature_size: int = 8, fetch_rows: int | None = None) -> DataFrame:
    """Schedule (E2) -> object/firearm detection (J1) and features
    -> rolling windows of features (H1) -> event classes (J3) and activity
    (J4). One row per (frame, detector) with a text result.

    ``frames`` is a file scan. Only keys and the place of each frame in the
    files are numbered, shuffled and checkpointed; the images of due frames
    are fetched late, scored where they are read, and end there."""
    cfg = config or C.PipelineConfig(event_enabled=True, activity_enabled=True)
    keys = located(frames).select("camera_id", "frame_id", "ts", FILE, ROW)
    rates = {d.name: d.rate for d in cfg.active_detectors()}
    fseq = keyed_sequence(keys, ["camera_id"], ["ts", "frame_id"])
    due = fseq.where(reduce(lambda a, b: a | b, [F.col("seq") % r == 0 for r in set(rates.values())]))
    shown = fetch(due.drop("ts"), frames.select("*", F.col("props").cast("binary").alias("image")), ["image"], fetch_rows)
    scorers = {n: x for n, x in stub_detectors().items() if n in rates}
    flagged = shown.withColumns({f"due_{n}": F.col("seq") % r == 0 for n, r in rates.items()})
    scored = scoring.score_due(flagged, scorers, {}, scoring.StubFeatureExtractor(feature_size) if "feature" in rates else None,
                               keep_image=False).checkpoint()  # narrow: lists of boxes and vectors
    out = [scored.where(F.size(f"found_{n}") > 0).select(
        "camera_id", "frame_id", F.lit(n).alias("detector"),
        F.array_join(F.transform(f"found_{n}", lambda d: d["label"]), ",").alias("result")) for n in scorers]
    if "feature" in rates:
        feat = scored.where(F.col("vec").isNotNull()).select(
            "camera_id", "frame_id", (F.col("seq") / rates["feature"]).cast("bigint").alias("fseq"), "vec")
        if cfg.event_enabled:
            out.append(_event_rows(feat, feature_size))
        if cfg.activity_enabled:
            out.append(_activity_rows(feat, feature_size))
    return reduce(DataFrame.unionByName, out)


def _event_rows(feat: DataFrame, size: int) -> DataFrame:
    ev = scoring.event_scores_udf(feat.sparkSession, scoring.formula_event_weights(size, 8, 5))
    best = select.top_k_classes(F.col("_s"))
    return (feat.withColumn("_s", ev("vec"))
            .select("camera_id", "frame_id", F.lit("event").alias("detector"),
                    F.array_join(F.transform(best, lambda t: t["class_idx"].cast("string")), ",").alias("result")))


def _activity_rows(feat: DataFrame, size: int) -> DataFrame:
    win = ordered.rolling_features(feat.withColumnRenamed("frame_id", "vec_id"), "camera_id", "fseq", "vec", "vec_id")
    act = scoring.score_activity(win, "vectors", scoring.formula_activity_weights(size, 20))
    return act.select("camera_id", F.element_at("ids", -1).alias("frame_id"),
                      F.lit("activity").alias("detector"), F.col("activity").alias("result"))
