"""Hand-made cases for selection, combination, text and overlays."""

import datetime as dt
import math

from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions.lists import summary_of_list
from sightline.operators import combine, ordered, overlay, select, summarize
from sightline.operators.sequence import keyed_sequence

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def test_latest_per_key_ties(spark):
    rows = [("a", T0, 0, 5, "x"), ("a", T0, 1, 2, "y"), ("a", T0 - dt.timedelta(seconds=1), 3, 9, "old"),
            ("b", T0, 0, 1, "b1")]
    df = spark.createDataFrame(rows, "camera_id string, event_ts timestamp_ntz, partition int, offset long, v string")
    got = {r.camera_id: r.v for r in select.latest_per_key(df, ["camera_id"],
                                                            ["event_ts", "partition", "offset"]).collect()}
    assert got == {"a": "y", "b": "b1"}


def _frames(spark, n, cam="c"):
    rows = [(cam, i, T0 + dt.timedelta(seconds=i)) for i in range(n)]
    return spark.createDataFrame(rows, "camera_id string, frame_id long, ts timestamp_ntz")


def test_sample_every_n_counts(spark):
    for n_frames in (1, 5, 16):
        f = keyed_sequence(_frames(spark, n_frames), ["camera_id"], ["ts", "frame_id"])
        for rate in (1, 5):
            assert select.sample_every_n(f, rate).count() == math.ceil(n_frames / rate)
    try:
        select.sample_every_n(f, 0)
        raise AssertionError("rate 0 accepted")
    except ValueError:
        pass
    try:
        C.Detector("x", 0)
        raise AssertionError("rate 0 accepted")
    except ValueError:
        pass


def test_schedule_and_toggle(spark):
    f = keyed_sequence(_frames(spark, 16), ["camera_id"], ["ts", "frame_id"])
    s = select.sampling_schedule(f, list(C.DEFAULT_CONFIG.detectors))
    got = sorted((r.seq, r.detector) for r in s.collect())
    assert [x for x in got if x[1] == "feature"] == [(0, "feature"), (15, "feature")]
    assert len([x for x in got if x[1] == "object"]) == 4
    # feature extraction is off while neither event nor activity needs it
    t = select.detector_toggle(f, C.DEFAULT_CONFIG)
    assert {r.detector for r in t.collect()} == {"object", "firearm"}
    cyc = select.sampling_cycle(f, "camera_id", list(C.DEFAULT_CONFIG.detectors)).orderBy("cycle").collect()
    assert [(r.cycle, r.n_frames, r.n_object, r.n_feature) for r in cyc] == [(0, 15, 3, 1), (1, 1, 1, 1)]


def test_topk_ties_and_short(spark):
    df = spark.createDataFrame([(1, [0.5, 0.9, 0.5, 0.1]), (2, [0.3, 0.7])], "id int, s array<double>")
    got = [(r.id, r.rank, r.class_idx) for r in select.event_topk(df, "s", 3).orderBy("id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 0), (1, 3, 2), (2, 1, 1), (2, 2, 0)]


def test_activity_label(spark):
    df = spark.createDataFrame([(0.99,), (0.991,)], "s double")
    assert [r.a for r in df.select(select.activity_label(F.col("s")).alias("a")).collect()] == [
        C.NORMAL_ACTIVITY, C.ABNORMAL_ACTIVITY]


# Colours (blue, red, green) worked out by hand from the formula.
PALETTES = {
    1: {0: (254.0, 254.0, 254.0)},
    3: {0: (254.0, 254.0, 254.0), 2: (190.5, 127.0, 254.0)},
    5: {0: (254.0, 254.0, 254.0), 1: (222.25, 190.5, 127.0), 3: (158.75, 63.5, 127.0), 4: (127.0, 254.0, 254.0)},
    81: {24: (132.08, 355.6, 254.0), 80: (152.4, 127.0, 254.0)},
}


def test_palette_formula(spark):
    for n, some in PALETTES.items():
        labels = spark.range(n).select(F.col("id").alias("label_id"), F.col("id").cast("string").alias("label"))
        got = {r.label_id: (r.blue, r.red, r.green) for r in combine.label_palette(labels).collect()}
        for i, want in some.items():
            assert all(math.isclose(a, b) for a, b in zip(got[i], want)), (n, i)


def test_palette_of_several_models(spark):
    """80 object labels, then one firearm label: numbers go on, n is 81."""
    m = combine.palette_map([[f"o{k}" for k in range(80)], ["Pistol"]])
    r = spark.range(1).select(F.element_at(m, "Pistol").alias("p"), F.element_at(m, "o24").alias("o")).first()
    for got, want in ((r.p, PALETTES[81][80]), (r.o, PALETTES[81][24])):
        assert all(math.isclose(a, b) for a, b in zip(got, want))


def test_color_lookup_default_and_last(spark):
    labels = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "label_id long, label string")
    colours = combine.colour_table(combine.label_palette(labels))
    dets = spark.createDataFrame([("a",), ("zzz",)], "label string")
    got = {r.label: (r.blue, r.red, r.green) for r in combine.color_lookup(dets, colours).collect()}
    assert got == {"a": PALETTES[3][2], "zzz": C.DEFAULT_COLOUR}


def test_asof_cases(spark):
    frames = spark.createDataFrame([("c", T0, 10), ("c", T0 + dt.timedelta(seconds=2), 11),
                                    ("d", T0, 12)], "camera_id string, ts timestamp_ntz, frame_id long")
    preds = spark.createDataFrame([("c", T0, 1, 0.5), ("c", T0 + dt.timedelta(seconds=3), 2, 0.7),
                                   ("e", T0, 3, 0.9)], "camera_id string, ts timestamp_ntz, frame_id long, value double")
    for chunk in (None, 1):
        r = combine.asof_prediction(frames, preds, "camera_id", "ts", "frame_id", ["value"], chunk_rows=chunk)
        got = {x.frame_id: (x.pred_frame_id, x.pred_value) for x in r.collect()}
        # same-time prediction counts as earlier; a later one does not;
        # another camera's prediction is never used
        assert got == {10: (1, 0.5), 11: (1, 0.5), 12: (None, None)}


def test_union_order(spark):
    obj = spark.createDataFrame([(1, 0, "car"), (1, 1, "dog")], "frame_id long, pos int, label string")
    fire = spark.createDataFrame([(1, 0, "Pistol")], "frame_id long, pos int, label string")
    u = combine.union_detections([obj, fire], "frame_id").orderBy("union_pos").collect()
    assert [r.label for r in u] == ["car", "dog", "Pistol"]


def test_summary_text_order(spark):
    d = spark.createDataFrame([(1, 0, "dog"), (1, 1, "car"), (1, 2, "dog")], "frame_id long, pos int, label string")
    assert summarize.summary_text(d, "frame_id").first().summary == "dog (2)\ncar (1)\n"
    lst = spark.createDataFrame([(["dog", "car", "dog"],)], "l array<string>").select(
        F.transform("l", lambda x: F.struct(x.alias("label"))).alias("p"))
    assert lst.select(summary_of_list("p").alias("t")).first().t == "dog (2)\ncar (1)\n"


def test_carry_forward_text(spark):
    rows = [("c", 0, ""), ("c", 1, "a (1)\n"), ("c", 2, ""), ("c", 3, "b (1)\n"), ("c", 4, "")]
    df = spark.createDataFrame(rows, "camera_id string, seq long, text string")
    for chunk in (None, 2):
        got = [r.shown_text for r in ordered.carry_forward_text(df, chunk_rows=chunk).orderBy("seq").collect()]
        assert got == ["", "a (1)\n", "a (1)\n", "b (1)\n", "b (1)\n"]


def test_rolling_windows(spark):
    for n, expect in ((3, 0), (4, 1), (5, 2)):
        rows = [("c", i, i * 10, [float(i)]) for i in range(n)]
        df = spark.createDataFrame(rows, "camera_id string, seq long, vec_id long, vec array<double>")
        r = ordered.rolling_features(df).collect()
        assert len(r) == expect
        if expect:
            assert list(r[0].ids) == [0, 10, 20, 30]


def test_overlay_caption_and_default(spark):
    d = spark.createDataFrame([("cat", 0.5, 10, 5, 50, 35, 480)],
                              "label string, confidence double, x1 int, y1 int, x2 int, y2 int, height int")
    colours = spark.createDataFrame([("dog", 1.0, 2.0, 3.0)], "label string, blue double, red double, green double")
    r = overlay.box_overlays(d, colours).first()
    assert (r.caption, r.caption_x, r.caption_y, r.font_scale, r.line_width) == ("cat 0.5", 10, -8, 0.48, 1)
    assert (r.blue, r.red, r.green) == C.DEFAULT_COLOUR


def _annotated(df):
    return sorted((r.camera_id, r.frame_id, r.seq, r.pred_frame_id, tuple(r.boxes), r.prediction) for r in df.collect())


def test_annotation_with_equal_and_unequal_rates(spark):
    """Any chunk size gives the same rows, and they are those of a plain loop
    over the frames of a camera."""
    from sightline.plans import annotate
    from sightline.sources import tables as TB
    from .conftest import SF_SMALL
    f = TB.frames(spark, SF_SMALL)
    rows = f.select("camera_id", "frame_id", "ts", "k").collect()
    for rates in ((5, 5), (5, 3), (2, 7)):
        cfg = C.PipelineConfig(detectors=(C.Detector("object", rates[0], C.OBJECT_THRESHOLD),
                                          C.Detector("firearm", rates[1], C.FIREARM_THRESHOLD)))
        got = _annotated(annotate.annotated_results(f, cfg))
        assert got == _annotated(annotate.annotated_results(f, cfg, chunk_rows=4))
        want, state = {}, {}
        for r in sorted(rows, key=lambda r: (r.camera_id, r.ts, r.frame_id)):
            seq, latest, text = state.get(r.camera_id, (0, [None, None], ""))
            found = [(TB.DETECTION_LABELS[(r.k * (p + 1) + p) % 5], ((r.k * 7 + p * 31) % 100) / 100) for p in range(r.k % 4)]
            for d, rate in enumerate(rates):
                if seq % rate == 0:
                    limit = (C.OBJECT_THRESHOLD, C.FIREARM_THRESHOLD)[d]
                    latest[d] = (r.frame_id, [x for x in found if (x[0] == TB.FIREARM_LABEL) == bool(d) and x[1] > limit])
            boxes = [x for p in latest if p for x in p[1]]
            if boxes:
                text = "".join(f"{n} ({sum(b[0] == n for b in boxes)})\n" for n in dict.fromkeys(b[0] for b in boxes))
            want[r.frame_id] = (seq, latest[0][0], [b[0] for b in boxes], text)
            state[r.camera_id] = (seq + 1, latest, text)
        assert {g[1]: (g[2], g[3], [b.label for b in g[4]], g[5]) for g in got} == want


def test_annotation_with_all_detectors_off(spark):
    from sightline.plans import annotate
    from sightline.sources import tables as TB
    from .conftest import SF_SMALL
    f = TB.frames(spark, SF_SMALL)
    cfg = C.PipelineConfig(detectors=(C.Detector("object", 5, 0.25, enabled=False),))
    rows = annotate.annotated_results(f, cfg).collect()
    assert len(rows) == f.count() and all(r.boxes == [] and r.prediction == "" for r in rows)


def test_carry_of_a_null_camera_does_not_depend_on_chunks(spark):
    rows = [(None, 0, "t0"), (None, 1, None), (None, 2, None), (None, 3, None), ("c", 0, None), ("c", 1, "x")]
    df = spark.createDataFrame(rows, "camera_id string, seq long, text string")
    for chunk in (2, None):
        out = ordered.carry_forward_text(df, chunk_rows=chunk).collect()
        assert [r.shown_text for r in sorted(out, key=lambda r: (r.camera_id or "", r.seq))] == ["t0"] * 4 + ["", "x"]
    off = ordered.carry_forward_text(df, carry_forward=False).collect()
    assert [r.shown_text for r in off] == ["t0", "", "", "", "", "x"]


def test_hot_camera_vectors_use_many_tasks(spark):
    df = spark.range(400).select(F.lit("c").alias("camera_id"), F.col("id").alias("seq"), F.col("id").alias("vec_id"),
                                 F.array(F.col("id").cast("double")).alias("vec"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # these partitions are tiny and would be merged
    try:
        rows = ordered.rolling_features(df, chunk_rows=20).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(key, "true")
    assert len(rows) == 397 and len({r.task for r in rows}) > 1


def test_standing_prediction_is_replaced_by_an_empty_one(spark):
    rows = [("c", 1, 1, ["car"]), ("c", 2, 2, []), ("d", 1, 3, ["dog", "car"])]
    df = spark.createDataFrame(rows, "camera_id string, ts long, frame_id long, list array<string>")
    got = {r.camera_id: list(r.list) for r in combine.prediction_state(df, "camera_id", ["ts", "frame_id"], ["list"]).collect()}
    assert got == {"c": [], "d": ["dog", "car"]}


def test_newest_by_partition_and_offset(spark):
    rows = [("a", T0, 0, 9, "x"), ("a", T0 - dt.timedelta(days=1), 1, 2, "y")]
    df = spark.createDataFrame(rows, "camera_id string, event_ts timestamp_ntz, partition int, offset long, v string")
    assert select.latest_per_key(df, ["camera_id"], ["partition", "offset"]).first().v == "y"


def test_rewritten_table_has_another_version(spark, tmp_path):
    from sightline.sources.tables import file_versions
    df = spark.range(10).coalesce(1)
    df.write.parquet(f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t").inputFiles()
    before = file_versions(spark, files)
    name = files[0].removeprefix("file://")
    spark.range(20).toPandas().to_parquet(name)  # the same name, other content
    assert file_versions(spark, files) != before
