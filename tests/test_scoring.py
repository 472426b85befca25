"""Scorers against a plain numpy pass written here, and the stub detector
against the detection view."""

import numpy as np
from pyspark.sql import functions as F

from sightline.operators import ordered, scoring
from sightline.sources import tables as TB

from .conftest import SF_SMALL


def _sig(x):
    return 1 / (1 + np.exp(-x))


def test_event_scores_numpy(spark):
    w1, b1, w2, b2 = scoring.formula_event_weights(64, 8, 5)
    e = TB.table(spark, SF_SMALL, "embeddings").orderBy("vec_id").limit(50)
    got = scoring.score_events(e.select("vec_id", "embedding"), "embedding", (w1, b1, w2, b2), k=5)
    rows = e.collect()
    for r in rows[:20]:
        x = np.array(r.embedding, dtype=np.float64)
        y = _sig(_sig(x @ w1 + b1) @ w2 + b2)
        best = list(np.argsort(-y, kind="stable"))
        mine = [t.class_idx for t in got.where(F.col("vec_id") == r.vec_id).orderBy("rank").collect()]
        assert mine == best


def test_activity_numpy(spark):
    w = scoring.formula_activity_weights(64, 20)
    kernel, recurrent, bias, dense, dense_b = w
    win = ordered.rolling_features(TB.features_seq(spark, SF_SMALL))
    got = scoring.score_activity(win, "vectors", w, 0.5).limit(10).collect()
    for r in got:
        h = np.zeros(20)
        c = np.zeros(20)
        for v in r.vectors:
            z = np.array(v, dtype=np.float64) @ kernel + h @ recurrent + bias
            hs = lambda q: np.clip(0.2 * q + 0.5, 0, 1)
            i, f, o = hs(z[:20]), hs(z[20:40]), hs(z[60:])
            c = f * c + i * np.tanh(z[40:60])
            h = o * np.tanh(c)
        assert abs(_sig(h @ dense + dense_b) - r.activity_score) < 1e-12


def test_stub_detector_matches_view(spark):
    f = TB.frames(spark, SF_SMALL)
    dets = scoring.score_detections(f.withColumn("image", F.col("props").cast("binary")),
                                    scoring.StubDetector(TB.DETECTION_LABELS), keep=["frame_id"])
    view = TB.detections(f).select("frame_id", "pos", "label", "confidence", "x1", "y1", "x2", "y2")
    a = sorted(tuple(r) for r in dets.collect())
    b = sorted(tuple(r) for r in view.collect())
    assert a == b


class _CountedScorer:
    """Sums the image sizes with a weight matrix; counts its loads."""

    def __init__(self, weights, path):
        self.weights, self.path, self.other = weights, path, object

    def load(self):
        with open(self.path, "a") as f:
            f.write("x")
        return self

    def predict(self, images):
        return np.array([[self.weights[1000, 400]] for _ in images])


def test_scorers_that_differ_in_one_weight_do_not_share_a_model(spark, tmp_path):
    a = np.zeros((2048, 800))
    b = a.copy()
    b[1000, 400] = 1.0
    df = spark.createDataFrame([(bytes([i]),) for i in range(8)], "image binary").repartition(4)
    files = [str(tmp_path / n) for n in "ab"]
    for w, path, want in ((a, files[0], 0.0), (b, files[1], 1.0)):
        udf = scoring.feature_udf(_CountedScorer(w, path))
        for _ in range(2):  # the second plan of the same function loads nothing in workers that have it
            assert {r.v[0] for r in df.select(udf("image").alias("v")).collect()} == {want}


def test_loaded_scorers_are_loaded_once_and_bounded():
    import pickle

    from pyspark import cloudpickle
    scoring._LOADED.clear()

    class Plain:
        loads = 0

        def __init__(self):
            self.thing = object()

        def load(self):
            Plain.loads += 1
            return self

    s = scoring.Scorer(Plain())
    for copy in (s, *(pickle.loads(cloudpickle.dumps(scoring.Scorer(s.scorer))) for _ in range(3))):
        assert copy.identity == s.identity
        copy.loaded()
    assert Plain.loads == 1
    for _ in range(20):
        scoring.Scorer(Plain()).loaded()
    assert len(scoring._LOADED) == scoring.LOADED_SCORERS


def test_feature_softmax(spark):
    class Two:
        def load(self):
            return self

        def predict(self, images):
            return np.array([[1.0, 3.0]] * len(images))

    df = spark.createDataFrame([(b"x",)], "image binary")
    v = df.select(scoring.feature_udf(Two(), softmax=True)("image").alias("v")).first().v
    assert abs(sum(v) - 1) < 1e-12 and abs(v[1] / v[0] - np.exp(2)) < 1e-9
