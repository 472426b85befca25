"""Model scoring as Spark jobs.

A scorer has ``load()`` and a vectorised ``predict`` over a pandas batch. It
is applied with ``mapInPandas`` or an iterator pandas UDF, so rows travel as
Arrow batches and the model is loaded once per Python worker, not per row.
Real model weights are not available; the scorers here are deterministic
stand-ins (J1, J2) and numpy forward passes with weights given by a formula
(J3, J4), so results can be checked against SQL and a separate numpy pass.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ACTIVITY_THRESHOLD, EVENT_TOP_COUNT
from .select import activity_label, top_k_classes

DETECTION_FIELDS = [("pos", "int"), ("label", "string"), ("confidence", "double"),
                    ("x1", "int"), ("y1", "int"), ("x2", "int"), ("y2", "int")]


def _k_from_image(images: pd.Series) -> np.ndarray:
    """The stand-in frames carry ``{"k": n}`` as image bytes."""
    if len(images) == 0:
        return np.empty(0, dtype=np.int64)
    text = images.map(bytes).str.decode("utf-8")
    return text.str.extract(r'"k"\s*:\s*(-?\d+)')[0].astype(np.int64).to_numpy()


class StubDetector:
    """Deterministic detector: ``k % 4`` boxes from the number ``k`` in the
    image bytes, with the labels, scores and boxes of FIXTURES.md.
    ``only``/``exclude`` keep a part of the labels, so two instances can
    stand for two detectors (objects, firearms)."""

    def __init__(self, labels: list[str], only: tuple[str, ...] | None = None,
                 exclude: tuple[str, ...] | None = None):
        self.labels = np.array(labels, dtype=object)
        self.only = tuple(only) if only else None
        self.exclude = tuple(exclude) if exclude else None

    def load(self):
        return self

    def predict(self, images: pd.Series) -> pd.DataFrame:
        k = _k_from_image(images)
        n = k % 4
        row = np.repeat(np.arange(len(k)), n)
        start = np.repeat(np.cumsum(n) - n, n)
        pos = np.arange(len(row)) - start
        kk = k[row]
        x1 = kk * 3 + pos * 7
        y1 = kk * 2 + pos * 5 - 10
        out = pd.DataFrame({
            "_row": row, "pos": pos.astype("int32"),
            "label": self.labels[(kk * (pos + 1) + pos) % len(self.labels)],
            "confidence": ((kk * 7 + pos * 31) % 100) / 100.0,
            "x1": x1.astype("int32"), "y1": y1.astype("int32"),
            "x2": (x1 + 40).astype("int32"), "y2": (y1 + 30).astype("int32")})
        if self.only:
            out = out[out["label"].isin(self.only)]
        if self.exclude:
            out = out[~out["label"].isin(self.exclude)]
        return out.reset_index(drop=True)


class StubFeatureExtractor:
    """Deterministic feature vector: ``sin(k * (d + 1)) / 2`` for d < dim."""

    def __init__(self, dim: int = 8):
        self.dim = dim

    def load(self):
        return self

    def predict(self, images: pd.Series) -> np.ndarray:
        k = _k_from_image(images).astype(np.float64)
        return np.sin(np.outer(k, np.arange(1, self.dim + 1))) / 2.0


#: Loaded scorers that a Python worker keeps.
LOADED_SCORERS = 8
_LOADED: OrderedDict[str, object] = OrderedDict()
_IDENTITIES: WeakKeyDictionary = WeakKeyDictionary()


class Scorer:
    """A scorer and its identity, given once on the driver. Copies that are
    unpickled in workers share it, so a worker loads the model once; two
    scorers never share it, whatever they hold."""

    def __init__(self, scorer):
        self.scorer = scorer
        try:
            self.identity = _IDENTITIES.setdefault(scorer, uuid.uuid4().hex)
        except TypeError:  # not hashable or not weakly referable
            self.identity = uuid.uuid4().hex

    def loaded(self):
        """The worker's loaded instance; the one used longest ago goes when
        too many are held."""
        if self.identity not in _LOADED:
            _LOADED[self.identity] = self.scorer.load()
            while len(_LOADED) > LOADED_SCORERS:
                _LOADED.popitem(last=False)
        _LOADED.move_to_end(self.identity)
        return _LOADED[self.identity]


def score_detections(df: DataFrame, scorer, image_col: str = "image", keep=()) -> DataFrame:
    """One row per detection, with the ``keep`` columns of its frame.
    Filters on frame columns should be applied before this call; they are
    not pushed below ``mapInPandas``."""
    keep, own = list(keep), Scorer(scorer)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
                       + [f"{n} {t}" for n, t in DETECTION_FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = own.loaded()
        for pdf in batches:
            d = model.predict(pdf[image_col])
            base = pdf[keep].iloc[d["_row"].to_numpy()].reset_index(drop=True)
            yield pd.concat([base, d.drop(columns="_row").reset_index(drop=True)], axis=1)

    return df.select(*keep, image_col).mapInPandas(run, schema)


#: A frame's detections as a list, in the scorer's order.
BOX = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("label", T.StringType()),
                    T.StructField("confidence", T.DoubleType()),
                    *[T.StructField(c, T.IntegerType()) for c in ("x1", "y1", "x2", "y2")]])
BOX_LIST = T.ArrayType(BOX)
VECTOR = T.ArrayType(T.DoubleType())


def score_due(frames: DataFrame, scorers: dict, thresholds: dict[str, float | None], features=None,
              image_col: str = "image", keep_image: bool = True) -> DataFrame:
    """J1, C3 and J2 over frames that carry a boolean ``due_<name>`` for each
    scorer: ``found_<name>``, the detections above the threshold in the
    scorer's order (NULL where it is not due), and ``vec`` of the ``features``
    extractor where ``due_feature``. A frame's image is read once for all of
    them, and a scorer sees the due frames of an Arrow batch in one call; with
    ``keep_image`` off the image ends here."""
    models = [(n, Scorer(s)) for n, s in scorers.items()]
    extractor = Scorer(features) if features is not None else None
    flags = [f"due_{n}" for n in scorers] + (["due_feature"] if extractor else [])
    gone = set(flags) | (set() if keep_image else {image_col})
    keep = [f for f in frames.schema.fields if f.name not in gone]
    schema = T.StructType([*keep, *[T.StructField(f"found_{n}", BOX_LIST) for n in scorers],
                           *([T.StructField("vec", VECTOR)] if extractor else [])])
    names, fields = [f.name for f in keep], BOX.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            out = pdf[names].copy()
            for n, model in models:
                found = pd.Series([None] * len(pdf), dtype=object)
                due = np.flatnonzero(pdf[f"due_{n}"].fillna(False).to_numpy(bool))
                if len(due):
                    dets = model.loaded().predict(pdf[image_col].iloc[due].reset_index(drop=True))
                    if thresholds.get(n) is not None:
                        dets = dets[dets["confidence"] > thresholds[n]]
                    dets = dets.sort_values(["_row", "pos"], kind="mergesort")
                    bounds = np.searchsorted(dets["_row"].to_numpy(), np.arange(len(due) + 1))
                    rows = dets[fields].to_dict("records")
                    for j, r in enumerate(due):
                        found.iat[r] = rows[bounds[j]:bounds[j + 1]]
                out[f"found_{n}"] = found
            if extractor:
                vec = pd.Series([None] * len(pdf), dtype=object)
                due = np.flatnonzero(pdf["due_feature"].fillna(False).to_numpy(bool))
                if len(due):
                    x = extractor.loaded().predict(pdf[image_col].iloc[due].reset_index(drop=True))
                    for r, v in zip(due, np.asarray(x, dtype=np.float64)):
                        vec.iat[r] = v
                out["vec"] = vec
            yield out

    return frames.mapInPandas(run, schema)


def feature_udf(scorer, softmax: bool = False):
    """Iterator pandas UDF from image bytes to ARRAY<DOUBLE>. With
    ``softmax`` the extractor's output row is turned into class shares."""
    own = Scorer(scorer)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = own.loaded()
        for images in it:
            x = np.asarray(model.predict(images), dtype=np.float64)
            if softmax and len(x):
                x = np.exp(x - x.max(axis=1, keepdims=True))
                x = x / x.sum(axis=1, keepdims=True)
            yield pd.Series(list(x))
    return features


# --- J3: dense network 2048 -> hidden (sigmoid) -> classes (sigmoid) -------

def formula_event_weights(n_in: int, n_hidden: int, n_out: int):
    """Weights by formula for checks: W1[i,h] = sin(7i+3h)/10,
    b1[h] = cos(h)/10, W2[h,c] = cos(5h+2c)/10, b2[c] = c/20."""
    i, h, c = np.arange(n_in)[:, None], np.arange(n_hidden), np.arange(n_out)
    w1 = np.sin(7 * i + 3 * h[None, :]) / 10.0
    b1 = np.cos(h) / 10.0
    w2 = np.cos(5 * h[:, None] + 2 * c[None, :]) / 10.0
    b2 = c / 20.0
    return w1, b1, w2, b2


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def event_scores_udf(spark, weights):
    """J3 as a pandas UDF: ARRAY<FLOAT|DOUBLE> -> ARRAY<DOUBLE> class scores.
    The weights are broadcast once; each Arrow batch is one matrix product.
    Dropout is inactive when predicting, so it does not appear."""
    bc = spark.sparkContext.broadcast(tuple(np.asarray(w, dtype=np.float64) for w in weights))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scores(vecs: pd.Series) -> pd.Series:
        w1, b1, w2, b2 = bc.value
        out = pd.Series([None] * len(vecs), dtype=object)
        at = np.flatnonzero(vecs.notna())  # a NULL vector has no scores
        if len(at):
            x = np.stack([np.asarray(v, dtype=np.float64) for v in vecs.iloc[at]])
            for i, y in zip(at, _sigmoid(_sigmoid(x @ w1 + b1) @ w2 + b2)):
                out.iat[i] = y
        return out
    return scores


def score_events(df: DataFrame, vec_col: str, weights, k: int = EVENT_TOP_COUNT) -> DataFrame:
    """J3 then D3: the k best event classes per vector, rank 1 best."""
    udf = event_scores_udf(df.sparkSession, weights)
    keep = [c for c in df.columns if c != vec_col]
    x = df.select(*keep, udf(F.col(vec_col)).alias("_scores"))
    return (x.select(*keep, F.posexplode(top_k_classes(F.col("_scores"), k)).alias("_r", "_t"))
            .select(*keep, (F.col("_r") + 1).alias("rank"), "_t.class_idx", "_t.score"))


# --- J4: LSTM(units) over a sequence of vectors -> Dense(1, sigmoid) --------

def hard_sigmoid(x):
    return np.clip(0.2 * x + 0.5, 0.0, 1.0)


def formula_activity_weights(n_in: int, units: int):
    """Kernel (n_in x 4u), recurrent (u x 4u), bias (4u), dense (u), dense
    bias, gate order i, f, c, o; entries by formula for checks."""
    a = np.arange(n_in)[:, None]
    g = np.arange(4 * units)[None, :]
    kernel = np.sin(3 * a + g) / 8.0
    r = np.arange(units)[:, None]
    recurrent = np.cos(2 * r + g) / 8.0
    bias = np.zeros(4 * units)
    bias[units:2 * units] = 1.0  # forget-gate bias of one
    dense = np.sin(np.arange(units) + 1.0) / 2.0
    return kernel, recurrent, bias, dense, 0.1


def lstm_forward(seqs: np.ndarray, weights, recurrent_activation=hard_sigmoid) -> np.ndarray:
    """Batch LSTM forward pass: seqs is (batch, steps, n_in); returns the
    sigmoid output (batch,)."""
    kernel, recurrent, bias, dense, dense_b = weights
    u = recurrent.shape[0]
    h = np.zeros((seqs.shape[0], u))
    c = np.zeros((seqs.shape[0], u))
    for t in range(seqs.shape[1]):
        z = seqs[:, t, :] @ kernel + h @ recurrent + bias
        i = recurrent_activation(z[:, :u])
        f = recurrent_activation(z[:, u:2 * u])
        cand = np.tanh(z[:, 2 * u:3 * u])
        o = recurrent_activation(z[:, 3 * u:])
        c = f * c + i * cand
        h = o * np.tanh(c)
    return _sigmoid(h @ dense + dense_b)


def activity_udf(spark, weights):
    bc = spark.sparkContext.broadcast(weights)

    @F.pandas_udf(T.DoubleType())
    def activity(seqs: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(seqs), dtype=object)
        at = np.flatnonzero(seqs.notna())  # a NULL window has no score
        if len(at):
            x = np.stack([np.stack([np.asarray(v, dtype=np.float64) for v in s]) for s in seqs.iloc[at]])
            for i, y in zip(at, lstm_forward(x, bc.value)):
                out.iat[i] = float(y)
        return out
    return activity


def score_activity(df: DataFrame, seq_col: str, weights,
                   threshold: float = ACTIVITY_THRESHOLD) -> DataFrame:
    """J4 then D4: activity score of each full window and its label."""
    udf = activity_udf(df.sparkSession, weights)
    x = df.withColumn("activity_score", udf(F.col(seq_col)))
    return x.withColumn("activity", activity_label(F.col("activity_score"), threshold))
