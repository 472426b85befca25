"""Newest per camera, top-k, thresholds and frame sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import (ABNORMAL_ACTIVITY, ACTIVITY_THRESHOLD, EVENT_TOP_COUNT, NORMAL_ACTIVITY,
                      Detector, PipelineConfig)


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def latest_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the one greatest by ``order`` (e.g. event time,
    then partition and offset for ties). A max_by aggregate, combined
    map-side, so a hot camera costs one partial row per task."""
    keys, order = _cols(keys), _cols(order)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    rank = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.max_by(row, rank).alias("_r")).select(*keys, "_r.*")


def latest_per_window(df: DataFrame, key: str, ts_col: str, duration: str, order=(),
                      watermark: str | None = None) -> DataFrame:
    """Event-time form of D1; one row per (tumbling window, key). On a
    stream give ``watermark`` and run in append mode."""
    if watermark:
        df = df.withWatermark(ts_col, watermark)
    rest = [c for c in df.columns if c != key]
    rank = F.struct(F.col(ts_col), *[F.col(c) for c in _cols(order)])
    return (df.groupBy(F.window(ts_col, duration).alias("window"), key)
            .agg(F.max_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_r"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    key, "_r.*"))


def top_k_classes(scores, k: int = EVENT_TOP_COUNT) -> Column:
    """D3: indices and scores of the k best classes, best first; equal
    scores rank the lower index first. Row-local array functions."""
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("neg"), i.alias("idx"))))
    return F.transform(F.slice(ranked, 1, k),
                       lambda s: F.struct(s["idx"].alias("class_idx"), (-s["neg"]).alias("score")))


def event_topk(df: DataFrame, scores_col: str, k: int = EVENT_TOP_COUNT,
               labels: DataFrame | None = None) -> DataFrame:
    """D3 as rows: (…, rank, class_idx, score[, label]); rank 1 is the best.
    The original reports the same k classes in ascending order."""
    keep = [c for c in df.columns if c != scores_col]
    out = df.select(*keep, F.posexplode(top_k_classes(F.col(scores_col), k)).alias("_r", "_t")) \
        .select(*keep, (F.col("_r") + 1).alias("rank"), "_t.class_idx", "_t.score")
    if labels is not None:
        from .combine import label_lookup
        out = label_lookup(out, labels, "class_idx")
    return out


def activity_label(score, threshold: float = ACTIVITY_THRESHOLD) -> Column:
    """Strict threshold to the two activity strings."""
    return F.when(score > F.lit(threshold), F.lit(ABNORMAL_ACTIVITY)).otherwise(F.lit(NORMAL_ACTIVITY))


def sample_every_n(df: DataFrame, n: int, seq_col: str = "seq") -> DataFrame:
    """Frames whose per-camera position is a multiple of ``n`` (the
    first frame always). ``seq_col`` comes from ``keyed_sequence``."""
    if n < 1:
        raise ValueError("sample rate must be >= 1")
    return df.where(F.col(seq_col) % n == 0)


def _detector_array(detectors: list[Detector]) -> Column:
    return F.array(*[F.struct(F.lit(d.name).alias("detector"), F.lit(d.rate).alias("rate"))
                     for d in detectors])


def sampling_schedule(df: DataFrame, detectors: list[Detector], seq_col: str = "seq") -> DataFrame:
    """(frame, detector) for every detector due on the frame. The
    detector list is configuration (a handful of entries), expanded per row
    from a literal array; no join."""
    if not detectors:
        return df.withColumn("detector", F.lit(None).cast("string")).where(F.lit(False))
    d = F.explode(_detector_array(detectors)).alias("_d")
    return (df.select("*", d).where(F.col(seq_col) % F.col("_d.rate") == 0)
            .withColumn("detector", F.col("_d.detector")).drop("_d"))


def detector_toggle(df: DataFrame, config: PipelineConfig, seq_col: str = "seq") -> DataFrame:
    """the schedule of the detectors that are on; the feature extractor
    runs only while event or activity detection needs it."""
    return sampling_schedule(df, config.active_detectors(), seq_col)


def rate_intervals(rates: DataFrame) -> DataFrame:
    """E2/E3/F7 over time: from changes (detector, rate, enabled, valid_from)
    the intervals between them: epoch (from 0), valid_from, valid_to (NULL:
    open), ``rates`` (MAP detector -> rate of those that are on) and
    ``cycle`` (least common multiple of these). A detector keeps its last
    setting until it is changed. Both sides of the grid are configuration."""
    times, names = rates.select("valid_from").distinct(), rates.select("detector").distinct()
    grid = times.crossJoin(names).join(rates, ["detector", "valid_from"], "left")
    upto = W.partitionBy("detector").orderBy("valid_from")
    rate = F.last(F.when(F.col("rate").isNotNull(), F.struct("rate", "enabled")), ignorenulls=True).over(upto)
    on = F.collect_list(F.when(F.col("_s.enabled"), F.struct("detector", "_s.rate")))
    per = grid.withColumn("_s", rate).groupBy("valid_from").agg(F.map_from_entries(F.array_sort(on)).alias("rates"))
    by = W.orderBy("valid_from")  # a row per change of configuration
    gcd = "aggregate(sequence(1, least(a, b)), 1, (m, d) -> if(a % d = 0 and b % d = 0, d, m))"
    lcm = F.expr(f"aggregate(map_values(rates), 1, (a, b) -> int(a / {gcd} * b))")
    return per.select((F.row_number().over(by) - 1).alias("epoch"), "valid_from",
                      F.lead("valid_from").over(by).alias("valid_to"), "rates", lcm.alias("cycle"))


def in_interval(df: DataFrame, intervals: DataFrame, ts_col: str) -> DataFrame:
    """Temporal range join: each row with the epoch, rates and cycle of the
    interval its time lies in (NULL before the first). Intervals are laid out
    by day, so a row meets only those that touch its day: an equi join with
    the range as a residual, not every row with every interval. Days before
    and after all changes share one bin each."""
    day = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 86_400_000_000
    ends = intervals.agg(F.floor(F.min(day("valid_from"))).alias("lo"), F.floor(F.max(day("valid_from"))).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    bin_of = lambda c: F.greatest(lo - 1, F.least(hi + 1, F.floor(day(c))))
    last = F.coalesce(bin_of("valid_to"), hi + 1)
    side = intervals.select("epoch", "valid_from", "valid_to", "rates", "cycle",
                            F.explode(F.sequence(bin_of("valid_from"), last)).alias("_day"))
    x = df.withColumn("_d", bin_of(ts_col))
    on = (x["_d"] == side["_day"]) & (x[ts_col] >= side["valid_from"]) & (side["valid_to"].isNull() | (x[ts_col] < side["valid_to"]))
    return x.join(side, on, "left").drop("_d", "_day", "valid_from", "valid_to")


def schedule_over_time(df: DataFrame, rates: DataFrame, key: str, order, ts_col: str = "ts") -> DataFrame:
    """E2/F7 with rates that change: (frame, detector) for every detector due
    on the frame by the rates of its interval. A camera's counter starts
    again with each interval (``seq``: position in camera and interval)."""
    tagged = in_interval(df, rate_intervals(rates), ts_col).where(F.col("epoch").isNotNull())
    narrow = tagged.drop("rates", "cycle")
    from .sequence import keyed_sequence
    seq = keyed_sequence(narrow, [key, "epoch"], order)
    # The rates of an epoch are configuration: one small row each.
    per = rate_intervals(rates).select("epoch", F.explode("rates").alias("detector", "rate"))
    return seq.join(per, "epoch").where(F.col("seq") % F.col("rate") == 0).drop("rate")


def sampling_cycle(df: DataFrame, keys, detectors: list[Detector], seq_col: str = "seq") -> DataFrame:
    """The schedule repeats every lcm(rates) frames. Per (camera, cycle):
    frames seen and samples taken by each detector."""
    import math
    keys = _cols(keys)
    lcm = math.lcm(*[d.rate for d in detectors])
    aggs = [F.count(F.lit(1)).alias("n_frames")]
    aggs += [F.sum(F.when(F.col(seq_col) % d.rate == 0, 1).otherwise(0)).cast("bigint").alias(f"n_{d.name}")
             for d in detectors]
    return (df.withColumn("cycle", F.floor(F.col(seq_col) / lcm).cast("bigint"))
            .groupBy(*keys, "cycle").agg(*aggs))
