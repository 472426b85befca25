"""Filters and predicates (B6, C1-C6). All row-local: no shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import FRESHNESS_SECONDS, SECONDS_PER_DAY
from ..functions.codec import CORRUPT_FIELD, FRAME_EVENT_SCHEMA, bad_record_reason, parse_frame_event
from .sequence import join_small


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def age_micros(event_ts, now=None) -> Column:
    """Microseconds from the event time to ``now`` (a column, or the query's
    current time, which is constant within one micro-batch)."""
    now_c = F.current_timestamp() if now is None else _c(now)
    return F.timestamp_diff("MICROSECOND", _c(event_ts), now_c)


def _whole_seconds(age_us: Column) -> Column:
    return F.floor(age_us / F.lit(1_000_000))


def is_fresh(event_ts, now=None, limit_s: int = FRESHNESS_SECONDS) -> Column:
    """The event is between 0 and ``limit_s`` whole seconds old."""
    age = age_micros(event_ts, now)
    return (age >= 0) & (_whole_seconds(age) <= limit_s)


def is_fresh_day_wrapped(event_ts, now=None, limit_s: int = FRESHNESS_SECONDS) -> Column:
    """Compatibility form that looks only at the seconds-within-day part
    of the age, so events whole days off (or in the future by the complement)
    pass as well."""
    age = age_micros(event_ts, now)
    return F.pmod(_whole_seconds(age), F.lit(SECONDS_PER_DAY)) <= limit_s


def freshness_filter(df: DataFrame, ts_col: str = "event_ts", now=None,
                     limit_s: int = FRESHNESS_SECONDS, day_wrapped: bool = False) -> DataFrame:
    pred = (is_fresh_day_wrapped if day_wrapped else is_fresh)(ts_col, now, limit_s)
    return df.where(pred)


def confidence_filter(dets: DataFrame, thresholds: dict[str, float],
                      detector_col: str = "detector", conf_col: str = "confidence") -> DataFrame:
    """Keep detections above their detector's threshold (strict). The
    thresholds are configuration, looked up from a literal map in codegen;
    detectors without a threshold keep everything."""
    m = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
    thr = F.element_at(m, F.col(detector_col)) if thresholds else F.lit(None).cast("double")
    return dets.where(thr.isNull() | (F.col(conf_col) > thr))


def normalise_label(col) -> Column:
    return F.lower(F.trim(_c(col)))


def on_watchlist(label, watchlist: Iterable[str], exact: bool = False) -> Column:
    """C4 per detection: label is on the watchlist. Default compares trimmed
    lower-case names; ``exact`` compares the text as it is."""
    wl = list(watchlist)
    if exact:
        return _c(label).isin(wl)
    return normalise_label(label).isin(sorted({w.strip().lower() for w in wl}))


def watchlist_flag(dets: DataFrame, frame_keys, watchlist: Iterable[str], exact: bool = False,
                   label_col: str = "label", with_exact: bool = False) -> DataFrame:
    """C4 per frame: does any detection of the frame hit the watchlist
    (``suspicious``; with ``with_exact`` also ``suspicious_exact``, the
    case-sensitive test, in the same aggregate). A partial (map-side)
    aggregate, so large frames do not skew."""
    keys = [frame_keys] if isinstance(frame_keys, str) else list(frame_keys)
    wl = list(watchlist)
    aggs = [F.bool_or(on_watchlist(label_col, wl, exact)).alias("suspicious")]
    if with_exact:
        aggs.append(F.bool_or(on_watchlist(label_col, wl, exact=True)).alias("suspicious_exact"))
    return dets.groupBy(*keys).agg(*aggs)


def watchlist_events(df: DataFrame, watch: DataFrame, label_col: str = "label",
                     watch_col: str = "label") -> DataFrame:
    """Rows whose (normalised) label is on a watchlist table."""
    w = watch.select(normalise_label(watch_col).alias("_wl")).distinct()
    x = df.withColumn("_wl", normalise_label(label_col))
    return join_small(x, w, "_wl", "left_semi").drop("_wl")


def nonempty_filter(df: DataFrame, list_col: str = "detections") -> DataFrame:
    """Rows whose prediction list has at least one entry."""
    return df.where(F.coalesce(F.size(list_col), F.lit(0)) > 0)


def split_bad_records(msgs: DataFrame, value_col: str = "value", fail_fast: bool = False,
                      schema: StructType = FRAME_EVENT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Parse frame messages (or, by ``schema``, other events with a
    camera, a time and an image) and split them into (good, quarantined).
    Quarantined rows carry ``reason``. With ``fail_fast`` the first message
    that is not JSON stops the job instead (B1).

    The parsed struct is generated as a row (``inline``), which keeps the
    optimizer from copying the parse into every use of its fields."""
    parsed = msgs.select("*", F.inline(F.array(parse_frame_event(value_col, schema, fail_fast))))
    fields = {c: F.col(c) for c in [*schema.names, CORRUPT_FIELD]}
    # Blank text is no JSON either, but parses to no struct and no corrupt text.
    text = F.col(value_col).cast("string")
    blank = text.isNull() | (F.btrim(text, F.lit(" \t\r\n")) == "")
    parsed = parsed.withColumn("reason", bad_record_reason(fields, blank))
    good = parsed.where(F.col("reason").isNull()).drop("reason", CORRUPT_FIELD)
    bad = parsed.where(F.col("reason").isNotNull()).drop(*fields)
    return good, bad
