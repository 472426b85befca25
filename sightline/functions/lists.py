"""Functions over a frame's prediction list (ARRAY<STRUCT>), row-local.

A scorer returns one bounded list of detections per frame; these functions
work on that list inside the row, so no shuffle is needed for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SUMMARY_LINE_FORMAT
from ..sources.tables import detection_columns


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value, body) -> Column:
    """``body`` of a value that is computed once for a row, however often
    ``body`` uses it: a column that is only named would be put in at every use
    by the optimizer, a lambda's argument is not."""
    return F.element_at(F.transform(F.array(_c(value)), body), 1)


def held(df: DataFrame, **columns) -> DataFrame:
    """Add columns as a generated row, so that filters and projections after
    it use their values and do not compute them again."""
    return df.select("*", F.inline(F.array(F.struct(*[_c(c).alias(n) for n, c in columns.items()]))))


def stub_prediction_list(k) -> Column:
    """The stand-in detector's list for a frame (same rows as the
    ``detections`` view), as ARRAY<STRUCT<pos, label, confidence, ...>>."""
    return let(k, lambda kk: F.transform(F.array_repeat(F.lit(0), kk % 4), lambda _z, i: F.struct(
        i.cast("int").alias("pos"), *[c.alias(n) for n, c in detection_columns(kk, i).items()])))


def keep_confident(preds, thresholds: dict[str, float]) -> Column:
    """C3 on a list: detections above their detector's threshold."""
    m = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.filter(_c(preds), lambda d: F.coalesce(d["confidence"] > F.element_at(m, d["detector"]),
                                                     F.lit(True)))


def _lines(labels) -> Column:
    """G2 over the label array of a list."""
    before, after = SUMMARY_LINE_FORMAT.replace("{label}", "\0").split("\0")
    between, end = after.split("{count}")
    return F.array_join(F.transform(F.array_distinct(labels), lambda lab: F.concat(
        F.lit(before), lab, F.lit(between), F.size(F.filter(labels, lambda x: x == lab)).cast("string"), F.lit(end))), "")


def summary_of_list(preds) -> Column:
    """G2 on a list: ``label (count)`` lines in first-seen order."""
    return let(F.transform(_c(preds), lambda d: d["label"]), _lines)


def counts_of_list(preds) -> Column:
    """G1 on a list: ARRAY<STRUCT<label, n>> in first-seen order."""
    return let(F.transform(_c(preds), lambda d: d["label"]), lambda labels: F.transform(
        F.array_distinct(labels), lambda lab: F.struct(
            lab.alias("label"), F.size(F.filter(labels, lambda x: x == lab)).cast("bigint").alias("n"))))


def union_of_lists(lists: list) -> Column:
    """F1 on lists: the detectors' lists in the given order, duplicates kept."""
    return F.concat(*[_c(x) for x in lists])


def on_watchlist_list(preds, watchlist, exact: bool = False) -> Column:
    """C4 on a list: any label on the watchlist; by default both are trimmed
    and in lower case, ``exact`` compares as they are."""
    if exact:
        wl = list(watchlist)
        return F.exists(_c(preds), lambda d: d["label"].isin(wl))
    wl = sorted({w.strip().lower() for w in watchlist})
    return F.exists(_c(preds), lambda d: F.lower(F.trim(d["label"])).isin(wl))


def of_detector(preds, name: str) -> Column:
    return F.filter(_c(preds), lambda d: d["detector"] == F.lit(name))
