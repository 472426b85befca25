"""Late materialisation: wide columns of a file table, such as images, fetched
for chosen rows only, and never shuffled.

``located`` gives rows their place in the files: a hash of the file's path and
the row's index in it. What decides which rows are needed runs on narrow
columns and carries the place along; ``fetch`` then scans the files again and
joins the chosen places to the scan by broadcast, so a wide value stays in the
task that reads it. Only so many places as fit a bounded broadcast are joined
at a time: more are dealt to rounds by runs of files, and each round scans its
own files only, so every file is still read once (a file with more chosen rows
than a round holds is read by several rounds).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FETCH_ROWS

FILE, ROW = "_file", "_row"


def located(df: DataFrame) -> DataFrame:
    """A file scan's rows with their place in the files."""
    return df.withColumns({FILE: F.xxhash64(F.col("_metadata.file_path")), ROW: F.col("_metadata.row_index")})


def rounds(counts: list[tuple[int, int, int]], most: int) -> list[list[tuple[int, int]]]:
    """Runs of (file, block) with at most ``most`` chosen rows each, from
    (file, block, rows); a block alone may hold more."""
    out, held = [], 0
    for file, block, n in sorted(counts):
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append((file, block))
        held += n
    return out


def fetch(chosen: DataFrame, source: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """``chosen`` (with the places of ``located`` rows of ``source``) and the
    named columns of ``source``; the places are dropped. ``source`` is a file
    scan; none of the columns may have a name of ``chosen``."""
    most = most or FETCH_ROWS
    block = F.expr(f"`{ROW}` div {most}")
    # One row for every file and every ``most`` rows of it.
    per = chosen.groupBy(FILE, block.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    parts = rounds([(r[FILE], r["b"], r["n"]) for r in per], most)
    if len(parts) <= 1:
        return _joined(chosen, source, columns)
    deal = [(f, b, i) for i, part in enumerate(parts) for f, b in part]
    dealt = chosen.join(F.broadcast(chosen.sparkSession.createDataFrame(deal, f"{FILE} long, _b long, _i int")),
                        [FILE]).where(block == F.col("_b")).drop("_b")
    out = []
    for i, part in enumerate(parts):
        files = sorted({f for f, _ in part})
        # Known of a file before it is opened: other files are not read.
        own = source.where(F.xxhash64(F.col("_metadata.file_path")).isin(files))
        out.append(_joined(dealt.where(F.col("_i") == i).drop("_i"), own, columns))
    return reduce(DataFrame.unionByName, out)


def _joined(chosen: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    wide = located(source).select(F.col(FILE).alias("_f"), F.col(ROW).alias("_r"), *columns)
    on = (wide["_f"] == chosen[FILE]) & (wide["_r"] == chosen[ROW])
    return wide.join(F.broadcast(chosen), on).drop("_f", "_r", FILE, ROW)
