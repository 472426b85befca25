"""Exact deduplication by deterministic block naming.

Each text is cut into blocks of a fixed number of characters. Equal blocks
get one integer name: the smallest row number among their occurrences. Then
adjacent names are paired and equal pairs named the same way, until one name
is left per document. Names come from comparing whole blocks, never hashes,
so (number of blocks, last name) identifies a text without collisions.

All work is DataFrame aggregation and joins: a block held by many documents
is combined before the shuffle, and in the join back its rows can be split
by adaptive execution since the other side has one row per name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import collapsed, pinned, saved, unique_ids, without

#: Characters in a block: most documents are one block, long ones a few.
BLOCK_CHARS = 4096


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None,
                block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``text`` is the expression compared, by default the column ``text`` with
    white space collapsed. Null text counts as empty; empty texts are equal
    to each other. Null ids come last; of rows that share the smallest id
    exactly one is kept. An empty table gives an empty result. Other columns
    are not read, whatever their names.
    """
    norm = collapsed("text") if text is None else text
    blocks = _blocks(docs.select(F.col(id_col).alias("doc_id"), norm.alias("_norm")), block_chars)
    names = blocks.groupBy("block").agg(F.min("uid").alias("name"))
    named = saved(blocks.join(names, "block").drop("block"), "block-names")

    one = named.filter("n = 1").select("row", "n", "name", "doc_id", "text_sha256")
    whole, level = one, named.filter("n > 1").select("row", "n", "pos", "uid", "name")
    left = named.agg(F.max("n")).first()[0] or 1
    ends = []
    step = 1
    while left > 1:
        level = pinned(_name_pairs(level))
        left = -(-left // 2)
        step *= 2
        # Blocks left per document after this round: ceil(n / step).
        ends.append(level.filter((F.col("n") <= step)).select("row", "n", "name"))
        level = level.filter(F.col("n") > step)
    if ends:
        last = ends[0]
        for e in ends[1:]:
            last = last.unionAll(e)
        heads = named.filter("n > 1 and pos = 0").select("row", "doc_id", "text_sha256")
        whole = whole.unionAll(last.join(heads, "row").select("row", "n", "name", "doc_id", "text_sha256"))

    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    groups = (whole.groupBy("n", "name")
              .agg(first.alias("k"), F.count(F.lit(1)).alias("group_size"))
              .select("n", "name", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row"), "group_size"))
    return (whole.join(groups, ["n", "name"])
            .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"))


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """row, n, pos, uid, block, and doc_id and text_sha256 on the first block.
    Row numbers come from the scan, so a repeated task gives them again."""
    cut = F.regexp_extract_all("_norm", F.lit("(?s).{1,%d}" % size), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                       F.sha2("_norm", 256).alias("text_sha256"),
                       F.when(F.col("_norm") == "", F.array(F.lit(""))).otherwise(cut).alias("_cut"))
    out = rows.select("row", "doc_id", "text_sha256", F.size("_cut").alias("n"),
                      F.posexplode("_cut").alias("pos", "block"))
    head = F.col("pos") == 0
    return out.select("row", "n", "pos", F.monotonically_increasing_id().alias("uid"), "block",
                      F.when(head, F.col("doc_id")).alias("doc_id"),
                      F.when(head, F.col("text_sha256")).alias("text_sha256"))


def _name_pairs(level: DataFrame) -> DataFrame:
    """Name adjacent pairs of names; a last odd one is paired with -1."""
    even = F.col("pos") % 2 == 0
    pairs = (level.groupBy("row", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
             .agg(F.max(F.when(even, F.col("name"))).alias("a"),
                  F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
                  F.min("uid").alias("uid")))
    names = pairs.groupBy("a", "b").agg(F.min("uid").alias("name"))
    return pairs.join(names, ["a", "b"]).select("row", "n", "pos", "uid", "name")


def keep_first(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose text repeats that of a smaller id."""
    rows, key = unique_ids(docs, id_col)
    drop = exact_dedup(rows, key).filter("not kept").select("doc_id")
    return without(rows, drop, key).select(docs.columns)
