"""Shards of nearly equal size from ordered groups that stay whole.

Documents with equal texts are one group; groups are ordered by their smallest
id. A minimax contiguous partition cuts that order into shards so that the
largest one is as small as possible: a search over the capacity, each
capacity checked greedily (a shard takes groups until the next would not fit),
then the cut with the smallest feasible one.

Groups are not collected. Their running sizes (the sum of a group and all
before it) are a sorted table, and the greedy check asks it one thing: the last
running size that is not beyond a limit. That is a ``max`` per limit, combined
in the tasks, over a column sorted in its files, so row groups far from every
limit are skipped. A round checks several capacities at once and leaves the
interval between two of them: about log(largest group) / log(CHECKED) rounds
of one small job per shard. With that capacity the shards are cut so that each
is near its equal share of what is left, not filled one after the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sequence import keyed_sequence
from .common import saved

#: Capacities checked in one round.
CHECKED = 24
#: Groups of more than this share of all rows are joined by broadcast: there
#: are at most as many of them.
HOT = 1000


def documents_of(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32, uid (of the text) and
    the columns to keep, as a struct. Null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("int")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("uid"), kept.alias("kept"))


def running_sizes(groups: DataFrame) -> DataFrame:
    """``groups`` (uid, first, bytes) with ``upto``: the sizes of the group and
    all before it, by smallest id (null last), then uid."""
    by = [F.col("first").asc_nulls_last(), F.col("uid")]
    ranged = saved(groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("task", F.spark_partition_id()),
                   "ordered-groups")
    # One row a task; the sums of the tasks before it.
    before = (ranged.groupBy("task").agg(F.sum("bytes").alias("all"))
              .select(F.col("task").alias("t"), (F.sum("all").over(W.orderBy("task")) - F.col("all")).alias("before")))
    own = F.sum("bytes").over(W.partitionBy("task").orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
    sums = ranged.withColumn("own", own).join(before, F.col("task") == F.col("t"))
    return saved(sums.select("uid", "bytes", (F.col("before") + F.col("own")).alias("upto")).sortWithinPartitions("upto"),
                 "running-sizes")


class Boundaries:
    """The running sizes as places to cut at, with their total and the size of
    the largest group: the most that lies between two of them."""

    def __init__(self, sizes: DataFrame, total: int, largest: int):
        self.sizes, self.total, self.largest = sizes, total, largest

    def at_most(self, limits: list[int]) -> list[int]:
        """The last boundary (or 0) that is at most each limit."""
        limits, upto = [min(x, self.total) for x in limits], F.col("upto")
        near = reduce(lambda a, b: a | b, [upto.between(x - self.largest, x) for x in sorted(set(limits))])
        found = self.sizes.filter(near).agg(*[F.max(F.when(upto <= x, upto)).alias(f"e{i}") for i, x in enumerate(limits)])
        return [e or 0 for e in found.first()]

    def at_least(self, limit: int) -> int:
        """The first boundary (or 0) that is at least ``limit``."""
        if limit <= 0:
            return 0
        limit = min(limit, self.total)
        return self.sizes.filter(F.col("upto").between(limit, limit + self.largest)).agg(F.min("upto")).first()[0]


def smallest_capacity(at: Boundaries, shards: int) -> int:
    """The smallest capacity with which ``shards`` greedy shards hold all."""
    low = max(at.largest, -(-at.total // shards))
    high = low + at.largest  # a greedy shard leaves out less than the largest group
    asked = [low]
    while low < high:
        ends = [0] * len(asked)
        for _ in range(shards):
            ends = at.at_most([e + c for e, c in zip(ends, asked)])
        high = min([high, *[c for c, e in zip(asked, ends) if e >= at.total]])
        low = max([low, *[c + 1 for c, e in zip(asked, ends) if e < at.total]])
        step = max(1, (high - low) // (CHECKED + 1))
        asked = [c for c in range(low, high, step)][:CHECKED]
    return high


def cuts(at: Boundaries, shards: int, capacity: int) -> list[int]:
    """Ends of the shards: none larger than ``capacity``, each as near to its
    equal share of what is left as the others allow."""
    # The rest of m shards begins no earlier than this.
    earliest = [at.total]
    for _ in range(shards - 1):
        earliest.append(at.at_least(earliest[-1] - capacity))
    ends, start = [], 0
    for left in range(shards, 1, -1):
        most = at.at_most([start + capacity])[0]
        share = start + -(-(at.total - start) // left)
        share = min(max(share, earliest[left - 1]), most)
        end = at.at_most([share])[0]
        after = at.at_least(end + 1)
        if end == start or (after <= most and after - share < share - end):
            end = after  # a shard takes one group at least while there are some
        ends.append(end)
        start = end
    return [*ends, at.total]


def shard_of(ends: list[int]) -> Column:
    """The shard of a group by its running size: ends that lie before it."""
    bounds = F.array(*[F.lit(e) for e in ends[:-1]]).cast("array<long>")
    return F.size(F.filter(bounds, lambda e: e < F.col("upto"))).cast("int")


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law (``bytes``), shard
    (from 0), slot (position in its shard by doc_id, from 0, without gaps) and
    the ``keep`` columns as struct ``kept``.

    The largest shard is as small as contiguous shards of whole groups can
    have it. Rows of equal text share a shard; null counts as the empty text.
    With fewer groups than shards some shards stay empty. Repeated ids are
    rows of their own, null ids come last in a shard; rows alike in all columns
    are interchangeable. Empty table: empty result.
    """
    rows = saved(documents_of(docs, id_col, text_col, list(keep)), "sized")
    groups = rows.groupBy("uid").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = saved(groups, "text-groups")
    total, largest, n = groups.agg(F.sum("bytes"), F.max("bytes"), F.sum("n")).first()
    sizes = running_sizes(groups.select("uid", "first", "bytes"))
    ends = [0] * shards
    if total:
        at = Boundaries(sizes, total, largest)
        ends = cuts(at, shards, smallest_capacity(at, shards))
    where = sizes.select("uid", shard_of(ends).alias("shard"))
    # A group of a large share of the rows is not dealt to one task by its key.
    hot = groups.filter(F.col("n") * HOT > (n or 0)).select("uid")
    hot = saved(where.join(hot, "uid", "left_semi"), "hot-groups")
    first = rows.join(F.broadcast(hot), "uid", "left")
    placed = first.filter("shard is not null").unionByName(
        first.filter("shard is null").drop("shard").join(where, "uid"))
    placed = placed.withColumn("none", F.col("doc_id").isNull()).select(
        "shard", "none", "doc_id", "size", "text_crc32", "uid", "kept")
    numbered = keyed_sequence(placed, "shard", ["none", "doc_id", "uid"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                           *(["kept"] if keep else []))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as Parquet under ``path``, a folder ``shard=K`` each, all
    columns of ``docs`` and ``slot``, files in slot order."""
    placed = assign(docs, shards, id_col, text_col, docs.columns)
    shard, slot = _free("shard", docs.columns), _free("slot", docs.columns)
    rows = placed.select(F.col("shard").alias(shard), F.col("slot").alias(slot), "kept")
    rows = rows.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
    rows.select(shard, slot, "kept.*").write.partitionBy(shard).parquet(path)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name
