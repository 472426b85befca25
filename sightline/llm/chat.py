"""Chat formatting after collapsing cumulative snapshots.

A logged conversation is often the beginning of a longer one that was logged
later. Each turn is numbered within its conversation and hashed with its
place; the rolling hash of a prefix is the exclusive-or of its turns' hashes,
128 bits in all. A conversation whose whole hash is that of a proper prefix
of another one is left out by an anti join; of equal conversations the
smallest id stays. What is left is rendered.

Numbering and rolling hashes work on segments of a conversation, so a
conversation of any length is spread over tasks and no row gathers more than
one segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sequence import keyed_sequence
from .common import pinned

#: Turns in a segment, the unit of hashing and of a rendered row.
SEGMENT = 256
#: Fixed: the markers of a rendered turn.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn, then role and text), segment, role, text
    and the rolling hashes a, b of the prefix that ends with the turn, with
    the turn's own hashes own_a, own_b."""
    rows = (turns.filter(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
            .distinct())
    t = keyed_sequence(rows, "conv_id", ["turn", "role", "text"], "pos").drop("turn")
    t = (t.withColumn("segment", F.expr(f"pos div {SEGMENT}"))
         .withColumn("own_a", F.xxhash64("pos", "role", "text"))
         .withColumn("own_b", F.xxhash64(F.lit("second"), "text", "role", "pos")))
    upto = W.partitionBy("conv_id", "segment").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("a", F.bit_xor("own_a").over(upto)).withColumn("b", F.bit_xor("own_b").over(upto))
    # What the segments before add; conversations of one segment have no row here.
    per = t.groupBy("conv_id", "segment").agg(F.bit_xor("own_a").alias("xa"), F.bit_xor("own_b").alias("xb"))
    before = W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    base = (per.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"),
                       F.bit_xor("xa").over(before).alias("xa"), F.bit_xor("xb").over(before).alias("xb"))
            .filter("s > 0"))
    j = t.join(base, (t["conv_id"] == base["c"]) & (t["segment"] == base["s"]), "left")
    add = lambda x, y: F.col(x).bitwiseXOR(F.coalesce(F.col(y), F.lit(0).cast("long")))
    return j.select("conv_id", "pos", "segment", "role", "text", add("a", "xa").alias("a"), add("b", "xb").alias("b"),
                    "own_a", "own_b")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies (equal conversations, itself included) of
    the conversations that are no proper prefix of another one and have the
    smallest id among equal ones. ``turns``: from ``numbered_turns``."""
    inner = (turns.filter("pos > 0")
             .select(F.col("pos").alias("n"), F.col("a").bitwiseXOR(F.col("own_a")).alias("a"),
                     F.col("b").bitwiseXOR(F.col("own_b")).alias("b")).distinct())
    ends = (turns.groupBy("conv_id").agg(F.max(F.struct("pos", "a", "b")).alias("e"))
            .select("conv_id", (F.col("e.pos") + 1).alias("n"), "e.a", "e.b"))
    same = ends.groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    return same.join(inner, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), text, F.lit(TURN_END + "\n"))


def chat_documents(conversations: DataFrame) -> DataFrame:
    """One row per segment of a kept conversation: conv_id, segment (from 0),
    n_turns (of the conversation), copies and text; a conversation of up to
    256 turns is one row.

    Turns go by ``turn``, nulls first, ties by role and text; gaps and other
    first numbers do not matter. Rows that repeat a turn wholly count once.
    Null role or text counts as empty. Rows without conv_id belong to no
    conversation. Empty table: empty result. Columns other than conv_id,
    turn, role and text are not read.
    """
    turns = numbered_turns(conversations)
    kept = pinned(maximal(turns))
    # Rendering needs the numbered turns only, not their hashes.
    rows = turns.select("conv_id", "segment", F.struct("pos", render_turn(F.col("role"), F.col("text")).alias("t")).alias("r"))
    rows = rows.join(kept, "conv_id")
    return (rows.groupBy("conv_id", "segment", "n_turns", "copies")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["t"]), "").alias("text")))
