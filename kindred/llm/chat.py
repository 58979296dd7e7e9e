"""Chat formatting after collapsing cumulative snapshots, in DataFrame functions only.

Logs often hold a conversation many times, each snapshot a turn or two longer.
A rolling hash of each conversation's first turns, as a window, tells which
conversations begin another, longer one; an anti-join leaves the maximal ones,
of equal ones the one of smallest id, and those are rendered.

The rolling hash is 128 bits wide: two exclusive-ors of the turns' hashes with
their places, so that it is a running aggregate, and equal only for equal turns
in equal order.

Defined results: turns are ordered by turn, then role and text, nulls first;
a null role renders as "user", a null text as empty, and both differ from an
empty string when conversations are compared; a null conv_id is a conversation
of its own; repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, table

BEGIN, END = "<|im_start|>", "<|im_end|>"


def _hash(seed: int) -> Column:
    absent = lambda c: F.when(c.isNull(), F.lit(1)).otherwise(F.lit(0))
    role, text = F.col("role"), F.col("text")
    return F.xxhash64(F.lit(seed), F.col("place"), absent(role), F.length(role), role, absent(text), text)


def prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> the same with place (from 1), total, h1, h2 of the turns so far."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("place", F.row_number().over(order))
    sofar = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy("conv_id")
    return placed.select(
        "*",
        F.bit_xor(_hash(1)).over(sofar).alias("h1"),
        F.bit_xor(_hash(2)).over(sofar).alias("h2"),
        F.max("place").over(everything).alias("total"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that begin no longer one, one of each set of equals."""
    rolled = prefixes(turns)
    key = ["h1", "h2", "place"]
    # Equal beginnings meet once for each task before they are dealt out.
    begun = rolled.where("place < total").select(*key).distinct()
    whole = rolled.where("place = total").groupBy(*key)
    whole = whole.agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("c"), F.count(F.lit(1)).alias("n_copies"))
    left = whole.join(begun, key, "left_anti")
    return left.select(F.col("c.conv_id").alias("conv_id"), F.col("place").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, rendered): a conversation's turns between markers, in order."""
    line = F.concat(
        F.lit(BEGIN), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n")
    )
    turn = F.struct("turn", "role", "text", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["line"])
    return turns.groupBy("conv_id").agg(F.array_join(lines, "").alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, itself included) and rendered, of maximal conversations."""
    turns = conversations.select(
        col("conv_id").alias("conv_id"), col("turn").alias("turn"), col("role").cast("string").alias("role"), col("text").cast("string").alias("text")
    )
    kept = maximal(turns).select(F.col("conv_id").alias("_conv"), "n_turns", "n_copies")
    mine = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    texts = render(mine)
    return texts.join(kept, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "n_turns", "n_copies", "rendered")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
