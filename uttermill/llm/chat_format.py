"""Conversations from logs of snapshots, rendered as chat text.

Method: every turn gets the rolling hash of the conversation up to it.  A logged
conversation whose last hash is an inner hash of another one is a snapshot of it; an
anti-join keeps the maximal conversations, of equal ones the smallest id, and only
these are rendered.  Everything is DataFrame operations.

The rolling hash is the exclusive-or of the hashes of (position, role, text), 128 bits
wide.  So it can be summed up in two levels, blocks of turns and then turns of a block.
Turns are put in order by range partitions, numbered by their place in the partition and the
partition's offset in the conversation, and cut into blocks by that number: a conversation
with a large part of all rows is spread over many tasks, whatever its turn numbers are.

Defined cases: turns are ordered by number, role and text, nulls last in each, both for
prefixes and in the rendered text.  A null role is rendered as ``unknown``, a null text as an
empty one; both differ from their rendered forms when prefixes are compared.  Rows with
a null id are one conversation, kept under that id unless an equal one has an id.
Repeated rows are turns of their own.  An empty table gives an empty result.  Texts of any
length are compared by their hashes and rendered whole; a kept conversation must fit into a
row.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .frames import NO_ID, named

BLOCK_TURNS = 4_096
OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def rolling_hashes(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv, at, size, x, y): hash (x, y) of the first ``at`` of the ``size`` turns of ``turns`` (conv, turn, role, text, a, b)."""
    block = ["conv", "block"]
    order = [F.col("conv"), *[F.col(c).asc_nulls_last() for c in ("turn", "role", "text")]]
    # rows that are equal in all of it are interchangeable; the salt lets a range end among them
    salted = turns.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)))
    ranged = salted.repartitionByRange(*order, "salt").sortWithinPartitions(*order)
    part, number = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("number")
    ranged = stage(ranged.select("conv", part, number, "a", "b"), "chat-order")
    parts = ranged.groupBy("conv", "part").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    whole, before = Window.partitionBy("conv"), Window.partitionBy("conv").orderBy("part")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "conv", "part", "first", F.sum("n").over(whole).alias("size"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    placed = ranged.join(stage(starts, "chat-parts"), ["conv", "part"])
    placed = placed.withColumn("at", F.col("number") - F.col("first") + F.col("start") + 1)
    hashed = placed.select(
        "conv", F.floor((F.col("at") - 1) / block_turns).alias("block"), "at", "size",
        F.xxhash64("at", "a", "b").alias("x"), F.xxhash64("b", "at", "a").alias("y"),
    )
    hashed = stage(hashed, "chat-turns")
    xor = lambda c, w: F.bit_xor(c).over(w)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = hashed.groupBy(*block).agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = totals.select(*block, *[F.coalesce(xor(c, before), F.lit(0)).alias(f"{c}0") for c in "xy"])
    running = Window.partitionBy(*block).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hashed.select(*block, "at", "size", *[xor(c, running).alias(c) for c in "xy"])
        .join(earlier, block)
        .select("conv", "at", "size", *[F.col(c).bitwiseXOR(F.col(f"{c}0")).alias(c) for c in "xy"])
    )


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv, n_copies) of the conversations that are no snapshot of a longer one; equal ones count as copies."""
    ends = hashes.filter("at = size").groupBy("at", "x", "y")
    ends = ends.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    inner = hashes.filter("at < size").select("at", "x", "y").distinct()
    return ends.join(inner, ["at", "x", "y"], "left_anti").select("conv", "n_copies")


def _plain(text: Column) -> Column:
    """Without the marks of a turn's begin and end, so that a text cannot end its turn."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<$1>")


def chat_texts(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """(id, n_turns, n_copies, chat): one row per maximal conversation."""
    rows = turns.select(
        F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)).alias("conv"),
        named(turn_col).cast("long").alias("turn"),
        named(role_col).alias("role"),
        named(text_col).alias("text"),
    )
    # a null is hashed as such: the hash function by itself would skip it
    part = [F.isnull("role"), F.coalesce("role", F.lit("")), F.isnull("text"), F.coalesce("text", F.lit(""))]
    keys = rows.select("*", F.xxhash64(*part).alias("a"), F.xxhash64(F.lit(1), *part[::-1]).alias("b"))
    hashes = stage(rolling_hashes(keys, block_turns), "chat-hashes")
    kept = maximal(hashes)
    nulls_last = [x for c in ("turn", "role", "text") for x in (F.isnull(c).alias(f"no_{c}"), F.col(c))]
    turn = F.struct(*nulls_last)
    listed = rows.join(kept, "conv").groupBy("conv").agg(
        F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list(turn)).alias("turns")
    )
    role, text = lambda t: F.coalesce(t["role"], F.lit("unknown")), lambda t: F.coalesce(t["text"], F.lit(""))
    rendered = F.transform(
        "turns", lambda t: F.concat(F.lit(OPEN), _plain(role(t)), F.lit(BETWEEN), _plain(text(t)), F.lit(CLOSE))
    )
    return listed.select(
        F.when(F.col("conv") != NO_ID, F.col("conv")).alias(id_col),
        F.size("turns").cast("long").alias("n_turns"),
        "n_copies",
        F.array_join(rendered, "").alias("chat"),
    )
