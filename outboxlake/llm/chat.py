"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation again each time it grows. Rolling hashes over the turns name
every prefix of a conversation; a conversation whose whole hash is a proper prefix of a
longer one goes by an anti-join, and of equal conversations the one with the smallest id
stays. The maximal conversations are rendered with role marks.

A conversation is a record: its turns are ordered by `turn`, then role and text, and repeated
rows count once. Rows without a conversation id belong to none and are not rendered; a null
turn sorts first, a null role is rendered as `unknown`, a null text as empty. Marks inside a
text are broken up, so that no text can open a turn. Prefix keys combine before they are
shuffled, so a first turn or a conversation that a third of the log shares is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outboxlake.llm.store import prepare, stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered(turns: str) -> Column:
    """The turns as one text."""

    def turn(x: Column) -> Column:
        body = F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")
        role = F.regexp_replace(F.coalesce(x["role"], F.lit("unknown")), r"[<|>\s]+", " ")
        return F.concat(F.lit(OPEN), role, F.lit("\n"), body, F.lit(CLOSE + "\n"))

    return F.array_join(F.transform(turns, turn), "")


def conversations(log: DataFrame) -> DataFrame:
    """(conv_id, turns, hashes): ordered turns, and the rolling hash after each of them."""
    rows = log.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    turns = F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns")
    # Nulls, and where a role ends and its text starts, are part of what is hashed.
    item = lambda x: F.to_json(F.struct(x["role"].alias("role"), x["text"].alias("text")))
    rolled = F.aggregate(
        "turns",
        F.array().cast("array<string>"),
        lambda done, x: F.concat(done, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), item(x)), 256))),
    )
    return rows.groupBy("conv_id").agg(turns).withColumn("hashes", rolled)


def maximal(log: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of the conversations that no longer one starts with."""
    prepare(log.sparkSession)
    known = stored(conversations(log), "conversations")
    ends = known.select("conv_id", F.size("turns").alias("n_turns"), F.try_element_at("hashes", F.lit(-1)).alias("hash"))
    best = ends.groupBy("n_turns", "hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = known.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("hash")).distinct()
    kept = best.join(inner, "hash", "left_anti")
    return known.join(kept, "conv_id").select("conv_id", F.col("n_turns").cast("long"), "n_copies", rendered("turns").alias("text"))
