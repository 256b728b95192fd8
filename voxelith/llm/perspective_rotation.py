"""Multi-party dialogues rendered once from the view of every participant.

For each participant of a conversation the whole dialogue is written with that speaker as
``assistant`` and all other speakers as named users; ``mask`` lists the code point spans of the
assistant's contents, the only text a loss should count. Roles in ``instructions`` are no
participants and keep their role in every rendering.

A conversation is written in parts of ``part_turns`` turn numbers, so a conversation of any
length makes many bounded rows and no task holds it whole. Participants are those of the whole
conversation: a part in which a participant is silent has an empty mask. Only DataFrame functions
are used.

Defined results: identical rows with a turn number count once; rows that share a turn are written in
the order of role and text; a null text is an empty content, a null role the speaker ``unknown``; rows
without a turn all count, repeats too, and are written in the order of role and text, ``part_turns``
of them in each of the parts -1, -2 and so on; a conversation of instructions alone gives no row;
marks of the format inside texts and names are defused; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 256
INSTRUCTIONS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def defused(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<im_start>")), F.lit(CLOSE), F.lit("<im_end>"))


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    part_turns: int = PART_TURNS, instructions: tuple[str, ...] = INSTRUCTIONS,
) -> DataFrame:
    """``conv_id, part, perspective, n_turns, n_target, mask, text`` of every part and participant."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        defused(F.coalesce(role_col, F.lit("unknown"))).alias("role"), defused(F.coalesce(text_col, F.lit(""))).alias("text"),
    )
    # numbers for rows without one keep equal rows apart, and their parts bounded
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("role", "text")).cast("bigint")
    unnumbered = rows.where("turn IS NULL").withColumn("turn", number).withColumn("part", -1 - F.floor((F.col("turn") - 1) / part_turns))
    placed = rows.where("turn IS NOT NULL").withColumn("part", F.floor(F.col("turn") / part_turns)).unionByName(unnumbered)
    # as many turns as a part has numbers
    parts = placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = rows.where(~F.col("role").isin(*instructions)).select("conv_id", F.col("role").alias("perspective")).distinct()
    same = F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))
    each = parts.alias("p").join(speakers.alias("s"), same).select("p.conv_id", "part", "perspective", "turns")

    def head(role: Column) -> Column:
        name = F.when(role == F.col("perspective"), F.lit("assistant")).when(role.isin(*instructions), role).otherwise(F.concat(F.lit("user name="), role))
        return F.concat(F.lit(OPEN), name, F.lit("\n"))

    written = F.transform("turns", lambda t: F.struct(
        head(t["role"]).alias("head"), t["text"].alias("text"), (t["role"] == F.col("perspective")).alias("own")
    ))
    tail = f"{CLOSE}\n"

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(t["head"])
        end = begin + F.length(t["text"])
        span = F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))
        return F.struct((end + len(tail)).alias("at"), F.when(t["own"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return (
        each.select("conv_id", "part", "perspective", F.size("turns").cast("bigint").alias("n_turns"), written.alias("w"))
        .select(
            "conv_id", "part", "perspective", "n_turns",
            F.size(F.filter("w", lambda t: t["own"])).cast("bigint").alias("n_target"),
            F.array_join(F.aggregate("w", start, step, lambda s: s["spans"]), ",").alias("mask"),
            F.array_join(F.transform("w", lambda t: F.concat(t["head"], t["text"], F.lit(tail))), "").alias("text"),
        )
    )
