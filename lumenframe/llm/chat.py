"""Chat formatting by perspective rotation, in DataFrame functions only.

Every participant of a dialogue is the assistant once: the whole dialogue is rendered with that speaker's turns as the
assistant's, all others as named users, system turns as they are, and with the spans to train on.

A dialogue may be of any length, so it is rendered in parts of ``part_turns`` turn numbers; turns are gathered
per part only, and the participants, one short array per dialogue, are joined to the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers in a part.
PART_TURNS = 256
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, NOBODY = "system", "unknown"


def _plain(text: Column) -> Column:
    """Text that can't be taken for a marker; null is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """One row per dialogue, part and participant.

    Columns: ``conversation``, ``part`` (turn // part_turns), ``perspective`` (the participant), ``n_turns``, ``rendered``, and
    ``targets``, an array of (start, end) code point spans of ``rendered`` to train on: the participant's own texts with
    their end markers.

    * Turns are in order of turn, then speaker, then text; null turns form a part of their own (part null).
    * A null speaker is ``unknown``, a null text empty. Line breaks in names become spaces; ``<|`` in names and
      texts becomes ``< |``, so no text can forge a marker.
    * ``system`` is no participant; a dialogue of system turns only gives no row. Rows of a null dialogue id form one dialogue.
    * A participant silent in a part has an empty ``targets`` there. Repeated rows are turns of their own.
    * An empty table gives an empty result; other columns are ignored.
    """
    name = F.translate(_plain(F.coalesce(F.col(speaker), F.lit(NOBODY))), "\r\n", "  ")
    rows = turns.select(
        F.col(conversation).alias("conv"),
        F.floor(F.col(turn) / part_turns).cast("long").alias("part"),
        F.struct(F.col(turn).alias("turn"), name.alias("speaker"), _plain(F.col(text)).alias("text")).alias("said"),
    )
    people = (
        rows.where(F.col("said.speaker") != SYSTEM)
        .groupBy(F.col("conv").alias("whose"))
        .agg(F.sort_array(F.collect_set("said.speaker")).alias("people"))
    )
    parts = rows.groupBy("conv", "part").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    views = parts.join(people, F.col("conv").eqNullSafe(F.col("whose"))).select(
        "conv", "part", "turns", F.explode("people").alias("perspective")
    )

    def head(t: Column) -> Column:
        role = (
            F.when(t["speaker"] == F.col("perspective"), F.lit("assistant"))
            .when(t["speaker"] == SYSTEM, F.lit("system"))
            .otherwise(F.concat(F.lit("user name="), t["speaker"]))
        )
        return F.concat(F.lit(START), role, F.lit("\n"))

    said = F.transform(
        "turns",
        lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), (t["speaker"] == F.col("perspective")).alias("own")),
    )
    views = views.withColumn("said", said)

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        end = start + F.length(t["text"]) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return views.select(
        F.col("conv").alias(conversation),
        "part",
        "perspective",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda t: F.concat(t["head"], t["text"], F.lit(END + "\n"))), "").alias("rendered"),
        F.aggregate("said", first, step, lambda state: state["spans"]).alias("targets"),
    )
