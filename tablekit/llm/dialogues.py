"""Multi-party perspective rotation: one rendering of a dialogue for each of its speakers.

Rows are turns, before and after. A turn meets the distinct speakers of its
dialogue once, and the place of each turn inside a rendering comes from a
running total over a range partitioning, so a dialogue of any length, with a
third of all rows, never has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.llm.base import prepare
from tablekit.operators import rows as row_order

# The markers of a rendered turn.
ASSISTANT_HEAD = "<|assistant|>\n"
USER_HEAD = "<|user|>"
SYSTEM_HEAD = "<|system|>\n"
TURN_END = "<|end|>\n"


def rotate_perspectives(
    turns: DataFrame,
    dialogue: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system: str = "system",
) -> DataFrame:
    """Render every dialogue once for each speaker, that speaker as the assistant.

    Other speakers become users with their name before the text; turns of
    ``system`` stay system turns, and system is no speaker. Returns one row per
    rendering and turn: the dialogue, ``perspective``, the turn, the speaker,
    ``rendered``, ``loss`` (whether its text bears loss), ``start`` and ``stop``
    (characters of the rendering before and up to its end), ``loss_start`` and
    ``loss_stop`` (the part of it that bears loss: the text and its end marker,
    null without loss).

    A null speaker is called "unknown", a null text is empty. Turns with equal
    numbers stand in the order of speaker and text; fully repeated rows are turns of
    their own; a null turn number stands first; rows with a null dialogue form one
    dialogue. A dialogue with system turns alone has no rendering.
    """
    prepare(turns.sparkSession)
    given = turns.select(
        F.col(dialogue).alias("dialogue"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    speakers = (
        given.where(F.col("speaker") != system)
        .select(F.col("dialogue").alias("in_dialogue"), F.col("speaker").alias("perspective"))
        .distinct()
    )
    own = F.col("speaker") == F.col("perspective")
    head = (
        F.when(own, F.lit(ASSISTANT_HEAD))
        .when(F.col("speaker") == system, F.lit(SYSTEM_HEAD))
        .otherwise(F.concat(F.lit(USER_HEAD), F.col("speaker"), F.lit("\n")))
    )
    rendered = (
        given.join(speakers, F.col("dialogue").eqNullSafe(F.col("in_dialogue")))
        .drop("in_dialogue")
        .withColumns({"head": F.length(head), "loss": own, "rendered": F.concat(head, F.col("text"), F.lit(TURN_END))})
        .drop("text")
    )
    # The order must tell rows apart only where they differ, as equal rows can stand either way round.
    placed = row_order.running_total(
        rendered, ["dialogue", "perspective", "turn", "speaker", "rendered"], F.length("rendered"), "total"
    )
    first = placed.groupBy("dialogue", "perspective").agg(F.min("total").alias("first"))
    first = first.select(F.col("dialogue").alias("d"), F.col("perspective").alias("p"), "first")
    start = F.col("total") - F.col("first")
    stop = start + F.length("rendered")
    return placed.join(
        first, F.col("dialogue").eqNullSafe(F.col("d")) & (F.col("perspective") == F.col("p"))
    ).select(
        F.col("dialogue").alias(dialogue),
        "perspective",
        F.col("turn").alias(turn),
        F.col("speaker").alias(speaker),
        "rendered",
        "loss",
        start.alias("start"),
        stop.alias("stop"),
        F.when(F.col("loss"), start + F.col("head")).alias("loss_start"),
        F.when(F.col("loss"), stop).alias("loss_stop"),
    )
