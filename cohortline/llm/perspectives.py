"""Dialogues seen by each of their participants.

For every participant of a dialogue the turns are rendered once with that speaker as the assistant and all others as users who
carry their names; only the assistant's turns are trained on. Context speakers (system notes) belong to every perspective and
have none of their own.

A row is one turn in one perspective, so nothing gathers a dialogue in one task: a dialogue with a great many turns is spread
like any other rows, and turns times participants is what the operator is asked for. ``rendered`` puts the turns of a
perspective in order where whole texts are wanted.

Marks that a text or a name contains are no marks in the rendering: a bar is doubled after ``<``, so that ``<|`` of a text reads
``<||``, and a backslash goes before each ``>`` of a name; ``plain`` gives the text back.

Defined cases: null texts are empty turns; null or blank speakers are the speaker ``unknown``; turns with equal numbers and
repeated rows are kept each; a dialogue without participants has no perspective; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = ("system",)
#: Fixed by the format: marks around the header and at the end of a turn.
HEAD, TAIL, END = "<|", "|>", "<|end|>"


def escaped(text: Column) -> Column:
    """The text with the first half of every mark changed; no mark of the format begins with ``<||``."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def plain(text: Column) -> Column:
    """The text that :func:`escaped` was given."""
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _speaker(role: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(role), F.lit("")), F.lit("unknown"))


def rotated(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """Rows (conv_id, perspective, turn, speaker, role, name, content, trained, is_first, is_last, segment).

    ``role`` is assistant, user or context, ``name`` the speaker where the role is user. ``segment`` is the rendered turn; the
    loss mask covers content and end mark of trained ones.
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), _speaker(F.col(role)).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("content"),
    )
    outside = F.col("speaker").isin(*context) if context else F.lit(False)
    by_speaker = rows.groupBy("conv_id", "speaker").agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    ends = by_speaker.groupBy("conv_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    views = by_speaker.where(~outside).select("conv_id", F.col("speaker").alias("perspective")).join(
        ends.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    seen = rows.join(views.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    part = F.when(outside, F.lit("context")).when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(part == "user", F.col("speaker"))
    head = F.concat(F.lit(HEAD), part, F.coalesce(F.concat(F.lit(" name="), F.replace(escaped(name), F.lit(">"), F.lit("\\>"))), F.lit("")), F.lit(TAIL))
    return seen.select(
        "conv_id", "perspective", "turn", "speaker", part.alias("role"), name.alias("name"), "content",
        (part == "assistant").alias("trained"), F.col("turn").eqNullSafe(F.col("low")).alias("is_first"),
        F.col("turn").eqNullSafe(F.col("high")).alias("is_last"),
        F.concat(head, F.lit("\n"), escaped(F.col("content")), F.lit(END), F.lit("\n")).alias("segment"),
        F.length(F.concat(head, F.lit("\n"))).cast("long").alias("content_start"),
    )


def rendered(segments: DataFrame) -> DataFrame:
    """One row (conv_id, perspective, text, spans) for each perspective; spans are the trained parts of the text, half open.

    This holds a perspective in one row, so it is for dialogues whose whole text fits a row.
    """
    part = F.struct("turn", "speaker", "content", "segment", "trained", "content_start")
    ordered = segments.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"))

    def step(acc, x):
        stop = acc["at"] + F.length(x["segment"])
        span = F.struct((acc["at"] + x["content_start"]).cast("long").alias("start"), (stop - 1).cast("long").alias("stop"))
        return F.struct(stop.cast("long").alias("at"), F.when(x["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return ordered.select(
        "conv_id", "perspective", F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("text"),
        F.aggregate("parts", empty, step, lambda a: a["spans"]).alias("spans"),
    )
