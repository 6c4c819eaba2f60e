"""Multi-party chat formatting by perspective rotation, in DataFrame expressions.

A dialogue is rendered once for every participant: that speaker's turns become the
assistant's, the other speakers are users with their name, system turns stay
system turns, and the loss mask covers the speaker's own words and their end mark.

A dialogue is rendered in parts of ``PART_TURNS`` turns, so a conversation of any
length is many rows and many tasks; ``part`` and ``offset`` (characters before the
part) say where a part belongs, and the parts of a perspective joined in order are
the whole rendering. Turns get their positions from one range sort over
(conversation, turn, speaker, text), which cuts a long conversation between
partitions, and from the turn counts of the partitions before.

Defined cases: a null text is empty, a null or empty role is the speaker
``unknown``, a null conversation is one conversation and a null turn comes
first. Repeated rows are one turn; different rows of one turn are ordered by role
and text. A dialogue without participants (system turns only) has no rows.
``<|`` in texts and names is written ``<\\|``, so no text can forge a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corridor.scratch import stored

START, END = "<|im_start|>", "<|im_end|>\n"
PART_TURNS = 256
SYSTEM = "system"


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, speaker, text, position)``: distinct turns, numbered from 0 in each conversation."""
    name = F.coalesce(F.when(F.trim(F.col(role_col).cast("string")) != "", F.col(role_col).cast("string")), F.lit("unknown"))
    picked = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), name.alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).distinct()
    keys = ["conv", "turn", "speaker", "text"]
    ranged = picked.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(
        ranged.withColumn("piece", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "chat-turns"
    )
    pieces = placed.groupBy("conv", "piece").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        F.col("conv").alias("_conv"), F.col("piece").alias("_piece"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    same = placed.conv.eqNullSafe(starts["_conv"]) & (placed.piece == starts["_piece"])
    return placed.join(starts, same).select(*keys, (F.col("at") + F.col("shift")).alias("position"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           part_turns: int = PART_TURNS) -> DataFrame:
    """A row per (conversation, participant, part): see the module's text.

    ``<conv>, perspective, part, offset, n_turns, n_own_turns, rendered,
    mask`` (spans ``(start, end)`` of characters in ``rendered`` to learn from) and
    ``mask_chars``.
    """
    placed = ordered_turns(turns, conv_col, turn_col, role_col, text_col).withColumn(
        "part", F.floor(F.col("position") / part_turns).cast("long")
    )
    bundled = stored(
        placed.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("position", "speaker", "text"))).alias("turns")), "chat-parts"
    )
    speakers = bundled.select("conv", F.explode(F.array_distinct(F.col("turns.speaker"))).alias("perspective")).distinct()
    people = speakers.where(F.col("perspective") != SYSTEM).withColumnRenamed("conv", "_conv")
    views = bundled.join(people, bundled.conv.eqNullSafe(people["_conv"])).drop("_conv")
    safe = lambda c: f"replace({c}, '<|', '<\\\\|')"
    header = (
        f"case when t.speaker = perspective then '{START}assistant\n' when t.speaker = '{SYSTEM}' then '{START}system\n' "
        f"else concat('{START}user name=', {safe('t.speaker')}, '\n') end"
    )
    pieces = f"transform(turns, t -> named_struct('own', t.speaker = perspective, 'head', {header}, 'body', concat({safe('t.text')}, '{END}')))"
    shaped = views.withColumn("pieces", F.expr(pieces)).drop("turns")
    walked = shaped.withColumn("walk", F.expr(
        "aggregate(pieces, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint, end:bigint>>)), "
        "(s, p) -> named_struct('at', s.at + length(p.head) + length(p.body), 'spans', if(p.own, concat(s.spans, "
        "array(named_struct('start', s.at + length(p.head), 'end', s.at + length(p.head) + length(p.body)))), s.spans)))"
    ))
    before = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = walked.select(
        F.col("conv").alias(conv_col), "perspective", "part", F.coalesce(F.sum("walk.at").over(before), F.lit(0)).alias("offset"),
        F.size("pieces").cast("long").alias("n_turns"), F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own_turns"),
        F.expr("array_join(transform(pieces, p -> concat(p.head, p.body)), '')").alias("rendered"), F.col("walk.spans").alias("mask"),
        F.expr("aggregate(walk.spans, 0L, (t, s) -> t + s.end - s.start)").alias("mask_chars"),
    )
    return sizes
