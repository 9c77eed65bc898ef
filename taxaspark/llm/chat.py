"""Multi-party dialogues, rotated so that each participant is the assistant once.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, the others as
users named after themselves, and a mask that lets a model learn only from the assistant's own words. A rendering is
given turn by turn: its text is the segments joined in order of ``turn`` and ``place``, and each segment carries its
offsets in it, so that a conversation of any length is never gathered in one row; ``assembled`` joins short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.llm.common import stored

START, STOP = "<|im_start|>", "<|im_end|>\n"
#: Turns of a block: offsets are summed within blocks and then over blocks.
BLOCK = 1024
SYSTEM = "system"


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, speaker, text, place: null speakers are "unknown", null texts empty; a total order of the turns."""
    rows = conversations.select("conv_id", "turn", F.coalesce(F.nullif(F.trim(F.col("role").cast("string")), F.lit("")), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.groupBy("conv_id", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("copies"))


def _escaped(text: Column) -> Column:
    """Text whose own control marks can't be taken for the format's."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def perspectives(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, participant and turn.

    conv_id, perspective, turn, place (from 0, among turns of the same number), speaker, role (assistant, user or
    system), segment, start, stop (character offsets of the segment in the rendering), learn_start, learn_stop (of the
    part to learn from; equal where there is none). The system is no participant and stays the system for everyone. A
    null conv_id is a conversation of its own, control marks within texts and names are parted (``<|`` to ``< |``, with no
    way back, so that none can be taken for the format's), a text may be empty or of any length, null turns come first, turns of one number are ordered by speaker and
    text, and repeated rows are repeated turns. A conversation of the system alone has no perspective. Extra columns
    aren't read, whatever their names; an empty table gives no rows.
    """
    turns = stored(_turns(conversations), "turns")
    people = turns.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    views = turns.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    views = views.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(F.lit(START), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), _escaped(F.regexp_replace("speaker", r"\s", "_")))).otherwise(F.lit("")), F.lit("\n"))
    views = views.withColumn("role", role).withColumn("head", head)
    views = views.withColumn("segment", F.concat("head", _escaped(F.col("text")), F.lit(STOP))).withColumn("size", F.length("segment").cast("long"))
    order = [F.col("turn").asc_nulls_first(), "speaker", "text", "copy"]
    block = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK)
    views = views.withColumn("block", block)
    inner = Window.partitionBy("conv_id", "perspective", "block").orderBy(*order)
    before = F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    place = F.row_number().over(Window.partitionBy("conv_id", "perspective", "block", "turn").orderBy("speaker", "text", "copy")) - 1
    views = views.withColumn("before", before).withColumn("place", place)
    sums = views.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("held"))
    outer = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("held").over(outer), F.lit(0).cast("long")).alias("base"))
    joined = views.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.col("base") + F.col("before")
    learn = F.col("role") == "assistant"
    return joined.select(
        "conv_id", "perspective", "turn", "place", "speaker", "role", "segment", start.alias("start"), (start + F.col("size")).alias("stop"),
        F.when(learn, start + F.length("head")).otherwise(start).cast("long").alias("learn_start"), F.when(learn, start + F.col("size")).otherwise(start).cast("long").alias("learn_stop"),
    )


def assembled(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, text, mask (array of struct(start, stop)) of whole renderings, each gathered in one row."""
    rows = segments.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("start", "segment", "learn_start", "learn_stop"))).alias("s"))
    learn = F.transform(F.filter("s", lambda x: x["learn_stop"] > x["learn_start"]), lambda x: F.struct(x["learn_start"].alias("start"), x["learn_stop"].alias("stop")))
    return rows.select("conv_id", "perspective", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), learn.alias("mask"))
