"""Chat formatting by perspective rotation of multi-party dialogues.

For every participant of a dialogue the dialogue is rendered once more: that speaker's turns are the
assistant's, all others are turns of named users, system turns stay system turns, and the loss mask
covers exactly the assistant's words and end marks.  Participants are the distinct speakers other than
``system``.  Turns follow (turn, role, text), nulls first.

A dialogue is cut into segments of at most ``segment`` turns, so that no row grows without bound, and
positions come from a range partitioning that deals a long dialogue to several tasks, with the offsets
of the earlier parts joined from a table of one row for each dialogue and part.  Turns are gathered to
segments once; only then does each segment meet the speakers of its dialogue, so that turns are not
shuffled once more for every participant.

Defined cases: a null or blank role is the speaker ``unknown``; a null text is an empty turn; repeated
rows are turns of their own; a null dialogue id is a dialogue; a dialogue of system turns only has no
participants and no rows; an empty table gives no rows; other columns are ignored.  ``<|`` inside a text
or a role is written ``< |``, and a line break inside a role is a blank, so that neither can forge a turn or a mark; roles
that are the same after that are one speaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomix.storage import Scratch

SEGMENT = 256
START, END = "<|im_start|>", "<|im_end|>"
#: Characters that break a line, in the order of their code points.
BREAKS = "\n\v\f\r\x85\u2028\u2029"


def _unmarked(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """conv_id, speaker, segment, n_turns, n_target (turns of the speaker), text, mask (start:end, ...)."""
    scratch = Scratch(turns.sparkSession, "chat")
    named = F.trim(_unmarked(F.translate(F.col(role), BREAKS, " " * len(BREAKS))))
    speaker = F.coalesce(F.nullif(named, F.lit("")), F.lit("unknown"))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), speaker.alias("role"), _unmarked(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    order = ["turn", "role", "words", "tie"]
    dealt = scratch.write(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))

    parts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.write(parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))

    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    placed = dealt.withColumn("own", own).join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    placed = placed.select("conv_id", "role", "words", (F.col("before") + F.col("own") - 1).alias("at"))
    segments = placed.groupBy("conv_id", F.floor(F.col("at") / segment).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("at", "role", "words"))).alias("turns"))

    speakers = scratch.write(dealt.filter("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct())
    views = segments.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))

    def seen(x: Column) -> Column:
        mine = x["role"] == F.col("speaker")
        head = F.when(mine, "assistant\n").when(x["role"] == "system", "system\n").otherwise(F.concat(F.lit("user name="), x["role"], F.lit("\n")))
        return F.struct(F.concat(F.lit(START), head).alias("head"), F.concat(x["words"], F.lit(END + "\n")).alias("body"), mine.alias("mine"))

    out = views.withColumn("t", F.transform("turns", seen))
    return out.select("conv_id", "speaker", "segment", F.size("t").cast("long").alias("n_turns"), F.size(F.filter("t", lambda x: x["mine"])).cast("long").alias("n_target"), F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"])), "").alias("text"), _mask("t").alias("mask"))


def _mask(turns: str) -> Column:
    """The code point ranges of the speaker's words and end marks, without the last line break."""

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        span = F.concat(start.cast("string"), F.lit(":"), (end - 1).cast("string"))
        return F.struct(end.alias("at"), F.when(x["mine"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda a: F.array_join(a["spans"], ","))
