"""Chat formatting by rotation of perspectives.

For every participant of a conversation, the dialogue is rendered with that
speaker as the assistant and the others as named users; system turns stay system
turns. A mask lists the spans of characters to train on: the contents of the
speaker's own turns, each with its end mark.

A conversation of any length is rendered in segments of SEGMENT turn numbers,
each a row of its own, so that no task gathers a whole conversation. `offset` is
where a segment starts in the dialogue; the concatenation of the segments in
order is the dialogue, and spans are relative to their segment.

Defined cases: exact repeats of a turn are one turn; turns with equal numbers
follow role, then text; a null or blank role is the participant "unknown"; a null
text is empty; a conversation of system turns alone is rendered once, with no
speaker; marks within texts are broken by a zero-width space, so they can't be
taken for turns; extra columns are ignored; a null turn number sorts first, in segment null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import same, table

SEGMENT = 256
#: Marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _safe(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<\u200b|$1|>")


def turns_of(conversations: DataFrame) -> DataFrame:
    role = F.coalesce(F.nullif(F.trim(F.col("role").cast("string")), F.lit("")), F.lit("unknown"))
    turn = F.col("turn").cast("long")
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), _safe(F.regexp_replace(role, r"\s+", " ")).alias("role"), _safe(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    return own.distinct().withColumn("segment", F.floor(F.col("turn") / SEGMENT))


def render(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, speaker, segment, offset, n_turns, text, mask) for each participant and segment."""
    turns = turns_of(conversations)
    # a segment's turns in order, once for all perspectives
    parts = turns.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = turns.select("conv_id", F.when(F.col("role") != SYSTEM, F.col("role")).alias("speaker")).distinct()
    some = speakers.groupBy("conv_id").agg(F.max("speaker").alias("any"))
    # a conversation of system turns alone keeps its one null speaker
    speakers = speakers.alias("s").join(some.alias("m"), same("s", "m", "conv_id")).filter(F.col("s.speaker").isNotNull() | F.col("m.any").isNull()).select("s.conv_id", "s.speaker")

    def head(t: Column) -> Column:
        own = F.coalesce(t["role"] == F.col("speaker"), F.lit(False))
        who = F.when(own, F.lit("assistant")).when(t["role"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit(START), who, F.lit("\n"))

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), F.coalesce(t["role"] == F.col("speaker"), F.lit(False)).alias("own")))
    rows = parts.alias("p").join(speakers.alias("s"), same("p", "s", "conv_id")).select("p.conv_id", "s.speaker", "p.segment", "p.turns").withColumn("pieces", pieces)
    sizes = F.transform("pieces", lambda x: F.struct(F.length(x["head"]).alias("h"), F.length(x["body"]).alias("b"), x["own"].alias("own")))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["h"]
        end = start + x["b"]
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(x["own"], F.concat(s["mask"], span)).otherwise(s["mask"]).alias("mask"))

    laid = rows.select("conv_id", "speaker", "segment", F.size("pieces").cast("long").alias("n_turns"), F.concat_ws("", F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit("\n")))).alias("text"), F.aggregate(sizes, empty, step).alias("m"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    # offsets sum the lengths of segments; texts don't go through the window
    lengths = laid.select("conv_id", "speaker", "segment", F.col("m.at").alias("len")).withColumn("offset", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long"))
    return laid.alias("l").join(lengths.alias("o"), same("l", "o", "conv_id", "speaker", "segment")).select("l.conv_id", "l.speaker", "l.segment", "o.offset", "l.n_turns", "l.text", F.col("l.m.mask").alias("mask"))


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))
