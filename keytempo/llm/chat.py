"""Multi-party perspective rotation: every participant's view of a dialogue as training text, with loss masks.

Per conversation and participant, that speaker's messages become ``assistant`` messages, other speakers' become messages
of named users, and ``system`` messages stay.  Only the assistant messages are trained on.  The rendering is cut into
segments of ``BLOCK`` turn numbers, so a very long conversation is never gathered in one row; an ordinary one is one segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytempo.llm.common import stored, table

#: Turn numbers per segment, and messages above which a segment is cut into its turns, and a turn into parts.
BLOCK, MOST = 64, 1024
OPEN, CLOSE = "<|start|>", "<|end|>\n"


def in_order(rows: DataFrame, group: list[str], order: list[str], into: str) -> DataFrame:
    """Number the rows of each group from 0 in their order, however large a group is.

    Rows are dealt by ranges of group and order; a row per group and range gives what lies before it.
    """
    by = [*group, *order]
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()),
                    "ordered").withColumn("_p", F.shiftright("_id", 33))
    totals = placed.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_p").alias("_q"), "_first",
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    on = F.col("_p") == F.col("_q")
    for c in group:
        on &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return placed.join(before, on).withColumn(into, F.col("_before") + F.col("_id") - F.col("_first")).select(*rows.columns, into)


def rotate(conversations: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """One row per conversation, perspective and segment.

    Columns: conv_id, perspective, segment (first turn number), part, n_messages, n_trained, rendered, mask (character
    ranges [start, end) of ``rendered`` that are trained on: assistant content with its end mark).

    Order is (turn, speaker, text), null turns first in a segment of their own (null).  A row repeated in all four columns
    is one message.  A null or blank role is the speaker ``unknown``; a null text is empty.  A null conv_id is a conversation
    like any other.  ``<|`` inside texts and names is written ``< |``, so no message can forge a mark; line ends in names
    become spaces.  Conversations of system messages only have no participant and give no row.  A segment with more than
    ``most`` messages becomes one segment per turn number, and a turn number with more is cut in order into parts of ``most``
    messages.  Other columns are ignored.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    role = F.trim(F.regexp_replace(F.coalesce("role", F.lit("")), r"[\x00-\x20]+", " "))
    speaker = safe(F.when(role == "", "unknown").otherwise(role))
    messages = (conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"),
                                     safe(F.coalesce("text", F.lit(""))).alias("content"))
                .distinct().withColumn("block", F.floor(F.col("turn") / block) * block))
    turns = messages.groupBy("conv_id", "block", "turn").agg(F.count(F.lit(1)).alias("n"))
    # Only crowded blocks are looked up: at most rows / most of them.
    crowded = (turns.groupBy(F.col("conv_id").alias("_c"), F.col("block").alias("_k")).agg(F.sum("n").alias("_all"))
               .where(F.col("_all") > most))
    parts = (turns.join(crowded, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_k")), "left_semi")
             .select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.ceil(F.col("n") / most).alias("_parts")))
    messages = messages.join(
        parts, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left")
    split = F.col("_parts").isNotNull()
    messages = messages.withColumn("segment", F.when(split, F.col("turn")).otherwise(F.col("block")))
    columns = ["conv_id", "turn", "speaker", "content", "segment"]
    large = in_order(messages.where(F.col("_parts") > 1).select(*columns), ["conv_id", "turn"], ["speaker", "content"], "_place")
    messages = (messages.where(F.coalesce("_parts", F.lit(1)) == 1).select(*columns, F.lit(0).alias("part"))
                .unionByName(large.select(*columns, F.expr(f"int(_place div {most})").alias("part"))))
    segments = (messages.groupBy("conv_id", "segment", "part")
                .agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "content"))).alias("messages")))
    people = (messages.where(F.col("speaker") != "system").select(F.col("conv_id").alias("_c"), "speaker").distinct()
              .withColumnRenamed("speaker", "perspective"))
    views = segments.join(people, F.col("conv_id").eqNullSafe(F.col("_c")), "inner")

    me = F.col("perspective")
    head = lambda m: (F.when(m["speaker"] == me, "assistant")
                      .when(m["speaker"] == "system", "system")
                      .otherwise(F.concat(F.lit("user name="), m["speaker"])))
    views = views.withColumn("_pieces", F.transform("messages", lambda m: F.struct(
        F.concat(F.lit(OPEN), head(m), F.lit("\n")).alias("head"),
        F.concat(m["content"], F.lit(CLOSE)).alias("body"), (m["speaker"] == me).alias("train"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["train"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    return views.select(
        "conv_id", "perspective", "segment", "part", F.size("messages").alias("n_messages"),
        F.size(F.filter("_pieces", lambda p: p["train"])).alias("n_trained"),
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.aggregate("_pieces", start, step)["mask"].alias("mask"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask is given as text ``start-end,start-end``."""
    views = rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return views.withColumn("mask", F.array_join(spans, ","))
