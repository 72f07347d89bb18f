"""Chat formatting by rotating the perspective: each speaker in turn is the assistant.

For every speaker of a conversation the dialogue is rendered with that speaker's turns as the assistant's and
all other turns as those of named users; turns of a narrator (``system``) stay what they are. The mask holds
the spans of the assistant's words, which are the ones to train on.

A conversation may hold a third of all rows, so turns get their position from ranges over conversation *and*
order (a hot conversation is spread over many tasks), and a rendering comes in pages of ``page_turns`` turns,
keyed (conversation, speaker, page). A conversation of P speakers and T turns makes P renderings of T turns: that is the
output asked for. DataFrame functions only.

Defined results: a NULL text is empty; a NULL role is the speaker ``unknown``; a NULL turn comes last; ties of turn go
by role, then text; repeated rows are repeated turns; NULL conversations are one conversation; one with narrator turns
only has no speaker and gives no row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.frames import checkpointed

OPEN, CLOSE = "<|", "|>\n"
END = "<|end|>\n"


def positions(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Add ``position`` (from 0) of each row within ``key``, for keys of any size.

    Rows are range-partitioned on key and order and written once, as the limits come from a sample; each range counts
    its rows per key, and the counts of the ranges before (one row per range and key that crosses its
    border, so at most two per range) are added.
    """
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = (df.repartitionByRange(ranges, F.col(key), *order)
              .withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", key).orderBy(*order)
    ranged = checkpointed(ranged.withColumn("_inside", F.row_number().over(inside) - 1))
    ends = ranged.groupBy("_range").agg(F.min(F.struct(key)).alias("low"), F.max(F.struct(key)).alias("high"))
    counts = ranged.groupBy("_range", key).agg(F.count("*").alias("rows"))
    border = (counts.join(ends, "_range")
              .where(F.struct(key).eqNullSafe(F.col("low")) | F.struct(key).eqNullSafe(F.col("high"))))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (border.withColumn("_before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
              .where("_before > 0").select(F.col("_range").alias("_r"), F.col(key).alias("_k"), "_before"))
    joined = ranged.join(before, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.withColumn("position", F.col("_inside") + F.coalesce("_before", F.lit(0))).drop(
        "_range", "_inside", "_r", "_k", "_before")


def _head(role: Column, speaker: Column, narrators: list[str]) -> Column:
    return (F.when(role == speaker, F.lit(f"{OPEN}assistant{CLOSE}"))
            .when(role.isin(narrators), F.concat(F.lit(OPEN), role, F.lit(CLOSE)))
            .otherwise(F.concat(F.lit(f"{OPEN}user name="), role, F.lit(CLOSE))))


def rotate_perspectives(turns: DataFrame, page_turns: int, conversation: str = "conv_id", turn: str = "turn",
                        role: str = "role", text: str = "text",
                        narrators: tuple[str, ...] = ("system",)) -> DataFrame:
    """Columns conv_id, speaker, page, n_turns, n_target_turns, text, mask.

    ``mask`` is an array of (start, stop) in characters of ``text``, from 0, the stop not included. A speaker's mask is
    empty on a page without a turn of theirs.
    """
    rows = turns.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = positions(rows, "conv", [F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("text"),
                                      F.col("text")])
    page = F.floor(F.col("position") / page_turns).alias("page")
    pages = (placed.groupBy("conv", page)
             .agg(F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("list")))
    speakers = (placed.where(~F.col("role").isin(list(narrators))).groupBy("conv", "role").count()
                .groupBy("conv").agg(F.sort_array(F.collect_list("role")).alias("speakers")))
    speakers = speakers.withColumnRenamed("conv", "_conv")
    per_speaker = (pages.join(speakers, F.col("conv").eqNullSafe(F.col("_conv")))
                   .withColumn("speaker", F.explode("speakers")))

    def render(state, message):
        head = _head(message["role"], F.col("speaker"), list(narrators))
        start = state["at"] + F.length(head)
        stop = start + F.length(message["text"])
        own = message["role"] == F.col("speaker")
        span = F.array(F.struct(start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop")))
        return F.struct((stop + len(END)).cast("bigint").alias("at"),
                        F.when(own, F.concat(state["mask"], span)).otherwise(state["mask"]).alias("mask"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("mask"))
    rendered = F.concat_ws("", F.transform("list", lambda m: F.concat(
        _head(m["role"], F.col("speaker"), list(narrators)), m["text"], F.lit(END))))
    return per_speaker.select(
        F.col("conv").alias(conversation), "speaker", F.col("page").cast("bigint").alias("page"),
        F.size("list").cast("bigint").alias("n_turns"),
        rendered.alias("text"), F.aggregate("list", start, render)["mask"].alias("mask")).select(
        conversation, "speaker", "page", "n_turns", F.size("mask").cast("bigint").alias("n_target_turns"),
        "text", "mask")
