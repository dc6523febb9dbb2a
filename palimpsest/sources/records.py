"""Record requests: captured messages into chunk rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import record_chunk_id, with_role
from palimpsest.operators.chunking import chunk_message
from palimpsest.schema import DEFAULT_PLATFORM, DEFAULT_TOPIC, RECORD

#: Turns of one capture that are ranked in one task.
TURNS = 500


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def accepted(captures: DataFrame, messages: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, n_messages, status of every request: 202, or 400 without messages."""
    counted = messages.groupBy(key).agg(F.count("*").alias("n_messages"))
    n = F.coalesce("n_messages", F.lit(0))
    return captures.select(key).join(counted, key, "left").select(key, n.alias("n_messages"), F.when(n > 0, 202).otherwise(400).alias("status"))


def with_ocr(records: DataFrame, recognise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Text recognised in the image becomes the last message, of role ocr; without recogniser or text nothing changes."""
    if recognise is None:
        return records
    text = F.trim(recognise(F.unbase64("imageBase64")))
    extra = F.when(F.coalesce(text, F.lit("")) != "", F.array(F.struct(F.lit("ocr").alias("role"), text.alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return records.withColumn("messages", F.concat("messages", extra))


def message_chunks(messages: DataFrame) -> DataFrame:
    """message_id, capture_id, turn, pos, document of every message with text."""
    rows = messages.where("text is not null")
    return rows.select("message_id", "capture_id", "turn", F.posexplode(chunk_message(with_role(F.col("role"), F.col("text")))).alias("pos", "document"))


def record_chunks(captures: DataFrame, messages: DataFrame, now_ms: int, with_document: bool = True) -> DataFrame:
    """Chunk rows of the captures, numbered through all messages of a capture; defaults are filled in.

    A message is chunked once and shuffled once, by capture and TURNS turns; the chunks before it are counted within these
    parts and by part, and a capture's columns come to its parts, so one capture may hold any share of the messages.
    """
    docs = chunk_message(with_role(F.col("role"), F.col("text")))
    rows = messages.where("text is not null and capture_id is not null and turn is not null")
    rows = rows.select("capture_id", F.floor(F.col("turn") / TURNS).alias("__part"), "turn", "message_id", (docs if with_document else F.size(docs)).alias("__docs")).where("__part is not null").repartition("capture_id", "__part")
    n = F.size("__docs") if with_document else F.col("__docs")
    # Both branches read the same columns of one shuffle, so that it runs once: that is what the second aggregate is for.
    sizes = rows.groupBy("capture_id", "__part").agg(F.sum(n).alias("__size"), F.max(F.struct("turn", "message_id")).alias("__last")).where("__last is not null")
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("capture_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.select("capture_id", "__part", before.alias("__before")).join(captures, "capture_id")
    within = Window.partitionBy("capture_id", "__part").orderBy("turn", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum(n).over(within), F.lit(0))).drop("turn", "message_id").join(parts, ["capture_id", "__part"])
    one = F.posexplode("__docs") if with_document else F.posexplode(F.when(F.col("__docs") > 0, F.sequence(F.lit(1), F.col("__docs"))))
    rows = rows.select(*captures.columns, "__before", "__within", one.alias("__pos", "document"))
    index = (F.col("__before") + F.col("__within") + F.col("__pos")).cast("bigint")
    out = rows.select(
        record_chunk_id(F.col("source_url"), index).alias("id"), "document", F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.coalesce("platform", F.lit(DEFAULT_PLATFORM)).alias("platform"), F.coalesce("topic", F.lit(DEFAULT_TOPIC)).alias("topic"),
        F.coalesce("timestamp_ms", F.lit(now_ms)).cast("bigint").alias("timestamp_ms"), F.lit(None).cast("string").alias("file_path"), "capture_id",
    )
    return out if with_document else out.drop("document")
