"""Incremental delivery by topic."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schema import CURSOR


EMPTY = "nothing is stored yet"


def delivered(chunks: DataFrame, cursors: DataFrame, full: bool = False) -> DataFrame:
    """Chunks with mode: those after their topic's cursor, all of a topic without cursor, or all if full.

    A cursor of 0 counts as none. Rows without topic are never delivered.
    """
    known = cursors.where("cursor_ms > 0").groupBy("topic").agg(F.max("cursor_ms").alias("cursor_ms"))
    rows = chunks.where("topic is not null and topic <> ''").join(known, "topic", "left")
    mode = F.lit("full") if full else F.when(F.col("cursor_ms").isNull(), "first").otherwise("incremental")
    keep = F.lit(full) | F.col("cursor_ms").isNull() | (F.col("timestamp_ms") > F.col("cursor_ms"))
    return rows.withColumn("mode", mode).where(keep).drop("cursor_ms")


def advanced(sent: DataFrame, cursors: DataFrame) -> DataFrame:
    """The cursors after the delivery: the largest timestamp sent, if above 0; others stay. To be saved after delivery."""
    top = sent.groupBy("topic").agg(F.max(F.coalesce("timestamp_ms", F.lit(0))).alias("sent_ms")).where("sent_ms > 0")
    old = cursors.groupBy("topic").agg(F.max("cursor_ms").alias("cursor_ms"))
    return old.join(top, "topic", "full").select("topic", F.coalesce("sent_ms", "cursor_ms").alias("cursor_ms"))


def after_seq(log: DataFrame, last: int, limit: int | None = None) -> DataFrame:
    """Delivery by sequence number: no late row is lost, and with a limit the cursor is the last seq delivered."""
    rows = log.where(F.col("seq") > last).orderBy("seq")
    return rows.limit(limit) if limit else rows


def similar(topics: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, topic: topics that contain the wanted name or are contained in it, in any case. Both sides are lists of topics."""
    a, b = F.lower("wanted"), F.lower("topic")
    return wanted.join(topics.where("topic <> ''"), F.contains(b, a) | F.contains(a, b))


def nothing_new(chunks: DataFrame, cursors: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, message for topics that deliver nothing: known cursor, similar topics, else all topics, or that there are none."""
    sent = delivered(chunks, cursors).select(F.col("topic").alias("wanted")).distinct()
    empty = wanted.join(sent, "wanted", "left_anti")
    known = cursors.where("cursor_ms > 0").groupBy(F.col("topic").alias("wanted")).agg(F.max("cursor_ms").alias("cursor_ms"))
    topics = chunks.where("topic <> ''").select("topic").distinct()
    close = similar(topics, wanted).groupBy("wanted").agg(F.array_join(F.array_sort(F.collect_set("topic")), ", ").alias("close"))
    every = topics.agg(F.array_join(F.array_sort(F.collect_set("topic")), ", ").alias("every"))  # one row, a list of names
    rows = empty.join(known, "wanted", "left").join(close, "wanted", "left").join(F.broadcast(every))
    message = (
        F.when(F.col("cursor_ms").isNotNull(), "nothing new")
        .when(F.col("close").isNotNull(), F.concat(F.lit("similar: "), F.col("close")))
        .when(F.col("every") != "", F.concat(F.lit("topics: "), F.col("every")))
        .otherwise(EMPTY)
    )
    return rows.select("wanted", message.alias("message"))


def listing(chunks: DataFrame) -> DataFrame:
    """number, topic: the sorted topics, numbered from 1."""
    names = chunks.where("topic is not null and topic <> ''").select("topic").distinct()
    all_names = names.agg(F.array_sort(F.collect_set("topic")).alias("t"))  # a list of names, not of chunks
    return all_names.select(F.posexplode("t").alias("number", "topic")).select((F.col("number") + 1).cast("bigint").alias("number"), "topic")


def listing_text(chunks: DataFrame) -> DataFrame:
    """One row, text: the numbered topics, or that nothing is stored yet."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "topic"))), lambda x: F.concat(x["number"].cast("string"), F.lit(". **"), x["topic"], F.lit("**"))), "\n")
    return listing(chunks).agg(F.coalesce(F.nullif(lines, F.lit("")), F.lit(EMPTY)).alias("text"))


class CursorStore:
    """Cursors by topic, in versions under a directory that all executors share.

    A delivery starts from a version; its cursors are saved only after it, as the next version, and only if no other
    delivery has saved one meanwhile. What failed before that is delivered again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last one saved; 0 for none."""
        if not self._fs.exists(self._at("versions")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("versions"))]
        return max([0, *(int(n) for n in names if n.isdigit())])

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], CURSOR)
        stream = self._fs.open(self._at(f"versions/{version:012d}"))
        try:
            data = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.schema(CURSOR).parquet(f"{self.path}/{data}")

    def save(self, cursors: DataFrame, version: int) -> int:
        """Save the cursors as the version after the given one, which must still be the last."""
        data = f"data/{uuid.uuid4().hex}"
        cursors.select(*CURSOR.fieldNames()).write.parquet(f"{self.path}/{data}")
        new = f"versions/{version + 1:012d}"
        if self.version() != version or self._fs.exists(self._at(new)):
            raise RuntimeError(f"version {version} of the cursors is no longer the last")
        stream = self._fs.create(self._at(new), False)  # fails if another one was faster
        stream.write(data.encode())
        stream.close()
        return version + 1

    def commit(self, sent: DataFrame, version: int) -> int:
        """Advance the cursors of a version by what was delivered."""
        return self.save(advanced(sent, self.read(version)), version)
