"""The chunk store: an append-only change log in Parquet, and views of it.

Log rows have seq, op (U or D) and the chunk's columns. The latest row of an id counts; a D row hides it. A batch is known by
its writer and its number. It first takes the next number of the whole store, by creating a file that must not exist yet,
and is read only when that file names its data; so writers share a store, and a batch that is written again keeps its place
in the order. Within a batch the order is that of a column, if one is given. Compaction writes a new version directory and
then moves a pointer, so nothing being read is overwritten.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.joins import salted
from palimpsest.schema import CHUNK


def latest(log: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row of each key. Rows of one key are combined before the shuffle, so a frequent key costs no more."""
    rest = [c for c in log.columns if c not in (key, order)]
    picked = log.groupBy(key).agg(F.max_by(F.struct(order, *rest), order).alias("__row"))
    return picked.select(F.col(key), *(F.col("__row")[c].alias(c) for c in (order, *rest))).select(*log.columns)


def live(log: DataFrame) -> DataFrame:
    return latest(log).where("op = 'U'").drop("op")


def stale(chunks: DataFrame) -> DataFrame:
    """Chunks left over from a longer, older capture of their source: older than the source's newest chunk."""
    named = chunks.where("source_url <> ''")
    newest = named.groupBy("source_url").agg(F.max("timestamp_ms").alias("__newest"))
    return salted(named, newest, "source_url", "id").where("timestamp_ms < __newest").select(*chunks.columns)


def without_stale(chunks: DataFrame) -> DataFrame:
    return chunks.join(stale(chunks).select("id"), "id", "left_anti")


def delete_topic(chunks: DataFrame, topic: str) -> DataFrame:
    """What is left; the topic counts literally, the default one too. Rows without topic stay."""
    return chunks.where(~F.col("topic").eqNullSafe(F.lit(topic)))


def deleted_count(chunks: DataFrame, topic: str) -> DataFrame:
    return chunks.where(F.col("topic") == topic).agg(F.count_distinct("id").alias("deleted"))


class ChunkStore:
    """Change log under a directory that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._text = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        self._fs = self._at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str, default: dict) -> dict:
        if not self._fs.exists(self._at(name)):
            return default
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._text(stream))
        finally:
            stream.close()

    def _create(self, name: str, value: dict) -> bool:
        """Write a new file; False if it is there already."""
        try:
            stream = self._fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or self._fs.exists(self._at(name)):
                return False
            raise
        stream.write(json.dumps(value).encode())
        stream.close()
        return True

    def _replace(self, name: str, value: dict) -> None:
        new = f"{name}.{uuid.uuid4().hex}"
        self._create(new, value)
        self._fs.delete(self._at(name), False)
        self._fs.rename(self._at(new), self._at(name))

    def _pointer(self) -> dict:
        """base: directory of the compacted rows; upto: last number in it; open: earlier numbers that weren't done; writers: last batch of each in it."""
        return self._read("CURRENT", {"base": None, "upto": -1, "open": [], "writers": {}})

    def _commits(self) -> dict[int, dict]:
        """By number the batches that aren't in the base."""
        at = self._pointer()
        if not self._fs.exists(self._at("commits")):
            return {}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("commits")))
        numbers = [int(n) for n in names if n.isdigit() and (int(n) > at["upto"] or int(n) in at["open"])]
        return {n: self._read(f"commits/{n:012d}", {}) for n in numbers}

    def append(self, chunks: DataFrame, batch: int, op: str = "U", writer: str = "", order: str | None = None) -> bool:
        """Write a batch. The same batch of the same writer again replaces itself; once compacted it stays, and False is returned.

        order: a column of whole numbers that rises with arrival. Without it rows of one id in one batch have no order but a fixed one.
        """
        pointer = self._pointer()
        if batch <= pointer["writers"].get(writer, -1):
            return False
        commits = self._commits()
        mine = next((n for n, c in commits.items() if c.get("writer") == writer and c.get("batch") == batch), None)
        while mine is None:
            n = max([pointer["upto"], *self._commits()]) + 1
            if self._create(f"commits/{n:012d}", {"writer": writer, "batch": batch}):
                mine = n
        data = f"log/{mine:012d}-{uuid.uuid4().hex}"
        columns = [F.col(c) for c in CHUNK.fieldNames()]
        place = F.col(order).cast("bigint") if order else F.lit(0).cast("bigint")
        rows = chunks.select(*columns, F.lit(op).alias("op"), F.lit(mine).cast("bigint").alias("batch"), place.alias("position"), F.xxhash64(*columns).alias("tie"))
        rows.write.parquet(f"{self.path}/{data}")
        self._replace(f"commits/{mine:012d}", {"writer": writer, "batch": batch, "data": data})
        return True

    def log(self) -> DataFrame:
        return self._log(self._pointer(), self._commits())

    def _log(self, pointer: dict, commits: dict[int, dict]) -> DataFrame:
        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in CHUNK)}, op string, batch bigint, position bigint, tie bigint"
        parts = [c["data"] for c in commits.values() if "data" in c] + ([pointer["base"]] if pointer["base"] else [])
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{x}" for x in parts)) if parts else self.spark.createDataFrame([], schema)
        return rows.withColumn("seq", F.struct("batch", "position", "tie"))

    def read(self) -> DataFrame:
        return live(self.log().drop("batch", "position", "tie")).drop("seq")

    def delete(self, topic: str, batch: int, writer: str = "") -> int:
        """Hide a topic's chunks; how many there were. The topic may be URL-encoded by the caller's decoded_topic()."""
        gone = self.read().where(F.col("topic") == topic)
        n = gone.count()
        if not n:
            raise KeyError(f"no topic {topic!r}")
        self.append(gone, batch, "D", writer)
        return n

    def compact(self) -> None:
        """Live rows as a new base; the batches in it are then no longer read, and no longer replaced."""
        pointer, commits = self._pointer(), self._commits()
        done = {n: c for n, c in commits.items() if "data" in c}
        if not done:
            return
        upto = max([pointer["upto"], *done])
        writers = dict(pointer["writers"])
        for c in done.values():
            writers[c["writer"]] = max(writers.get(c["writer"], -1), c["batch"])
        base = f"base-{uuid.uuid4().hex}"
        kept = live(self._log(pointer, done).withColumns({"b": F.col("batch"), "p": F.col("position"), "t": F.col("tie")}).drop("batch", "position", "tie"))
        kept.select(*CHUNK.fieldNames(), F.lit("U").alias("op"), F.col("b").alias("batch"), F.col("p").alias("position"), F.col("t").alias("tie")).write.parquet(f"{self.path}/{base}")
        still = [n for n in commits if n not in done and n < upto]
        self._replace("CURRENT", {"base": base, "upto": upto, "open": still, "writers": writers})
