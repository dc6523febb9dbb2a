"""Streams: captures into the store, cursors as state, jobs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from palimpsest.operators.store import ChunkStore
from palimpsest.schema import JOB_TTL_MS


def into_store(stream: DataFrame, store: ChunkStore, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, order: str | None = None) -> StreamingQuery:
    """Append every micro-batch of chunk rows to the store; a replayed batch replaces itself.

    The writer is the stream, which its checkpoint identifies: another stream, or this one with a new checkpoint, is another.
    """

    def write(batch: DataFrame, number: int) -> None:
        writer = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        store.append(transform(batch), number, writer=writer, order=order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cursor_stream(stream: DataFrame, key: str, ts_ms: str) -> DataFrame:
    """key, n, cursor_ms: what each micro-batch delivers past the key's cursor, which is kept as state.

    Rows at or before the cursor are late and not delivered, as with a cursor of timestamps.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        cursor, n, top = state.get[0] if state.exists else 0, 0, 0
        for f in frames:
            fresh = f[ts_ms][f[ts_ms] > cursor]
            n, top = n + len(fresh), max(top, int(fresh.max()) if len(fresh) else 0)
        if n:
            state.update((max(cursor, top),))
            yield pd.DataFrame({key: [group[0]], "n": [n], "cursor_ms": [max(cursor, top)]})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, F.col(ts_ms).cast("bigint").alias(ts_ms)).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, cursor_ms bigint", "cursor bigint", "append", "NoTimeout")


def jobs(started: DataFrame, now_ms: int, ttl_ms: int = JOB_TTL_MS) -> DataFrame:
    """job_id, status, done, total, percent of jobs (job_id, done, total, error, ended_ms) that haven't expired."""
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("ended_ms").isNotNull(), "done").otherwise("processing")
    percent = F.when(F.col("total") > 0, F.floor(F.col("done") * 100.0 / F.col("total") + 0.5)).otherwise(0).cast("bigint")
    alive = F.col("ended_ms").isNull() | (F.col("ended_ms") + ttl_ms > now_ms)
    return started.where(alive).select("job_id", status.alias("status"), "done", "total", percent.alias("percent"))


def new_job_id() -> str:
    """Eight letters and digits."""
    return uuid.uuid4().hex[:8]


class JobFeed(StreamingQueryListener):
    """Progress of streams as jobs: rows (job_id, done, total, error, ended_ms) as jobs() takes them, one for each run of a stream.

    Only counts come to the driver. total is what has been read so far, as a stream has no end that is known before.
    """

    def __init__(self, clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.clock, self.rows = clock, {}

    def _row(self, run) -> dict:
        """A stream that ran before the feed was added is a job from its next event on."""
        return self.rows.setdefault(str(run), {"job_id": new_job_id(), "done": 0, "total": 0, "error": None, "ended_ms": None})

    def onQueryStarted(self, event) -> None:
        self._row(event.runId)

    def onQueryProgress(self, event) -> None:
        row = self._row(event.progress.runId)
        row["done"] = row["total"] = row["total"] + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        row = self._row(event.runId)
        row["error"], row["ended_ms"] = event.exception, self.clock()

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(r.values()) for r in self.rows.values()]
        return spark.createDataFrame(rows, "job_id string, done bigint, total bigint, error string, ended_ms bigint")


def drain(query: StreamingQuery) -> dict:
    """Wait for a stream to end and return its last progress."""
    query.awaitTermination()
    return dict(query.lastProgress or {})


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
