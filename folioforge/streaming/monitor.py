"""Heartbeats and metrics of stages by a query listener, and stages that end after their current batch.

The listener runs in the driver, apart from the batches, and puts one small JSON
file for each event beside the others, in a folder of any file system; rows are
numbers and names of one event, never data.  A file is written under a name of its
own and then renamed, so readers see whole rows, and what a killed driver has
written stays.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

EVENT = "stage string, run string, kind string, at string, batch bigint, rows bigint, millis bigint, error string"


class _Folder:
    """Small files in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm, self._conf = path, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        target = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return target, target.getFileSystem(self._conf)

    def put(self, name: str, content: str) -> None:
        draft, fs = self._at(f".{name}")
        stream = fs.create(draft, True)
        stream.write(content.encode())
        stream.close()
        fs.rename(draft, self._at(name)[0])

    def numbers(self) -> set[int]:
        folder, fs = self._at("")
        return {int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()} if fs.exists(folder) else set()


class StageMonitor(StreamingQueryListener):
    """Writes a row (EVENT) for each start, batch and end of the named queries of a session; unnamed ones are left out."""

    def __init__(self, spark: SparkSession, path: str):
        self._folder, self._names = _Folder(spark, path), {}

    def _write(self, run: str, kind: str, at: str, **more: object) -> None:
        if self._names.get(run):
            row = {"stage": self._names[run], "run": run, "kind": kind, "at": at, **more}
            self._folder.put(f"{uuid.uuid4().hex}.json", json.dumps(row))

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name
        self._write(str(event.runId), "started", event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._names.setdefault(str(p.runId), p.name)
        self._write(str(p.runId), "batch", p.timestamp, batch=p.batchId, rows=p.numInputRows, millis=p.durationMs.get("triggerExecution", 0))

    def onQueryIdle(self, event) -> None:
        self._write(str(event.runId), "idle", event.timestamp)

    def onQueryTerminated(self, event) -> None:
        now = time.strftime("%Y-%m-%dT%H:%M:%S.000Z", time.gmtime())
        self._write(str(event.runId), "ended", now, error=event.exception)


def events(spark: SparkSession, path: str) -> DataFrame:
    """All rows that monitors have written to a folder."""
    return spark.read.schema(EVENT).json(path)


def heartbeats(rows: DataFrame) -> DataFrame:
    """Per stage the newest sign of life and whether its newest run still goes on; rows: events()."""
    runs = rows.groupBy("stage", "run").agg(F.min("at").alias("began"), F.max("at").alias("last_seen"), F.max(F.col("kind") == "ended").alias("ended"), F.max("error").alias("error"))
    newest = runs.groupBy("stage").agg(F.max(F.struct("began", "last_seen", "run", "ended", "error")).alias("r"))
    return newest.select("stage", F.col("r.last_seen").alias("last_seen"), (~F.col("r.ended")).alias("alive"), F.col("r.error").alias("error"))


def metrics(rows: DataFrame) -> DataFrame:
    """Per stage its batches, rows and time; a batch that was run again counts once, with its newest run."""
    once = rows.filter("kind = 'batch'").groupBy("stage", "batch").agg(F.max(F.struct("at", "rows", "millis")).alias("b"))
    return once.groupBy("stage").agg(
        F.count_if(F.col("b.rows") > 0).alias("batches"), F.sum("b.rows").alias("rows"), F.sum("b.millis").alias("total_millis"), F.max("b.millis").alias("max_millis")
    )


def unfinished(spark: SparkSession, checkpoint: str) -> list[int]:
    """Batches that a query has claimed (their offsets are written) and not committed."""
    claimed, done = (_Folder(spark, f"{checkpoint}/{n}").numbers() for n in ("offsets", "commits"))
    return sorted(n for n in claimed - done if n > max(done, default=-1))


def drain(query: StreamingQuery, checkpoint: str, again: Callable[[], StreamingQuery], timeout: float = 600.0) -> int:
    """Ends a stage between two batches and returns the number of its last committed one (-1: none).

    The batch that runs is waited for.  If the next begins before the query has
    stopped, its rows are claimed; then `again`, which starts the same stage over
    what there is (availableNow), runs it to its end.  So no claimed row is left over.
    """
    spark, until = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.getActiveSession(), time.monotonic() + timeout
    while query.isActive and query.status["isTriggerActive"]:
        if time.monotonic() > until:
            raise TimeoutError(f"the batch of {query.name or query.id} runs for over {timeout} s")
        time.sleep(0.02)
    query.stop()
    if unfinished(spark, checkpoint):
        again().awaitTermination()
    return max(_Folder(spark, f"{checkpoint}/commits").numbers(), default=-1)
