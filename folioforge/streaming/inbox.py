"""Stages as micro-batches over folders of JSON artifacts.

A stage reads an inbox, writes valid rows' results and dead letters under the
batch's number, and so repeats a batch without doubling it.  Readers take the
latest row per key, which makes redelivery harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.sources import artifacts

Stage = Callable[[DataFrame], DataFrame]


def start_stage(spark: SparkSession, inbox: str, kind: str, stage: Stage, out: str, dead: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs `stage` over new files of the inbox; `every`: as '2 seconds', else all that is there, then ends."""
    lines = spark.readStream.option("wholetext", True).text(inbox)

    def batch(rows: DataFrame, number: int) -> None:
        good, bad = artifacts.parse(rows, kind)
        stage(good).write.mode("overwrite").parquet(f"{out}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def results(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The latest row per key of a stage's output."""
    return artifacts.latest(spark.read.parquet(out), key, F.col("batch")).drop("batch")


def replay(spark: SparkSession, dead: str, inbox: str, limit: int) -> int:
    """Puts at most `limit` dead letters back into the inbox as new files; returns how many."""
    rows = spark.read.parquet(dead).select("value").distinct().orderBy("value").limit(limit).cache()
    n = rows.count()
    if n:
        rows.repartition(n).write.mode("append").text(inbox)
    rows.unpersist()
    return n


def running_metrics(events: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """A memory table of cumulative counts and latencies per process of a stream (process, ok, latency)."""
    summed = events.groupBy("process").agg(
        F.count("*").alias("input_count"), F.count_if("ok").alias("output_count"), F.count_if(~F.col("ok")).alias("failure_count"),
        F.sum("latency").alias("total_latency"), F.max("latency").alias("max_latency"),
    )
    writer = summed.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def progress(query: StreamingQuery) -> dict[str, object]:
    """The heartbeat of a stage: its last micro-batch."""
    last = query.lastProgress
    return {"alive": query.isActive, "timestamp": last["timestamp"] if last else None, "rows": last["numInputRows"] if last else 0}
