"""The catalog as a stream of events, and the row of each document folded from them.

A stage says what it did and never reads or rewrites a row, so two stages that
end at once lose nothing.  Each field of a row has the value of the greatest
event that sets it, by (at, stage, value); a document's first event makes its
row, whatever stage it is from.  So the rows do not depend on the turn in which
events come, nor on how often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.sources.store import KeyedTable

FIELDS = {"source_url": "string", "title": "string", "status": "string", "chunk_count": "bigint", "error": "string"}
EVENT = "id string, at bigint, stage string, " + ", ".join(f"{f} {t}" for f, t in FIELDS.items())
ROW = "id string, created_at bigint, processed_at bigint, " + ", ".join(f"{f} {t}" for f, t in FIELDS.items())
NO_ERROR = ""  # an event with this error takes the former one back


def _row_fields() -> list:
    cleared = F.when(F.col("error") != NO_ERROR, F.col("error"))
    return [cleared.alias("error") if f == "error" else F.col(f) for f in FIELDS]


def current(events: DataFrame) -> DataFrame:
    """The rows of all events (EVENT), summed up before the shuffle."""
    turn = lambda f: F.when(F.col(f).isNotNull(), F.struct("at", "stage", f))
    newest = [F.max_by(F.col(f), turn(f)).alias(f) for f in FIELDS]
    return events.groupBy("id").agg(F.min("at").alias("created_at"), F.max("at").alias("processed_at"), *newest).select("id", "created_at", "processed_at", *_row_fields())


def states(events: DataFrame) -> DataFrame:
    """A stream of the rows that a stream of events (EVENT) changes; the state needs the RocksDB provider.

    The greatest events are found within a task before the shuffle, and the state of a
    document is read and written once a batch, however many events it has.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    events.sparkSession.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return current(events)


def catalog_table(spark, path: str, buckets: int = 64) -> KeyedTable:
    """The stored rows; of a document's rows the one of the latest batch counts."""
    return KeyedTable(spark, path, f"{ROW}, batch bigint", "id", "id", "batch", buckets)


def start(events: DataFrame, table: KeyedTable, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Folds a stream of events into the stored catalog; `every` as '2 seconds', else all that is there, then ends."""

    def batch(rows: DataFrame, number: int) -> None:
        table.merge(rows.withColumn("batch", F.lit(number).cast("bigint")), number, "catalog")

    writer = states(events).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
