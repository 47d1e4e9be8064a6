"""Versioned stage artifacts: fixed schemas, tolerant readers with dead letters, keyed sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1
CORRUPT = "_corrupt_record"
FAULT = "_fault"

CHUNK = "struct<chunk_id:string,document_id:string,title:string,source_url:string,text:string,sequence:int>"
SCHEMAS = {
    "raw": "schema_version int, document_id string, source_url string, title string, raw_path string, fetched_at string",
    "clean": "schema_version int, document_id string, source_url string, title string, markdown string, language string, cleaned_at string",
    "indexed": f"schema_version int, document_id string, source_url string, title string, chunks array<{CHUNK}>, indexed_at string",
    "catalog": "id string, sourceUrl string, title string, status string, chunkCount bigint, createdAt string, lastProcessedAt string, error string",
    "metrics": "process string, inputCount bigint, outputCount bigint, failureCount bigint, totalLatencyMs bigint, lastLatencyMs bigint, maxLatencyMs bigint, updatedAt string",
}
REQUIRED = {
    "raw": ("document_id", "source_url", "title", "raw_path"),
    "clean": ("document_id", "source_url", "title", "markdown"),
    "indexed": ("document_id", "source_url", "title", "chunks"),
    "catalog": ("id", "sourceUrl", "status", "chunkCount", "createdAt"),
    "metrics": ("process",),
}


def schema(kind: str) -> T.StructType:
    """The artifact's fields and the column for undecodable input."""
    own = T.StructType.fromDDL(SCHEMAS[kind])
    return own.add(CORRUPT, T.StringType())


def fault(kind: str) -> Column:
    """Why a row is no valid artifact; null if it is."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED[kind]]))
    reason = F.when(F.col(CORRUPT).isNotNull(), "undecodable")
    if "schema_version" in SCHEMAS[kind]:
        reason = reason.when(F.coalesce(F.col("schema_version"), F.lit(0)) != VERSION, "unsupported version")
    return reason.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))


def parse(lines: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows and dead letters (value, error) of JSON texts in `value`."""
    parsed = F.from_json("value", schema(kind), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = lines.select("value", parsed.alias("a")).select("value", "a.*").withColumn(FAULT, fault(kind))  # catalog rows have an error of their own
    bad = F.col(FAULT).isNotNull()
    return rows.filter(~bad).drop("value", CORRUPT, FAULT), rows.filter(bad).select("value", F.col(FAULT).alias("error"))


def read(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """parse() over the JSON files of a folder, one document a file."""
    return parse(spark.read.text(path, wholetext=True), kind)


def indexed_chunks(artifacts: DataFrame) -> DataFrame:
    """One row per chunk; of a repeated chunk id the last written artifact's row."""
    rows = artifacts.select("indexed_at", "document_id", F.inline("chunks").alias("chunk_id", "owner", "title", "source_url", "text", "sequence"))
    return latest(rows, "chunk_id", F.struct("indexed_at", "document_id", "sequence")).drop("indexed_at", "owner")


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of greatest order per key; maxima are summed up before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def catalog(lines: DataFrame) -> DataFrame:
    """Catalog rows of JSON texts in `value`, in id order; a text that is no valid row is left out, not an error."""
    return parse(lines, "catalog")[0].orderBy("id")


def points(chunks: DataFrame, dimension: int) -> DataFrame:
    """chunks whose embedding has the collection's dimension; any other one stops the job."""
    size = F.size("embedding")
    return chunks.withColumn("embedding", F.when(size == dimension, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("embedding of dimension "), size))))


def replay(dead: DataFrame, limit: int, order: str = "name") -> DataFrame:
    """At most `limit` dead letters, in name order, for another try."""
    return dead.orderBy(order).limit(limit)


def pending(queued: DataFrame, done: DataFrame, key: str = "document_id") -> DataFrame:
    """Queued rows that are not done; a rebuild waits until there are none."""
    return queued.join(done.select(key), key, "left_anti")
