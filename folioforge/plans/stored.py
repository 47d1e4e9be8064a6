"""The knowledge base as stored tables that grow by batches of clean documents.

A batch brings documents with the time at which they were cleaned.  Their chunks
replace those of earlier versions; vertices and edges are made from the chunks
that are stored then, so a late or repeated batch changes nothing.  A vertex has
the properties of its greatest (indexed_at, chunk_id); edges belong to their
document and go with its chunks.  Each table is merged by batch number, so a
batch that was cut short is taken up where it was left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.functions import vectors
from folioforge.operators import chunking, entities
from folioforge.plans.knowledge_base import Embedder, KnowledgeBase
from folioforge.sources import artifacts
from folioforge.sources.store import KeyedTable

CHUNKS = "document_id string, chunk_id string, sequence int, title string, source_url string, text string, embedding array<double>, indexed_at string"
VERTICES = "entity_id string, vertex string, kind string, name string, normalized string, aliases array<string>, seen struct<at:string,chunk_id:string>"
EDGES = "document_id string, edge string, chunk_id string, entity_id string, indexed_at string"


@dataclass(frozen=True)
class StoredKnowledge:
    spark: SparkSession
    path: str
    embed: Embedder = vectors.hash_embedding
    buckets: int = 64

    @property
    def chunks(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/chunks", CHUNKS, "document_id", "chunk_id", "indexed_at", self.buckets)

    @property
    def vertices(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/vertices", VERTICES, "entity_id", "vertex", "seen", self.buckets)

    @property
    def edges(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/edges", EDGES, "document_id", "edge", "indexed_at", self.buckets)

    def ingest(self, clean: DataFrame, number: int | None = None, stream: str = "clean") -> None:
        """Merges clean documents (document_id, source_url, title, markdown, cleaned_at)."""
        newest = artifacts.latest(clean.select("document_id", "source_url", "title", "markdown", F.col("cleaned_at").alias("indexed_at")), "document_id", F.struct("indexed_at", "markdown", "title", "source_url"))
        cut = chunking.chunks(newest, "document_id", "markdown", "title", "source_url", "indexed_at")
        whole = cut.withColumn("embedding", self.embed(F.col("text")))
        none = newest.join(cut.select("document_id").distinct(), "document_id", "left_anti").select("document_id", "indexed_at")
        self.chunks.merge(whole.unionByName(none, allowMissingColumns=True), number, stream)
        self._draw(newest.select("document_id"), number, stream)

    def _draw(self, documents: DataFrame, number: int | None, stream: str) -> None:
        """Vertices and edges of the stored chunks of some documents."""
        held = self.chunks.all_rows().join(documents, "document_id", "left_semi")
        own = held.filter("chunk_id IS NOT NULL").select("document_id", "chunk_id", "text", "indexed_at")
        found = entities.entities(entities.mentions(own)).join(own.select("document_id", "chunk_id", "indexed_at"), "chunk_id")
        vertices = found.select("entity_id", F.col("entity_id").alias("vertex"), "kind", "name", "normalized", "aliases", F.struct(F.col("indexed_at").alias("at"), "chunk_id").alias("seen"))
        self.vertices.merge(artifacts.latest(vertices, "entity_id", F.struct("seen", "name")), number, stream)
        edges = found.select("document_id", F.concat_ws("\x1f", "chunk_id", "entity_id").alias("edge"), "chunk_id", "entity_id", "indexed_at")
        marks = held.groupBy("document_id").agg(F.max("indexed_at").alias("indexed_at"))
        self.edges.merge(edges.unionByName(marks, allowMissingColumns=True), number, stream)

    def base(self) -> KnowledgeBase:
        """The stored tables as a knowledge base; questions scan them and nothing before them."""
        return KnowledgeBase(self.chunks.rows(), self.vertices.rows().drop("vertex", "seen"), self.edges.rows().select("chunk_id", "entity_id"), self.embed)

    def start(self, inbox: str, dead: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Ingests clean artifacts from a folder of JSON files; undecodable ones become dead letters."""
        lines = self.spark.readStream.option("wholetext", True).text(inbox)

        def batch(rows: DataFrame, number: int) -> None:
            good, bad = artifacts.parse(rows, "clean")
            self.ingest(good, number)
            bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")

        writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
