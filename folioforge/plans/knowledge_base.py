"""The stages put together: pages to clean texts, chunks, vectors and graph, and questions to cited answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text, urls, vectors
from folioforge.operators import article, chunking, entities, html, retrieval


def clean_pages(pages: DataFrame) -> DataFrame:
    """document_id, source_url, title, markdown, language of fetchable pages (url, title, html) with enough words.

    Where pages have a status, only successful responses count; a body over the limit counts nowhere."""
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    pages = pages.filter(html.fetchable(status, F.col("html")))
    source = urls.normalize_url(F.col("url"))
    rows = pages.select(source.alias("source_url"), html.title_or(html.title(F.col("html")), F.col("title")).alias("title"), article.main_markdown("html").alias("raw"))
    rows = rows.withColumn("markdown", text.sanitize(F.col("raw")))
    kept = rows.filter(F.col("source_url").isNotNull() & (text.word_count(F.col("markdown")) >= text.MIN_WORDS))
    return kept.select(urls.document_id(F.col("source_url")).alias("document_id"), "source_url", "title", "markdown", text.language(F.col("markdown")).alias("language"))


#: A text column as a vector column; a pandas UDF over a model fits too.
Embedder = Callable[[Column], Column]


def index(clean: DataFrame, embed: Embedder = vectors.hash_embedding) -> DataFrame:
    """Chunks with their vectors."""
    rows = chunking.chunks(clean, "document_id", "markdown", "title", "source_url")
    return rows.withColumn("embedding", embed(F.col("text")))


@dataclass
class KnowledgeBase:
    chunks: DataFrame
    vertices: DataFrame
    edges: DataFrame
    embed: Embedder = vectors.hash_embedding

    @classmethod
    def build(cls, pages: DataFrame, embed: Embedder = vectors.hash_embedding) -> KnowledgeBase:
        return cls.of_chunks(index(clean_pages(pages), embed), embed)

    @classmethod
    def of_chunks(cls, chunks: DataFrame, embed: Embedder = vectors.hash_embedding) -> KnowledgeBase:
        return cls(chunks, *entities.graph(entities.entities(entities.mentions(chunks))), embed)

    def ask(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """The best chunks of each question (question_id, text): scores, rank, title, source_url and text."""
        k = retrieval.clamp_k(k)
        asked = questions.withColumn("embedding", self.embed(F.col("text")))
        by_vector = retrieval.vector_rank(asked, self.chunks, k, "question_id", "chunk_id").select("question_id", "chunk_id", F.col("cosine").alias("score"))
        by_text = retrieval.full_text_rank(questions, self.chunks, k, title="title").select("question_id", "chunk_id", F.col("text_score").alias("score"))
        paths = retrieval.graph_paths(self.edges, self.vertices)
        by_graph = retrieval.graph_scores(questions, paths).select("question_id", "chunk_id", F.col("graph_score").alias("score"))
        ranked = retrieval.hybrid_rank(by_vector, by_text, by_graph, self.chunks, k)
        return ranked.join(self.chunks.select("chunk_id", "title", "source_url", "text"), "chunk_id")

    def prompts(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """question_id, prompt, cited of each question that has evidence."""
        shown = self.ask(questions, k).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("evidence"))
        return questions.join(shown, "question_id").select(
            "question_id", retrieval.render_prompt(F.col("text"), F.col("evidence")).alias("prompt"), F.transform("evidence", lambda e: e["chunk_id"]).alias("cited")
        )
