"""Ranking by text, vectors and graph, and their fusion into one cited result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioforge.functions.text import capped, unique_terms
from folioforge.functions.vectors import fuse, unit
from folioforge.operators import text_index

QUERY_BLOCK, BASE_BLOCK = 2048, 65_536
ASKED_TERMS = 100_000  # of all questions, some 10 MB
DEFAULT_K, MOST_K = 5, 20

# Fixed value: the instruction of the prompt.
PROMPT = (
    "Answer the question using only the evidence below. If the evidence does not support an answer, say that it is not known. Do not invent facts."
)


def clamp_k(k: int | None) -> int:
    return min(max(k if k is not None else DEFAULT_K, 1), MOST_K)


def _best(rows: DataFrame, by: str, key: str, score: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def term_index(chunks: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """term, key, in_body, in_title: one row per distinct term of a chunk."""
    parts = F.transform(unique_terms(F.col(text)), lambda t: F.struct(t.alias("term"), F.lit(1).alias("b"), F.lit(0).alias("t")))
    if title:
        parts = F.concat(parts, F.transform(unique_terms(F.coalesce(F.col(title), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(0).alias("b"), F.lit(1).alias("t"))))
    return chunks.select(key, F.inline(parts))


def asked_terms(questions: DataFrame, question: str) -> dict | None:
    """The terms of each question that has any; None for more than ASKED_TERMS in all."""
    rows = questions.select(question, F.explode(unique_terms(F.col("text"))).alias("term")).limit(ASKED_TERMS + 1).collect()
    if len(rows) > ASKED_TERMS:
        return None
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append(r[1])
    return out


def full_text_rank(questions: DataFrame, chunks: DataFrame, k: int, question: str = "question_id", key: str = "chunk_id", text: str = "text", title: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """question, key, text_score, rank: the k best chunks per question (question, text), none with score 0.

    Questions of up to ASKED_TERMS terms go through postings (`index`, or made
    of the chunks here): a shard gives its k best, so few pairs meet before the
    top k.  Beyond that terms meet in an equi-join and are counted per pair, so
    no question is held against chunks without a common term.
    """
    asked = asked_terms(questions, question)
    if asked is not None:
        rows = text_index.index_rows(chunks, key, text, title) if index is None else index
        found = text_index.ranked_rows(rows, asked, k, question, dict(questions.dtypes)[question], key)
        return _best(found, question, key, "text_score", k)
    terms = questions.select(question, unique_terms(F.col("text")).alias("terms")).select(question, F.explode("terms").alias("term"), F.size("terms").alias("n"))
    met = term_index(chunks, key, text, title).join(terms, "term").groupBy(question, key, "n").agg(F.sum("b").alias("body"), F.sum("t").alias("title"))
    share = lambda c: capped(F.col(c)) / capped(F.col("n"))
    scored = met.select(question, key, F.least(F.lit(1.0), share("body") * 0.8 + share("title") * 0.2).alias("text_score"))
    return _best(scored, question, key, "text_score", k)


def finite(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector has no null, no NaN and no infinite component."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.filter(F.col(column).isNotNull() & F.forall(column, good))


class _Nearest:
    """The k best keys of some queries of one dimension, over vectors that come in parts."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, exclude_same: bool):
        self.ids, self.vectors, self.k, self.exclude_same = ids, vectors, k, exclude_same
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        self.top, self.place = np.zeros((len(ids), 0)), None

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(keys), QUERY_BLOCK):
            part, names = vectors[at : at + QUERY_BLOCK], keys[at : at + QUERY_BLOCK]
            scale = self.norms[:, None] * np.sqrt((part**2).sum(axis=1))[None]
            score = np.round(np.divide(self.vectors @ part.T, scale, out=np.zeros(scale.shape), where=scale > 0), 9)
            if self.exclude_same:
                score[self.ids[:, None] == names[None]] = -2.0
            names = np.broadcast_to(names, score.shape)
            top, place = (score, names) if self.place is None else (np.concatenate([self.top, score], axis=1), np.concatenate([self.place, names], axis=1))
            order = np.lexsort((place, -top), axis=1)[:, : self.k]
            self.top, self.place = np.take_along_axis(top, order, axis=1), np.take_along_axis(place, order, axis=1)

    def rows(self, query: str, key: str, wire: pa.Schema) -> pa.Table:
        if self.place is None:
            return wire.empty_table()
        row, col = np.nonzero(self.top > -2.0)
        return pa.table({query: self.ids[row].tolist(), key: self.place[row, col].tolist(), "cosine": self.top[row, col]}, schema=wire)


def _by_dimension(table: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Names (first column) and vectors of the rows of each dimension."""
    out = {}
    sizes = pa.compute.list_value_length(table.column("embedding"))
    for dimension in pa.compute.unique(sizes).to_pylist():
        part = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
        part = part.filter(pa.compute.equal(sizes, dimension)).combine_chunks()
        flat = part.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[dimension] = np.asarray(part.column(0).to_pylist()), flat.reshape(part.num_rows, dimension)
    return out


def _wire(queries: DataFrame, query: str, base: DataFrame, key: str) -> tuple[pa.Schema, str]:
    wire = pa.schema([(query, _arrow(queries, query)), (key, _arrow(base, key)), ("cosine", pa.float64())])
    return wire, f"{query} {dict(queries.dtypes)[query]}, {key} {dict(base.dtypes)[key]}, cosine double"


def nearest_in_groups(left: DataFrame, right: DataFrame, by: list[str], k: int, query: str, key: str, exclude_same: bool = False) -> DataFrame:
    """query, key, cosine: the k best of left (query, embedding) in each group of right (key, embedding) with equal `by`."""
    wire, schema = _wire(left, query, right, key)
    right = right.select(key, "embedding", *by).select(*[F.col(c).alias(c) for c in (key, "embedding", *by)])  # columns of its own, where queries come from base

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        have, out = _by_dimension(held), []
        for dimension, (ids, vectors) in _by_dimension(asked).items():
            if dimension in have:
                found = _Nearest(ids, vectors, k, exclude_same)
                found.add(*have[dimension])
                out.append(found.rows(query, key, wire))
        return pa.concat_tables(out) if out else wire.empty_table()

    return left.select(query, "embedding", *by).groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, schema)


def vector_rank(queries: DataFrame, base: DataFrame, k: int, query: str = "query_id", key: str = "vec_id", exclude_same: bool = False) -> DataFrame:
    """query, key, cosine (rounded to 9 digits), rank: exact top k of base (key, embedding) per query (query, embedding).

    Up to QUERY_BLOCK queries are sent to where base lies, and each task keeps
    its k best per query.  Of more, both sides are dealt to blocks; each block of
    queries meets each block of base in a group of its own.  Vectors of another
    dimension than a query's don't count for it, nor do those that aren't finite.
    """
    wanted, own = finite(queries.select(query, "embedding")), finite(base.select(key, "embedding"))
    few = wanted.limit(QUERY_BLOCK + 1).toArrow()
    if few.num_rows <= QUERY_BLOCK:
        asked = _by_dimension(few)
        wire, schema = _wire(queries, query, base, key)

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {d: _Nearest(ids, vectors, k, exclude_same) for d, (ids, vectors) in asked.items()}
            for batch in batches:
                for dimension, held in _by_dimension(batch).items():
                    if dimension in found:
                        found[dimension].add(*held)
            for own in found.values():
                yield from own.rows(query, key, wire).to_batches()

        return _best(own.mapInArrow(stream, schema), query, key, "cosine", k)
    across, along = max(1, -(-wanted.count() // QUERY_BLOCK)), max(1, -(-own.count() // BASE_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = wanted.withColumn("across", F.pmod(F.xxhash64(query), F.lit(across))).withColumn("along", every(along))
    right = own.withColumn("along", F.pmod(F.xxhash64(key), F.lit(along))).withColumn("across", every(across))
    return _best(nearest_in_groups(left, right, ["across", "along"], k, query, key, exclude_same), query, key, "cosine", k)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def graph_scores(questions: DataFrame, paths: DataFrame, question: str = "question_id", key: str = "chunk_id") -> DataFrame:
    """question, key, graph_score from paths (key, name, length): capped sum of matched shares over path length.

    Equal paths of a chunk are summed up first.  The terms of up to ASKED_TERMS
    question terms are sent to where the paths lie, so a frequent term is no hot
    key, and a path's share is known in its own row; only sums are shuffled.
    """
    own = paths.groupBy(key, "name", F.greatest(F.coalesce("length", F.lit(1)), F.lit(1)).alias("length")).agg(F.count("*").alias("times"))
    terms = own.select(key, "name", "length", "times", F.explode(unique_terms(F.col("name"))).alias("term"))
    asked = questions.select(question, unique_terms(F.col("text")).alias("terms")).select(question, F.explode("terms").alias("term"), F.size("terms").alias("n"))
    few = asked.limit(ASKED_TERMS + 1).count() <= ASKED_TERMS
    matched = terms.join(F.broadcast(asked) if few else asked, "term").groupBy(question, key, "name", "length", "times", "n").agg(F.count("*").alias("m"))
    signal = F.col("times") * capped(F.col("m")) / capped(F.col("n")) / capped(F.col("length"))
    return matched.groupBy(question, key).agg(F.least(F.lit(1.0), F.sum(signal)).alias("graph_score"))


def graph_paths(edges: DataFrame, vertices: DataFrame, key: str = "chunk_id", most: int | None = None) -> DataFrame:
    """key, name, length of all edges (key, entity_id), or of the first `most` in order where a page is asked for."""
    paths = edges.join(vertices.select("entity_id", "name"), "entity_id")
    paths = paths if most is None else paths.orderBy(key, "entity_id").limit(most)
    return paths.select(key, "name", F.lit(1).alias("length"))


def hybrid_rank(vector: DataFrame, text: DataFrame, graph: DataFrame, indexed: DataFrame, k: int, question: str = "question_id", key: str = "chunk_id") -> DataFrame:
    """Fused ranking of three lists (question, key, score), each cut before fusion.

    A graph score counts for indexed keys and for those another list has.  The
    lists are stacked and summed up once instead of joined twice.
    """
    zero = F.lit(0.0)
    stacked = (
        vector.select(question, key, unit(F.col("score")).alias("v"), zero.alias("t"), zero.alias("g"), F.lit(True).alias("kept"))
        .unionByName(text.select(question, key, zero.alias("v"), F.col("score").alias("t"), zero.alias("g"), F.lit(True).alias("kept")))
        .unionByName(graph.select(question, key, zero.alias("v"), zero.alias("t"), F.col("score").alias("g"), F.lit(False).alias("kept")))
    )
    summed = stacked.groupBy(question, key).agg(F.max("v").alias("v"), F.max("t").alias("t"), F.max("g").alias("g"), F.max("kept").alias("kept"))
    known = summed.join(indexed.select(key).distinct().withColumn("indexed", F.lit(True)), key, "left")
    fused = known.filter(F.col("kept") | F.col("indexed")).select(question, key, "v", "t", "g", fuse(F.col("v"), F.col("t"), F.col("g")).alias("score"))
    return _best(fused, question, key, "score", k)


def render_prompt(question: Column, evidence: Column) -> Column:
    """evidence: array<struct<chunk_id, text>> in rank order."""
    blocks = F.transform(evidence, lambda e: F.concat(F.lit("["), e["chunk_id"], F.lit("]\n"), e["text"]))
    return F.concat(F.lit(PROMPT + "\n\nQuestion: "), question, F.lit("\n\nEvidence:\n"), F.array_join(blocks, "\n\n"), F.lit("\n\nAnswer concisely:"))


def classify_answer(text: Column, error: Column, cited: Column) -> Column:
    """struct<answer, availability, grounding, citations> of a model's reply."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "") == ""
    good = ~error & ~blank
    return F.struct(
        F.when(good, text).alias("answer"), F.when(error, "unavailable").otherwise("available").alias("availability"),
        F.when(good, "grounded").otherwise("ungrounded").alias("grounding"), F.when(good, cited).otherwise(F.array().cast("array<string>")).alias("citations"),
    )


def consistent(answer: Column, cited: Column) -> Column:
    """Whether an answer row keeps the response contract: grounded means text and citations among the chunks shown."""
    grounded = answer["grounding"] == "grounded"
    inside = F.size(F.array_except(answer["citations"], cited)) == 0
    return F.when(grounded, (answer["availability"] == "available") & answer["answer"].isNotNull() & (F.size(answer["citations"]) > 0) & inside).otherwise(
        answer["answer"].isNull() & (F.size(answer["citations"]) == 0) & answer["availability"].isin("available", "unavailable")
    )
