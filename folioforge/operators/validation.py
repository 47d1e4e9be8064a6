"""Checks of arguments and labelled sets; each set check returns its violations as rows (problem, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.catalog import DEFAULT_RESULTS, MOST_RESULTS, MOST_TOPIC

GRADES = (0, 3)


def topic_request(topic: str, limit: int | None = None) -> tuple[str, int]:
    """The trimmed topic and the limit, or an error."""
    topic, limit = topic.strip(), DEFAULT_RESULTS if limit is None else limit
    if not topic or len(topic) > MOST_TOPIC:
        raise ValueError(f"a topic has 1 to {MOST_TOPIC} characters")
    if not 1 <= limit <= MOST_RESULTS:
        raise ValueError(f"a limit lies between 1 and {MOST_RESULTS}")
    return topic, limit


def collection_name(name: Column) -> Column:
    """Whether a collection may have this name."""
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_-]{1,64}$"), F.lit(False))


def _problem(rows: DataFrame, name: str, key: str) -> DataFrame:
    return rows.select(F.lit(name).alias("problem"), F.col(key).cast("string").alias("id"))


def _repeated(rows: DataFrame, key: str, name: str) -> DataFrame:
    return _problem(rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), name, key)


def ranking_set(docs: DataFrame, relevance: DataFrame, key: str = "chunk_id", query: str = "query_id") -> DataFrame:
    """Unique documents, grades in range, judged documents that exist, a relevant one for each query."""
    low, high = GRADES
    without = relevance.groupBy(query).agg(F.max("grade").alias("best")).filter("coalesce(best, 0) <= 0")
    return (
        _repeated(docs, key, "repeated document")
        .unionByName(_problem(relevance.filter(~F.coalesce(F.col("grade").between(low, high), F.lit(False))), "grade out of range", query))
        .unionByName(_problem(relevance.join(docs, key, "left_anti"), "unknown document", key))
        .unionByName(_problem(without, "query without relevant document", query))
    )


def resolution_set(pairs: DataFrame, kinds: tuple[str, ...] = ("PERSON", "ORGANIZATION", "LOCATION", "EVENT", "CONCEPT", "PRODUCT")) -> DataFrame:
    """Unique pairs (id, left, right, expected_same) of named mentions with known types, both labels present."""
    bad = lambda s: F.coalesce(F.trim(F.col(f"{s}.name")) == "", F.lit(True)) | ~F.coalesce(F.upper(F.col(f"{s}.entity_type")).isin(*kinds), F.lit(False))
    labels = pairs.agg(F.count_if("expected_same").alias("same"), F.count_if(~F.col("expected_same")).alias("different")).filter("same = 0 OR different = 0").withColumn("id", F.lit("*"))
    return (
        _repeated(pairs, "id", "repeated pair").unionByName(_problem(pairs.filter(bad("left") | bad("right")), "bad mention", "id")).unionByName(_problem(labels, "one label only", "id"))
    )


def vector_set(points: DataFrame, dimension: int, key: str = "vec_id") -> DataFrame:
    """Unique points whose vectors have the dimension and a length above 0."""
    size = F.size("embedding")
    zero = F.forall("embedding", lambda x: x == 0)
    return (
        _repeated(points, key, "repeated point")
        .unionByName(_problem(points.filter(F.col("embedding").isNull() | (size != dimension)), "wrong dimension", key))
        .unionByName(_problem(points.filter((size == dimension) & zero), "zero vector", key))
    )
