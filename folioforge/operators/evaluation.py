"""Ranking metrics, entity-resolution sweeps, percentiles and gates as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevance: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5), query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """k, recall, mrr, ndcg averaged over the queries of relevance (query, key, grade); ranked has (query, key, rank)."""
    ks = F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("k")
    good = relevance.filter("grade > 0")
    gain, discount = F.pow(F.lit(2.0), F.col("grade")) - 1, lambda r: F.log2(F.col(r) + 1)
    ideal = good.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), key)))
    wanted = ideal.select(query, "grade", "place", ks).groupBy(query, "k").agg(F.count("*").alias("n"), F.sum(F.when(F.col("place") <= F.col("k"), gain / discount("place"))).alias("ideal"))
    every = relevance.select(query).distinct().select(query, ks)
    return _averaged(every.join(wanted, [query, "k"], "left"), ranked.join(good, [query, key]), ks, query)


def class_metrics(ranked: DataFrame, classes: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5), query: str = "query_id", key: str = "chunk_id", label: str = "label") -> DataFrame:
    """ranking_metrics where a query's relevant rows are all others of its label, at grade 1; classes has (key, label) of every row.

    How many are relevant comes from the labels' counts, so no query meets all rows of its label.
    """
    ks = F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("k")
    counts = classes.groupBy(label).agg((F.count("*") - 1).alias("n"))
    own = classes.select(F.col(key).alias(query), F.col(label).alias("asked"))
    asked = ranked.select(query).distinct().join(own, query)
    terms = F.transform(F.sequence(F.lit(1), F.least(F.col("k"), F.col("n")).cast("int")), lambda p: 1 / F.log2(p + 1))
    wanted = asked.join(counts.withColumnRenamed(label, "asked"), "asked").filter("n > 0").select(query, "n", ks)
    wanted = wanted.withColumn("ideal", F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))
    hits = ranked.join(asked, query).join(classes, key).filter(F.col(label) == F.col("asked")).withColumn("grade", F.lit(1))
    return _averaged(wanted, hits, ks, query)


def _averaged(wanted: DataFrame, hits: DataFrame, ks: Column, query: str) -> DataFrame:
    """Metrics of queries (query, k, n, ideal) from their relevant rows found (query, rank, grade)."""
    gain, discount = F.pow(F.lit(2.0), F.col("grade")) - 1, F.log2(F.col("rank") + 1)
    hits = hits.select(query, "rank", "grade", ks)
    got = hits.groupBy(query, "k").agg(
        F.count_if(F.col("rank") <= F.col("k")).alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= F.col("k"), gain / discount)).alias("dcg")
    )
    rows = wanted.join(got, [query, "k"], "left")
    return rows.groupBy("k").agg(
        F.avg(F.coalesce(F.col("found") / F.col("n"), F.lit(0.0))).alias("recall"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0))).alias("ndcg"),
    )


def resolution_sweep(scored: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 over pairs (score, expected); a null score never merges."""
    slack = 4 * 2.220446049250313e-16
    at = scored.select("score", "expected", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    merged = F.coalesce(F.col("score") + slack >= F.col("threshold"), F.lit(False))
    counted = at.groupBy("threshold").agg(
        F.count_if(merged & F.col("expected")).alias("tp"), F.count_if(merged & ~F.col("expected")).alias("fp"), F.count_if(~merged & F.col("expected")).alias("fn")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), F.desc("precision"), "threshold").limit(1)


def pair_score(same_type, left, right, left_aliases, right_aliases, similarity):
    """1 for equal names or an alias of the other, null across types, else the similarity of normalized names."""
    alias = F.array_contains(left_aliases, right) | F.array_contains(right_aliases, left)
    return F.when(same_type, F.when((left == right) | F.coalesce(alias, F.lit(False)), F.lit(1.0)).otherwise(similarity))


def percentile(rows: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    """Nearest-rank percentile."""
    return rows.groupBy(*by).agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias("value"))


def index_gate(exact_recall, index_recall, exact_p95, index_p95, least: float = 0.98):
    """Whether an approximate index is good and fast enough to be taken."""
    return (F.when(exact_recall > 0, index_recall / exact_recall).otherwise(0.0) >= least) & (index_p95 < exact_p95)
