"""Connected components of links held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.shared import drop_tables, write_table


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest reachable node) for every node in links (a, b long).

    Alternates large-star and small-star: every node links its larger (then its
    smaller) neighbours to its least neighbour, which keeps components and ends
    in stars after about log(n) rounds.  Each round is a written table.
    """
    spark = links.sparkSession
    edges, path = write_table(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def with_least(edges: DataFrame, least: DataFrame) -> tuple[DataFrame, str]:
        """edges with m by a; the least ones are written apart from their sums, so that the join may split a large star's partition."""
        least, path = write_table(least, "least")
        return edges.join(least.hint("shuffle_hash"), "a"), path

    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined, large_least = with_least(both, both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large, large_path = write_table(joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined, small_least = with_least(large, least)
        moved = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small, small_path = write_table(moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), "links")
        same = small.count() == edges.count() and small.join(edges, ["a", "b"], "left_anti").isEmpty()
        drop_tables(spark, path, large_path, large_least, small_least)
        edges, path = small, small_path
        if same:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
