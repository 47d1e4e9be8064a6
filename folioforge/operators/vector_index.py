"""An approximate vector index: coarse cells as a partitioned table, of which a query reads few.

Cells are the classes of a spherical k-means, fitted to a bounded sample of the
vectors (SAMPLE rows, the first by a hash of their keys) and then given to all.
Their number is bounded by MOST_CELLS, so centres fit in every task.  A search
reads the partitions of the cells that its queries probe.  With `probes` it ends
there; without, it goes on to every cell that may hold a better vector by the
angles between query, centre and the cell's farthest member, and is exact.

Vectors that are null or not finite, or of another dimension than the index,
take no part.  An empty base makes an index without cells, which finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.retrieval import BASE_BLOCK, _best, finite, nearest_in_groups, vector_rank
from folioforge.sources.store import Manifests

MOST_CELLS = 4096
SAMPLE = 65_536
ROUNDS = 10
SLACK = 1e-9  # scores are rounded to 9 digits


def cell_count(n: int) -> int:
    """Cells for n vectors: about the root of n, in powers of two."""
    return min(MOST_CELLS, 1 << max(0, round(np.log2(max(n, 1)) / 2)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of a spherical k-means, begun at rows far apart in the sample's order."""
    rows = np.unique(_unit(sample), axis=0)
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)]
    for _ in range(rounds if len(rows) else 0):
        of = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        held = np.bincount(of, minlength=len(centres)) > 0
        centres = np.where(held[:, None], _unit(sums), centres)
    return centres


def _flat(batch: pa.RecordBatch, dimension: int) -> tuple[pa.RecordBatch, np.ndarray]:
    part = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column("embedding")), dimension))
    flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return part, _unit(flat.reshape(part.num_rows, dimension))


CELLS = "cell int, centre array<double>, n long, least double"


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    key: str
    schema: str

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        _, said = Manifests(spark, f"{path}/manifest").read()
        return cls(spark, path, said["key"], said["schema"])

    @classmethod
    def build(cls, base: DataFrame, path: str, key: str = "vec_id", cells: int | None = None) -> VectorIndex:
        """Writes the index of base (key, embedding) to a new path."""
        spark, own = base.sparkSession, finite(base.select(key, "embedding"))
        n = own.count()
        first = own.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("embedding").toArrow().column(0).to_pylist() if n else []
        dimension = len(first[0]) if first else 0
        centres = fit(np.array([v for v in first if len(v) == dimension], dtype=np.float64).reshape(-1, max(dimension, 1)), min(cells or cell_count(n), MOST_CELLS))

        def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, unit = _flat(batch, dimension)
                for at in range(0, part.num_rows, 4096):
                    near = unit[at : at + 4096] @ centres.T
                    of = near.argmax(axis=1)
                    near = near[np.arange(len(of)), of]
                    rows = part.slice(at, 4096)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near), pa.array(of.astype(np.int32))], names=[*rows.schema.names, "near", "cell"])

        kinds = dict(own.dtypes)
        schema = f"{key} {kinds[key]}, embedding {kinds['embedding']}, near double, cell int"
        dealt = own.mapInArrow(give, schema)
        # a large cell is written by several tasks
        spread = dealt.repartition("cell", F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // (BASE_BLOCK * max(len(centres), 1)))))))
        spread.write.partitionBy("cell").parquet(f"{path}/vectors")
        vectors = spark.read.schema(dealt.schema).parquet(f"{path}/vectors")
        sizes = vectors.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"))
        named = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)] if n else [], "cell int, centre array<double>")
        named.join(sizes, "cell").write.parquet(f"{path}/cells")
        Manifests(spark, f"{path}/manifest").commit(0, {"key": key, "schema": schema})
        return cls.open(spark, path)

    def cells(self) -> DataFrame:
        """cell, centre, n, least (the cosine of its farthest member)."""
        return self.spark.read.schema(CELLS).parquet(f"{self.path}/cells")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def probed(self, queries: DataFrame, query: str, probes: int | None, reached: bool = False) -> DataFrame:
        """query, embedding, cell: the `probes` nearest cells of each query; or, `reached`, every further one that may hold `kth` or better."""
        held = sorted(self.cells().collect())  # at most MOST_CELLS
        dimension, kind = len(held[0].centre) if held else 0, dict(queries.dtypes)
        names, centres = np.array([c.cell for c in held], dtype=np.int32), np.array([c.centre for c in held]).reshape(len(held), dimension)
        angle = np.arccos(np.clip(np.array([c.least for c in held]), -1, 1))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, unit = _flat(batch, dimension)
                near = unit @ centres.T
                place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
                take = place < (probes or len(held))
                if reached:
                    bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - angle[None]))
                    kth = part.column("kth").to_numpy(zero_copy_only=False)
                    take = ~take & (bound + SLACK >= np.where(np.isnan(kth), -2, kth)[:, None])
                row, cell = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in (query, "embedding")), pa.array(names[cell])], names=[query, "embedding", "cell"])

        wanted = finite(queries)
        return wanted.mapInArrow(ask, f"{query} {kind[query]}, embedding {kind['embedding']}, cell int") if held else wanted.limit(0).select(query, "embedding", F.lit(0).alias("cell"))

    def _found(self, asked: DataFrame, k: int, query: str, exclude_same: bool) -> DataFrame:
        """query, key, cosine of asked (query, embedding, cell): only the asked cells' partitions are read."""
        wanted = [r.cell for r in asked.select("cell").distinct().collect()]
        parts = self.cells().select("cell", F.ceil(F.col("n") / BASE_BLOCK).cast("int").alias("parts"))
        left = asked.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = self.vectors().filter(F.col("cell").isin(wanted)).join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(self.key), F.col("parts")).cast("int"))
        return nearest_in_groups(left, right, ["cell", "part"], k, query, self.key, exclude_same)

    def search(self, queries: DataFrame, k: int, query: str = "query_id", probes: int | None = None, exclude_same: bool = False) -> DataFrame:
        """query, key, cosine, rank of the k nearest: exact, or among the `probes` nearest cells of each query."""
        own = queries.select(query, "embedding")
        first = self._found(self.probed(own, query, probes or 1), k, query, exclude_same)
        if probes is None:
            ranked = _best(first, query, self.key, "cosine", k)
            kth = ranked.groupBy(query).agg(F.min(F.when(F.col("rank") == k, F.col("cosine"))).alias("kth"))
            asked = own.join(kth, query, "left")
            more = self._found(self.probed(asked.select(query, "embedding", F.coalesce("kth", F.lit(-2.0)).alias("kth")), query, 1, reached=True), k, query, exclude_same)
            first = first.unionByName(more)
        return _best(first, query, self.key, "cosine", k)

    def gate(self, queries: DataFrame, k: int = 10, least: float = 0.98, most_read: float = 0.2, query: str = "query_id", exclude_same: bool = False) -> DataFrame:
        """probes, recall, cells_read, rows_read, adopted for doubling numbers of probes, against exact search over all vectors.

        An approximate search is adopted where it finds `least` of the exact
        neighbours (any with the kth score will do) and reads under `most_read` of
        the cells and of the rows.
        """
        exact = vector_rank(queries, self.vectors(), k, query, self.key, exclude_same)
        kth = exact.groupBy(query).agg(F.min("cosine").alias("kth"), F.count("*").alias("wanted"))
        cells, n = self.cells().count(), self.cells().agg(F.sum("n")).first()[0] or 0
        tried, probes = [], 1
        while probes <= cells:
            tried.append(probes)
            probes *= 2
        out = None
        for probes in tried:
            asked = self.probed(queries.select(query, "embedding"), query, probes)
            read = asked.join(F.broadcast(self.cells().select("cell", "n")), "cell").groupBy(query).agg(F.count("*").alias("cells"), F.sum("n").alias("rows"))
            found = self.search(queries, k, query, probes, exclude_same).join(kth, query).groupBy(query).agg(F.count_if(F.col("cosine") >= F.col("kth")).alias("found"))
            rows = kth.join(read, query).join(found, query, "left").agg(
                F.avg(F.coalesce("found", F.lit(0)) / F.col("wanted")).alias("recall"), (F.avg("cells") / cells).alias("cells_read"), (F.avg("rows") / n).alias("rows_read")
            ).select(F.lit(probes).alias("probes"), "recall", "cells_read", "rows_read")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], "probes int, recall double, cells_read double, rows_read double, adopted boolean")
        return out.withColumn("adopted", (F.col("recall") >= least) & (F.col("cells_read") < most_read) & (F.col("rows_read") < most_read))
