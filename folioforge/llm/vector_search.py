"""Exact top-k inner-product search by ball trees (operator 3).

Vectors are dealt evenly to shards.  Each shard builds a ball tree: nodes split
at the median of their widest direction, a node keeps its centre and radius.  A
node's inner products with query q are at most q.centre + |q| radius.  Queries go
to every shard in blocks of bounded size.  A first pass asks one shard per query for its k best;
their least score, a lower bound on the final kth score, goes along to all the
other shards.  In a shard, a query first dives to its best leaf, then opens
nodes level by level where the bound reaches the current kth score, and visits
leaves by falling bound while the kth score rises, in looks of 1, 2, 4, ... leaves, so that
queries that look into a leaf are multiplied with it together.  Of a leaf only points
that reach the kth score are ranked.

Components are floor(scale * x) with x as double, scores integers (exact below 2^53), so ties are
exact; equal scores go to the smaller id.  Equal vectors of a shard are one point
with their k + 1 least ids, which is all that a query can use.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; a query meets only vectors of its own dimension; of
repeated ids every row is a candidate and each query id answers once per distinct
vector it has; rows with null id take no part; extra columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.shared import write_table

K = 5
SCALE = 256
EVERY = 50
SHARD_ROWS = 16_384
BLOCK_QUERIES = 2048
GROUP_QUERIES = 50_000  # a task holds so many queries and SHARD_ROWS vectors at most, about
LEAF = 64
SLACK = 1e-12  # of a bound's greatest size, for its rounding


class BallTree:
    """A ball tree over distinct integer points, in arrays by node number."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.order = np.arange(len(points))
        span, child, centre, radius = [(0, len(points))], [], [], []
        at = 0
        while at < len(span):
            a, b = span[at]
            own = points[self.order[a:b]]
            middle = own.mean(axis=0)
            away = np.sqrt(((own - middle) ** 2).sum(axis=1))
            centre.append(middle)
            radius.append(away.max())
            if b - a <= leaf or radius[-1] == 0:
                child.append(-1)
            else:
                far = own[away.argmax()]  # the widest direction: from the farthest point to the one farthest from it
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                split = np.argpartition(own @ (far - other), (b - a) // 2)
                self.order[a:b] = self.order[a:b][split]
                m = a + (b - a) // 2
                child.append(len(span))
                span += [(a, m), (m, b)]
            at += 1
        self.span, self.child = np.array(span), np.array(child)
        self.centre, self.radius = np.array(centre), np.array(radius)


class Best:
    """The k best (score, id) of each query."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def offer(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates, any number for a query."""
        k = self.score.shape[1]
        own = np.unique(query)
        query = np.concatenate([np.repeat(own, k), query])
        scores, ids = np.concatenate([self.score[own].ravel(), scores]), np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((ids, -scores, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[place < k]  # k of each query, as it had so many
        self.score[own], self.id[own] = scores[order].reshape(-1, k), ids[order].reshape(-1, k)


class Shard:
    """Searches one shard's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, leaf: int = LEAF):
        points, back = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, back.ravel()))
        ids, back = ids[order], back.ravel()[order]
        place = np.arange(len(ids)) - np.searchsorted(back, back)
        self.ids = np.full((len(points), k + 1), -1, dtype=np.int64)
        few = place <= k
        self.ids[back[few], place[few]] = ids[few]
        self.tree = BallTree(points.astype(np.float64), leaf)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> Best:
        tree, q = self.tree, queries.astype(np.float64)
        best = Best(len(q), k, floor)
        norms, far = np.sqrt((q**2).sum(axis=1)), np.sqrt((tree.centre**2).sum(axis=1)) + tree.radius
        bound = q @ tree.centre.T + norms[:, None] * (tree.radius + SLACK * far)[None] + 1e-3  # [query, node]

        def visit(rows: np.ndarray, leaf: int) -> None:
            a, b = tree.span[leaf]
            points = tree.order[a:b]
            scores = q[rows] @ tree.points[points].T
            least = best.kth()[rows]
            if b - a > k + 1 and (scores >= least[:, None]).sum() > (k + 1) * len(rows):  # at most one of a leaf's best points is the query itself alone
                least = np.maximum(least, np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)])
            row, col = np.nonzero(scores >= least[:, None])
            ids = self.ids[points[col]]
            good = (ids >= 0) & (ids != query_ids[rows[row]][:, None])
            at, slot = np.nonzero(good)
            if len(at):
                best.offer(rows[row[at]], scores[row[at], col[at]], ids[at, slot])

        def visit_each(rows: np.ndarray, leaves: np.ndarray) -> None:
            order = np.argsort(leaves, kind="stable")
            names, begins = np.unique(leaves[order], return_index=True)
            for leaf, a, b in zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
                visit(rows[order[a:b]], leaf)

        rows, nodes = np.arange(len(q)), np.zeros(len(q), dtype=np.int64)
        while (inner := tree.child[nodes] >= 0).any():  # dive
            left = tree.child[nodes]
            better = bound[rows[inner], left[inner] + 1] > bound[rows[inner], left[inner]]
            nodes[inner] = left[inner] + better
        visited = nodes.copy()
        visit_each(rows, nodes)

        rows, nodes, leaf_rows, leaf_nodes = np.arange(len(q)), np.zeros(len(q), dtype=np.int64), [], []
        while len(rows):  # open nodes whose bound reaches the kth score
            open_ = bound[rows, nodes] >= best.kth()[rows]
            rows, nodes = rows[open_], nodes[open_]
            ends = tree.child[nodes] < 0
            leaf_rows.append(rows[ends])
            leaf_nodes.append(nodes[ends])
            rows, nodes = np.repeat(rows[~ends], 2), np.stack([tree.child[nodes[~ends]], tree.child[nodes[~ends]] + 1], axis=1).ravel()
        rows, nodes = np.concatenate(leaf_rows), np.concatenate(leaf_nodes)
        fresh = nodes != visited[rows]
        rows, nodes = rows[fresh], nodes[fresh]
        order = np.lexsort((-bound[rows, nodes], rows))
        rows, nodes = rows[order], nodes[order]
        turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
        seen, step = 0, 1
        while seen <= turn.max(initial=-1):  # each query's leaves by falling bound, twice as many in each look
            own = np.flatnonzero((turn >= seen) & (turn < seen + step))
            own = own[bound[rows[own], nodes[own]] >= best.kth()[rows[own]]]
            if not len(own):
                break
            visit_each(rows[own], nodes[own])
            seen, step = seen + step, 2 * step
        return best


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<long>) of the rows that take part."""
    at = F.col("embedding")
    bad = F.exists(at, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return (
        vectors.filter(F.col("vec_id").isNotNull() & at.isNotNull() & (F.size(at) > 0) & ~bad)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(at, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    )


def top_k(base: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of base (both vec_id, v)."""
    sizes = {r.dim: r["count"] for r in base.groupBy(F.size("v").alias("dim")).count().collect()}
    empty = "query_id long, rank int, vec_id long, score long"
    if not sizes:
        return base.sparkSession.createDataFrame([], empty)
    n_shards = {d: -(-n // shard_rows) for d, n in sizes.items()}
    shards_of = F.element_at(F.create_map(*[F.lit(x) for d, n in n_shards.items() for x in (d, n)]), F.size("v")).cast("long")
    blocks = -(-queries.count() // GROUP_QUERIES) or 1
    dealt, _ = write_table(base.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), shards_of).alias("shard"), "vec_id", "v"), "vectors")
    # with block, home and floor a query row also carries where it was asked first
    asked = queries.distinct().select(
        F.size("v").alias("dim"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.pmod(F.xxhash64("vec_id", "v"), shards_of).alias("home"), shards_of.alias("shards"),
        F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(blocks)).alias("block"),
    ).filter(F.col("home").isNotNull())

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "qhash", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        dim = left.column("dim")[0].as_py()
        matrix = lambda c: c.combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.int64)
        shard = Shard(left.column("vec_id").to_numpy(), matrix(left.column("v")), k)
        ids, hashes, q = right.column("query_id").to_numpy(), right.column("qhash").to_numpy(), matrix(right.column("q"))
        floor, out = right.column("floor").to_numpy().astype(np.float64), []
        for a in range(0, len(ids), BLOCK_QUERIES):
            own = slice(a, a + BLOCK_QUERIES)
            best = shard.search(ids[own], q[own], k, floor[own])
            row, col = np.nonzero(np.isfinite(best.score) & (best.score >= floor[own][:, None]))
            out.append(pa.table({"query_id": ids[own][row], "qhash": hashes[own][row], "vec_id": best.id[row, col], "score": best.score[row, col].astype(np.int64)}))
        return pa.concat_tables(out)

    def ask(rows: DataFrame) -> DataFrame:
        own = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return own.groupBy("dim", "shard", "block").cogroup(rows.groupBy("dim", "shard", "block")).applyInArrow(search, "query_id long, qhash long, vec_id long, score long")

    asked = asked.withColumn("qhash", F.xxhash64("q"))
    first, _ = write_table(ask(asked.withColumn("shard", F.col("home")).withColumn("floor", F.lit(float("-inf")))), "first")
    bounds = first.groupBy("query_id", "qhash").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor"))
    others = (
        asked.join(bounds, ["query_id", "qhash"], "left")
        .withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        .filter("shard != home")
    )
    found = first.unionByName(ask(others))
    by = Window.partitionBy("query_id", "qhash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best partners of every vector whose id is divisible by 50."""
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
