import numpy as np
import pytest

from folioforge.llm import vector_search as vs


def brute(base, queries, k=5):
    out = []
    for qid, q in queries:
        scored = sorted((-int(np.dot(q, v)), i) for i, v in base if i != qid and len(v) == len(q))[:k]
        out += [(qid, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("leaf", [1, 7, 64])
def test_shard_search_is_exact(leaf):
    rng = np.random.default_rng(leaf)
    v = rng.integers(-3, 4, (500, 3))
    ids = rng.permutation(500)
    shard = vs.Shard(ids, v, 5, leaf)
    best = shard.search(ids[:60], v[:60], 5, np.full(60, -np.inf))
    got = sorted((int(ids[i]), r + 1, int(best.id[i, r]), int(best.score[i, r])) for i in range(60) for r in range(5))
    assert got == brute(list(zip(ids.tolist(), v, strict=True)), list(zip(ids[:60].tolist(), v[:60], strict=True)))


def test_top_k_over_shards(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.integers(-20, 20, 6).tolist()) for i in range(400)] + [(400 + i, [1] * 6) for i in range(200)] + [(700, [1, 2]), (750, [2, 2])]
    base = spark.createDataFrame(rows, "vec_id long, v array<int>")
    queries = base.filter("vec_id % 50 = 0")
    got = sorted(tuple(r) for r in vs.top_k(base, queries, shard_rows=70).collect())
    assert got == brute(rows, [r for r in rows if r[0] % 50 == 0])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], "a"), (1, [0.5, 0.5], "b"), (2, None, "c"), (3, [None, 1.0], "d"), (4, [nan, 1.0], "e"), (5, [inf, 1.0], "f"), (None, [1.0, 1.0], "g"), (6, [], "h"), (1, [0.5, 0.5], "i"), (50, None, "j")]
    vectors = vs.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string"))
    got = vs.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 128 * 256 + 128 * 128)] * 2
    assert vs.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    assert sorted(map(tuple, vs.op3_ball_tree_topk(spark, "/root/testdata/sf0.01").collect())) == sorted(con.sql(vs.OP3_SQL).fetchall())


def test_looks_into_leaves_are_shared_by_queries(monkeypatch):
    """On noise, where no leaf can be left out, a query alone costs no ranking of its own for each leaf."""
    rng = np.random.default_rng(4)
    v = rng.integers(-128, 128, (4000, 32))
    ids, offered, offer = rng.permutation(4000), [], vs.Best.offer

    def count(self, query, scores, found):
        offered.append(scores.size)
        offer(self, query, scores, found)

    monkeypatch.setattr(vs.Best, "offer", count)
    shard = vs.Shard(ids, v, 5)
    best = shard.search(ids[:200], v[:200], 5, np.full(200, -np.inf))
    got = sorted((int(ids[i]), r + 1, int(best.id[i, r]), int(best.score[i, r])) for i in range(200) for r in range(5))
    assert got == brute(list(zip(ids.tolist(), v, strict=True)), list(zip(ids[:200].tolist(), v[:200], strict=True)))
    leaves = int((shard.tree.child < 0).sum())
    assert len(offered) <= 8 * leaves and sum(offered) < 200 * 200  # of 800,000 pairs


def test_scores_of_great_size_are_exact():
    rng = np.random.default_rng(9)
    v = rng.integers(2**24 - 40, 2**24, (600, 4))
    ids = np.arange(600)
    best = vs.Shard(ids, v, 5, 8).search(ids[:50], v[:50], 5, np.full(50, -np.inf))
    got = sorted((i, r + 1, int(best.id[i, r]), int(best.score[i, r])) for i in range(50) for r in range(5))
    assert got == brute(list(zip(ids.tolist(), v, strict=True)), list(zip(ids[:50].tolist(), v[:50], strict=True)))
