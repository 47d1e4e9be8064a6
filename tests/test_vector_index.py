import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.operators import retrieval
from folioforge.operators.vector_index import VectorIndex, cell_count, fit

SCHEMA = "vec_id long, embedding array<double>"


def clusters(n, groups=20, dimension=16, seed=1, spread=0.15):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(groups, dimension))
    return centres[dice.integers(groups, size=n)] + spread * dice.normal(size=(n, dimension))


def frame(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in enumerate(vectors)], SCHEMA)


def queries(base):
    return base.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")


def brute(vectors, k):
    good = {i: np.asarray(v, dtype=float) for i, v in enumerate(vectors) if v is not None and np.isfinite(v).all()}
    out = []
    for q in (i for i in good if i % 10 == 0):
        score = lambda v, q=q: round(float(good[q] @ v / d), 9) if (d := np.linalg.norm(good[q]) * np.linalg.norm(v)) > 0 else 0.0
        ranked = sorted(((-score(v), i) for i, v in good.items() if i != q))[:k]
        out += [(q, i, round(-s, 6), r) for r, (s, i) in enumerate(ranked, 1)]
    return sorted(out)


def rows(found):
    return sorted((r.query_id, r.vec_id, round(r.cosine, 6), r.rank) for r in found.collect())


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    vectors = [*clusters(600), *[[0.0] * 16], *[clusters(1)[0]] * 30]  # a zero vector and many copies
    base = frame(spark, vectors)
    return vectors, base, VectorIndex.build(base, f"file://{tmp_path_factory.mktemp('index')}/v")


def test_exact_search_equals_brute_force(held):
    vectors, base, index = held
    assert rows(index.search(queries(base), 10, exclude_same=True)) == brute(vectors, 10)


def test_probes_read_their_partitions_alone(held):
    vectors, base, index = held
    asked = queries(base).filter("query_id = 0")
    cells = {r.cell for r in index.probed(asked, "query_id", 2).collect()}
    plan = index._found(index.probed(asked, "query_id", 2), 5, "query_id", True)._jdf.queryExecution().executedPlan().toString()
    assert len(cells) == 2 and "PartitionFilters: [cell" in plan


def test_gate_adopts_on_clustered_vectors_and_not_on_noise(spark, held, tmp_path):
    _, base, index = held
    good = index.gate(queries(base), 5, exclude_same=True).collect()
    assert any(r.adopted for r in good) and [r.recall for r in good] == sorted(r.recall for r in good)
    assert good[-1].probes > 1
    noise = frame(spark, np.random.default_rng(3).normal(size=(400, 48)))
    assert not any(r.adopted for r in VectorIndex.build(noise, f"file://{tmp_path}/v").gate(queries(noise), 10, exclude_same=True).collect())


def test_odd_vectors_take_no_part(spark, tmp_path):
    vectors = [[1.0, 0.0], None, [float("nan"), 1.0], [float("inf"), 1.0], [0.0, 1.0], [1.0, 1.0], [1.0, 0.0], [0.0, 0.0], [-1.0, 0.0], [2.0, 2.0], [1.0, 0.5]]
    base = frame(spark, vectors)
    index = VectorIndex.build(base, f"file://{tmp_path}/v")
    assert rows(index.search(queries(base), 4, exclude_same=True)) == brute(vectors, 4) == rows(retrieval.vector_rank(queries(base), base, 4, exclude_same=True))
    none = VectorIndex.build(base.limit(0), f"file://{tmp_path}/none")
    assert none.search(queries(base), 3).count() == 0 and none.gate(queries(base)).count() == 0


def test_blocks_equal_the_streamed_form(spark, monkeypatch):
    vectors = clusters(300, dimension=8)
    base = frame(spark, vectors)
    want = rows(retrieval.vector_rank(queries(base), base, 5, exclude_same=True))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "BASE_BLOCK", 50)
    assert rows(retrieval.vector_rank(queries(base), base, 5, exclude_same=True)) == want == brute(vectors, 5)


def test_cells_grow_with_the_root_of_the_rows():
    assert [cell_count(n) for n in (0, 1, 500, 10_000, 10**12)] == [1, 1, 16, 128, 4096]
    assert len(fit(np.array([[1.0, 0.0]] * 5), 4)) == 1
