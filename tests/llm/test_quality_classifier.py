import numpy as np
import pytest

from folioforge.llm import quality_classifier as qc


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.random((60, 8)) < 0.5
    y = np.where(x[:, 0] ^ (rng.random(60) < 0.1), 1.0, -1.0)
    rows = [np.flatnonzero(r) for r in x]
    ratio = rng.normal(size=8)
    w, b = qc.fit_hinge(rows, y, ratio, cost=0.3, passes=400)
    costs = np.where(y > 0, 0.3 * 60 / (2 * (y > 0).sum()), 0.3 * 60 / (2 * (y < 0).sum()))
    dense = x * ratio
    primal = lambda w, b: 0.5 * (w @ w + b * b) + (costs * np.maximum(0, 1 - y * (dense @ w + b))).sum()
    best = primal(w, b)
    for _ in range(300):
        assert best <= primal(w + rng.normal(scale=0.05, size=8), b + rng.normal(scale=0.05)) + 1e-6


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_odd_rows(spark, monkeypatch, most):
    monkeypatch.setattr(qc, "BROADCAST_LABELS", most)
    rows = [(1, "good plain text here"), (2, "bad### text$$$ here&&&"), (3, None), (4, ""), (5, "x" * 100_000), (1, "good plain text here"), (None, "no id")]
    taught = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (5, 1), (5, 1), (99, 0)], "doc_id long, label int")
    docs = spark.createDataFrame([(1, "good plain text", 0.1), (1, "bad### x$$$", 0.2), (None, None, 0.3), (3, "", 0.4)], "doc_id long, text string, score double")
    model = qc.learn(taught, labels)
    got = qc.score(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (None, 3)}) == 1
    for few in (labels.limit(0), labels.filter("label = 1")):
        assert {0 <= r.score <= 1 for r in qc.score(docs, qc.learn(taught, few)).collect()} == {True}
    assert qc.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, sf):
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").select("doc_id", "quality")
    rows = qc.op2_quality_classifier(spark, f"/root/testdata/{sf}").filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
