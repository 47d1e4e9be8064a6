"""Every query with SQL gives the SQL's rows on the given tables."""

import glob
import math
import os
import re

import duckdb
import pytest

from folioforge.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(float(v), 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got = QUERIES[name](spark, DIR)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    own = rows(got.columns, got.collect())
    assert own == rows(want.columns, want.fetchall()) and own


def test_graph_signal_against_brute_force(spark):
    """Shares of question terms in the names of each document's entities, summed up to 1."""
    name = {}
    found = QUERIES["graph_mentions"](spark, DIR).collect()
    for r in sorted(found, key=lambda r: (r.doc_id, r.name)):
        name[r.entity_id] = r.name  # that of the greatest document
    terms = lambda t: {x.lower() for x in re.split(r"[\W_]+", t) if len(x) > 1}
    want = {}
    for q in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        asked = terms(q.text)
        for r in found:
            if both := asked & terms(name[r.entity_id]):
                want[q.item_id, r.doc_id] = want.get((q.item_id, r.doc_id), 0) + len(both) / len(asked)
    got = {(r.item_id, r.doc_id): r.graph_score for r in QUERIES["graph_signal"](spark, DIR).collect()}
    assert set(got) == set(want) and got and all(math.isclose(got[k], min(1, v), abs_tol=1e-8) for k, v in want.items())


def test_graph_signal_of_documents_with_many_entities(spark, tmp_path):
    """A question that asks for one of a document's many names finds it, wherever it stands in their order."""
    docs = [(d, ". ".join(f"We met Dr Name{i:03d}x{d} Own{i:03d}" for i in range(n)), "en", "web", 0) for d, n in ((1, 90), (2, 33), (3, 1))]
    asked = [(d * 1000 + i, f"Name{i:03d}x{d} or all") for d, n in ((1, 90), (2, 33), (3, 1)) for i in range(n)] + [(9, "Own032")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.item_id, r.doc_id): r.graph_score for r in QUERIES["graph_signal"](spark, str(tmp_path)).collect()}
    assert got == {(item, item // 1000): pytest.approx(1 / 3) for item, _ in asked if item > 9} | {(9, 1): 1.0, (9, 2): 1.0}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


@pytest.mark.parametrize("name", ["graph_signal", "hybrid_fusion"])
def test_entities_are_found_once(spark, name):
    """Vertices and edges read the stored entities; the texts are not looked through again for each."""
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "normalize_name" not in plan and "ArrowEvalPython" not in plan
