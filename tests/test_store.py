import itertools

import pytest
from pyspark.sql import functions as F

from folioforge.sources import store

SCHEMA = "document_id string, chunk_id string, indexed_at string, text string"


def chunks(spark, document, at, *texts):
    rows = [(document, f"{document}-{k}", at, t) for k, t in enumerate(texts)] or [(document, None, at, None)]
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, path, buckets=8):
    return store.KeyedTable(spark, f"file://{path}", SCHEMA, "document_id", "chunk_id", "indexed_at", buckets)


def held(t):
    return sorted((r.chunk_id, r.indexed_at, r.text) for r in t.rows().collect())


def test_redelivery_and_shrinking_documents_leave_one_row_a_key(spark, tmp_path):
    t = table(spark, tmp_path)
    assert held(t) == []
    first = chunks(spark, "a", "1", "x", "y", "z").unionByName(chunks(spark, "b", "1", "p"))
    t.merge(first)
    want = held(t)
    t.merge(first)
    assert held(t) == want and len(want) == 4
    t.merge(chunks(spark, "a", "2", "new"))
    assert held(t) == [("a-0", "2", "new"), ("b-0", "1", "p")]
    t.merge(chunks(spark, "a", "1", "x", "y", "z"))  # late
    assert held(t) == [("a-0", "2", "new"), ("b-0", "1", "p")]
    t.merge(chunks(spark, "a", "3"))  # no chunks left
    t.merge(chunks(spark, "a", "2", "new"))
    assert held(t) == [("b-0", "1", "p")]
    assert [r.chunk_id for r in t.of_owners(["b", "none"]).collect()] == ["b-0"] and t.of_owners([]).count() == 0


def test_any_turn_of_batches_gives_the_same_table(spark, tmp_path):
    batches = [("a", "1", "x"), ("a", "2", "y", "z"), ("b", "1", "q"), ("a", "2", "other")]
    seen = set()
    for n, turn in enumerate(itertools.permutations(batches)):
        if n % 4 == 0:
            t = table(spark, tmp_path / str(n), 2)
            for b in turn:
                t.merge(chunks(spark, *b))
            seen.add(tuple(held(t)))
    assert len(seen) == 1


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = table(spark, tmp_path)
    for d in "abcdefgh":
        t.merge(chunks(spark, d, "1", d))
    before = t.folders()
    t.merge(chunks(spark, "a", "2", "new"))
    changed = [b for b, f in t.folders().items() if before[b] != f]
    assert len(changed) == 1 and len(before) > 2


def test_a_killed_merge_leaves_the_former_rows(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.merge(chunks(spark, "a", "1", "x"), 0, "s")
    want = held(t)

    def die(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(store.Manifests, "commit", die)
        with pytest.raises(OSError):
            t.merge(chunks(spark, "a", "2", "y"), 1, "s")
    assert held(t) == want
    bad = chunks(spark, "a", "3", "z").withColumn("text", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        t.merge(bad, 1, "s")
    assert held(t) == want
    assert t.merge(chunks(spark, "a", "2", "y"), 1, "s") and not t.merge(chunks(spark, "a", "2", "y"), 1, "s")
    assert held(t) == [("a-0", "2", "y")]
    assert t.vacuum(1) and held(t) == [("a-0", "2", "y")]


def test_of_two_writers_one_begins_again(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    commit = store.Manifests.commit

    def late(self, number, content):
        monkeypatch.setattr(store.Manifests, "commit", commit)
        other.merge(chunks(spark, "b", "1", "first"))
        commit(self, number, content)

    monkeypatch.setattr(store.Manifests, "commit", late)
    with pytest.raises(store.Conflict):
        t.merge(chunks(spark, "a", "1", "second"))
    t.merge(chunks(spark, "a", "1", "second"))
    assert held(t) == [("a-0", "1", "second"), ("b-0", "1", "first")]


def test_older_versions_can_be_read(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(chunks(spark, "a", "1", "x"))
    t.merge(chunks(spark, "a", "2", "y"))
    assert t.version() == 1 and [r.text for r in t.rows(0).collect()] == ["x"]


# derived tables


def test_rebuilt_equals_fresh_and_a_failure_leaves_the_old(spark, tmp_path):
    source = spark.range(20).withColumn("k", F.col("id") % 3)
    build = {"counts": lambda: source.groupBy("k").count(), "wide": lambda: source.filter("id > 100")}
    derived = store.DerivedTables(spark, f"file://{tmp_path}/d")
    with pytest.raises(ValueError):
        derived.table("counts")
    derived.rebuild(build)
    fresh = sorted(map(tuple, build["counts"]().collect()))
    assert sorted(map(tuple, derived.table("counts").collect())) == fresh and derived.table("wide").count() == 0

    def broken():
        raise OSError("in the middle")

    with pytest.raises(OSError):
        derived.rebuild({"counts": lambda: source.limit(0).groupBy("k").count(), "wide": broken})
    assert sorted(map(tuple, derived.table("counts").collect())) == fresh and derived.version() == 0
    derived.rebuild(build)
    assert derived.version() == 1 and derived.vacuum(1) and sorted(map(tuple, derived.table("counts").collect())) == fresh


def test_a_rebuild_waits_for_queued_work(spark, tmp_path):
    derived = store.DerivedTables(spark, f"file://{tmp_path}/d")
    queued, done = (spark.createDataFrame([(x,) for x in ids], "document_id string") for ids in ("ab", "a"))
    with pytest.raises(store.Pending):
        derived.rebuild({"n": lambda: queued}, queued, done)
    assert derived.version() == -1
    assert derived.rebuild({"n": lambda: queued}, queued, queued) == 0
