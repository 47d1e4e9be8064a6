import json

import pytest
from pyspark.sql import functions as F

from folioforge.operators import entities
from folioforge.plans.knowledge_base import KnowledgeBase, index
from folioforge.plans.stored import StoredKnowledge
from folioforge.streaming import catalog_state as states

CLEAN = "document_id string, source_url string, title string, markdown string, cleaned_at string"
DOCS = [
    ("d1", "https://a", "One", "Acme Corporation met Dr Jane Doe in Berlin. " * 3, "2024-01-01"),
    ("d2", "https://b", "Two", "place: Lake Erie; product: Widget. The Widget app is by Acme Corporation. " * 3, "2024-01-01"),
    ("d1", "https://a", "One", "person: Ada Lovelace (Countess). " * 2, "2024-01-03"),
    ("d3", "https://c", "Three", "near Paris " * 900, "2024-01-02"),
    ("d2", "https://b", "Two", "", "2024-01-02"),
]


def embed(text):
    return F.array(F.lit(1.0), F.length(text).cast("double"))


def tables(kb):
    out = [sorted(((r.chunk_id, r.text, r.title, r.indexed_at) for r in kb.chunks.rows().collect()))]
    out.append(sorted((r.entity_id, r.kind, r.name, r.aliases, tuple(r.seen)) for r in kb.vertices.rows().collect()))
    return [*out, sorted((r.chunk_id, r.entity_id) for r in kb.edges.rows().collect())]


def test_any_turn_and_redelivery_of_batches_give_the_same_chunks_and_edges(spark, tmp_path):
    seen = []
    for n, turn in enumerate([(DOCS[:2], DOCS[2:4], DOCS[4:]), (DOCS[2:], DOCS[:2], DOCS[2:4])]):
        kb = StoredKnowledge(spark, f"file://{tmp_path}/{n}", embed, buckets=2)
        for rows in turn:
            kb.ingest(spark.createDataFrame(rows, CLEAN))
        seen.append(tables(kb))
    assert seen[0][0] == seen[1][0] and seen[0][2] == seen[1][2]
    assert {r[0].split("-")[0] for r in seen[0][0]} and not any("Widget" in r[1] for r in seen[0][0])
    shared = {v[0] for v in seen[0][1]} & {v[0] for v in seen[1][1]}
    assert {e for _, e in seen[0][2]} <= shared
    assert [v for v in seen[0][1] if v[0] in shared] == [v for v in seen[1][1] if v[0] in shared]


def test_stored_base_answers_as_the_one_in_memory(spark, tmp_path):
    clean = spark.createDataFrame(DOCS[1:4], CLEAN)
    kb = StoredKnowledge(spark, f"file://{tmp_path}/kb", buckets=2)
    kb.ingest(clean)
    asked = spark.createDataFrame([("q1", "who is Ada Lovelace"), ("q2", "what is near Paris")], "question_id string, text string")
    memory = KnowledgeBase.of_chunks(index(clean))
    shown = lambda base: sorted((r.question_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in base.ask(asked, 3).collect())
    assert shown(kb.base()) == shown(memory) != []
    plan = kb.base().ask(asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan or "relation" in plan.lower()
    assert "pieces" not in plan  # no chunking of texts


def test_streamed_artifacts_are_ingested_once_and_bad_ones_kept_apart(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    artifact = lambda d, at, text: json.dumps({"schema_version": 1, "document_id": d, "source_url": "https://x", "title": "T", "markdown": text, "language": "eng", "cleaned_at": at})
    (inbox / "1.json").write_text(artifact("d1", "1", "in Berlin we met"))
    (inbox / "2.json").write_text("{broken")
    kb = StoredKnowledge(spark, f"file://{tmp_path}/kb", embed, buckets=2)
    run = lambda: kb.start(f"file://{inbox}", f"file://{tmp_path}/dead", f"file://{tmp_path}/cp").awaitTermination()
    run()
    first = tables(kb)
    assert len(first[0]) == 1 and first[2]
    (inbox / "3.json").write_text(artifact("d1", "2", "near Oslo they slept"))
    run()
    assert [r[1] for r in tables(kb)[0]] == ["near Oslo they slept"]
    assert spark.read.parquet(f"file://{tmp_path}/dead").count() == 1


def test_killed_between_tables_is_taken_up_again(spark, tmp_path, monkeypatch):
    kb = StoredKnowledge(spark, f"file://{tmp_path}/kb", embed, buckets=2)
    batch = spark.createDataFrame(DOCS[:2], CLEAN)
    with monkeypatch.context() as m:
        m.setattr(entities, "entities", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            kb.ingest(batch, 0)
    assert kb.chunks.version() == 0 and kb.edges.version() == -1
    kb.ingest(batch, 0)
    assert kb.chunks.version() == 0 and kb.edges.version() == 0 and kb.edges.rows().count() > 0


# catalog state

EVENTS = [
    ("a", 1, "scrape", "https://a", "A", "NEW", 0, None), ("a", 2, "clean", None, None, "CLEANED", None, None), ("a", 3, "index", None, None, "INDEXED", 7, None),
    ("a", 3, "graph", None, "Title of A", None, None, None), ("b", 5, "clean", None, None, "FAILED", None, "no text"), ("b", 4, "scrape", "https://b", "B", "NEW", 0, None),
    ("b", 9, "clean", None, None, "CLEANED", None, states.NO_ERROR), ("c", 1, "clean", None, None, "FAILED", None, "unknown"),
]
WANT = [("a", 1, 3, "https://a", "Title of A", "INDEXED", 7, None), ("b", 4, 9, "https://b", "B", "CLEANED", 0, None), ("c", 1, 1, None, None, "FAILED", None, "unknown")]


def test_rows_do_not_depend_on_the_turn_of_events(spark):
    for turn in (EVENTS, EVENTS[::-1], EVENTS + EVENTS[:3]):
        assert sorted(map(tuple, states.current(spark.createDataFrame(turn, states.EVENT)).collect())) == WANT


def test_stream_keeps_both_of_two_stages_updates_and_survives_a_restart(spark, tmp_path):
    source = tmp_path / "events"
    write = lambda n, rows: spark.createDataFrame(rows, states.EVENT).coalesce(1).write.parquet(f"file://{source}/{n}")
    held = states.catalog_table(spark, f"file://{tmp_path}/catalog", 4)

    def run():
        log = spark.readStream.schema(states.EVENT).parquet(f"file://{source}/*")
        states.start(log, held, f"file://{tmp_path}/cp").awaitTermination()
        return sorted(map(tuple, held.rows().drop("batch").collect()))

    write(0, [e for k, e in enumerate(EVENTS) if k % 2])
    run()
    write(1, [e for k, e in enumerate(EVENTS) if not k % 2])  # another stage's events, some of them earlier
    assert run() == WANT
    run()  # nothing new
    assert run() == WANT


def test_state_is_folded_without_python(spark, tmp_path):
    """Events are summed up before the shuffle and state rows never go through Python, whose cost per document was the stream's."""
    spark.createDataFrame(EVENTS, states.EVENT).write.parquet(f"file://{tmp_path}/events")
    log = spark.readStream.schema(states.EVENT).parquet(f"file://{tmp_path}/events")
    plan = states.states(log)._jdf.queryExecution().logical().toString()
    assert "Aggregate" in plan and "Pandas" not in plan and "Python" not in plan
