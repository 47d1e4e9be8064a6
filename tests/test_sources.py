import json
import os

import pytest
from pyspark.sql import functions as F

from folioforge.operators import html
from folioforge.plans.knowledge_base import KnowledgeBase, clean_pages
from folioforge.sources import artifacts, feeds
from folioforge.streaming import inbox

CLEAN = {"schema_version": 1, "document_id": "d", "source_url": "https://a/", "title": "t", "markdown": "m", "language": None, "cleaned_at": "1", "extra": 5}


def listed(rows):
    return [(r.title, r.url) for r in rows.orderBy("position").collect()]


def test_feeds(spark):
    body = lambda s: spark.createDataFrame([(s,)], "body string")
    rss = "<rss><channel><item><title>One</title><link>https://a.b/1?utm_x=1</link></item><item><title> </title><link>https://a.b/2</link></item><item><title><![CDATA[Two & 2]]></title><link>https://a.b/3</link></item></channel></rss>"
    assert listed(feeds.rss(body(rss))) == [("One", "https://a.b/1"), ("Two & 2", "https://a.b/3")]
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="https://a.b/e"/></entry></feed>'
    assert listed(feeds.rss(body(atom))) == [("E", "https://a.b/e")]
    found = [{"title": "A", "url": "https://a.b/?utm_source=s"}, {"title": "B", "url": "https://a.b/"}, {"title": "C", "url": "bad"}]
    assert listed(feeds.brave(body(json.dumps({"web": {"results": found}})))) == [("A", "https://a.b/")]
    for text in (json.dumps(found), json.dumps(json.dumps(found))):
        assert listed(feeds.duckduckgo(body(text))) == [("A", "https://a.b/")]


def test_settings():
    got = feeds.settings("provider: brave\nendpoint: ${HOST:-https://x}/s\n", {})
    assert (got.provider, got.endpoint) == ("brave", "https://x/s")
    for bad in ("provider: none", "extra: 1", "endpoint: ${HOST", "endpoint: ${HOST}"):
        with pytest.raises(ValueError):
            feeds.settings(bad, {})


def test_artifacts(spark):
    lines = [json.dumps(CLEAN), json.dumps(CLEAN | {"schema_version": 2}), "{oops", json.dumps(CLEAN | {"markdown": None})]
    good, dead = artifacts.parse(spark.createDataFrame([(x,) for x in lines], "value string"), "clean")
    assert [r.document_id for r in good.collect()] == ["d"]
    assert sorted(r.error for r in dead.collect()) == ["missing markdown", "undecodable", "unsupported version"]
    chunk = {"chunk_id": "c", "document_id": "d", "title": "t", "source_url": "u", "text": "old", "sequence": 0}
    both = [{"schema_version": 1, "document_id": "d", "source_url": "u", "title": "t", "chunks": [chunk | {"text": x}], "indexed_at": at} for x, at in (("old", "1"), ("new", "2"))]
    good, _ = artifacts.parse(spark.createDataFrame([(json.dumps(x),) for x in both], "value string"), "indexed")
    assert [(r.chunk_id, r.text) for r in artifacts.indexed_chunks(good).collect()] == [("c", "new")]
    with pytest.raises(Exception, match="embedding of dimension 2"):
        artifacts.points(spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>"), 3).collect()
    queue = spark.createDataFrame([("a",), ("b",)], "document_id string")
    assert [r.document_id for r in artifacts.pending(queue, queue.filter("document_id = 'a'")).collect()] == ["b"]


def test_catalog_scan_leaves_out_what_is_no_row(spark):
    row = {"id": "b", "sourceUrl": "https://a/", "title": None, "status": "new", "chunkCount": 0, "createdAt": "1", "lastProcessedAt": None, "error": "of its own"}
    lines = [json.dumps(row), "{oops", "", json.dumps(row | {"id": "a", "more": 1}), json.dumps(row | {"id": None}), json.dumps(row | {"chunkCount": "many"})]
    got = artifacts.catalog(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.id for r in got.collect()] == ["a", "b"] and got.columns == list(row)
    assert {r.error for r in got.collect()} == {"of its own"}


def test_pages_that_were_not_fetched_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(html, "MAX_BODY_BYTES", 4_000)
    body = "<p>" + " ".join(f"filler{i}" for i in range(30)) + "</p>"
    rows = [(f"https://a.b/{status}", "t", body, status) for status in (199, 200, 204, 299, 300, 404, None)]
    rows += [("https://a.b/long", "t", body + " " * 4_000, 200), ("https://a.b/null", "t", None, 200)]
    pages = spark.createDataFrame(rows, "url string, title string, html string, status int")
    assert sorted(r.source_url for r in clean_pages(pages).collect()) == ["https://a.b/200", "https://a.b/204", "https://a.b/299"]
    assert {r.source_url[12:] for r in clean_pages(pages.drop("status")).collect()} == {"199", "200", "204", "299", "300", "404", "None"}


def test_inbox_with_dead_letters_and_replay(spark, tmp_path):
    box, out, dead, check = (str(tmp_path / n) for n in ("inbox", "out", "dead", "check"))
    os.makedirs(box)
    put = lambda name, value: open(f"{box}/{name}", "w").write(value)
    put("a.json", json.dumps(CLEAN))
    put("b.json", "{oops")
    stage = lambda rows: rows.select("document_id", F.upper("markdown").alias("text"))
    run = lambda: inbox.start_stage(spark, box, "clean", stage, out, dead, check).awaitTermination()
    run()
    put("c.json", json.dumps(CLEAN | {"markdown": "newer"}))
    run()
    assert [(r.document_id, r.text) for r in inbox.results(spark, out, "document_id").collect()] == [("d", "NEWER")]
    assert [r.error for r in spark.read.parquet(dead).collect()] == ["undecodable"]
    assert inbox.replay(spark, dead, box, 5) == 1
    run()
    assert spark.read.parquet(dead).count() == 2


def test_running_metrics(spark, tmp_path):
    source = str(tmp_path / "events")
    spark.createDataFrame([("clean", True, 5), ("clean", False, 9), ("index", True, 2)], "process string, ok boolean, latency int").write.parquet(source)
    stream = spark.readStream.schema("process string, ok boolean, latency int").parquet(source)
    query = inbox.running_metrics(stream, "stage_log")
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("stage_log").collect()} == {("clean", 2, 1, 1, 14, 9), ("index", 1, 1, 0, 2, 2)}
    assert inbox.progress(query)["alive"] is False


def test_knowledge_base(spark):
    words = " ".join(f"filler{i}" for i in range(30))
    pages = spark.createDataFrame(
        [("https://a.b/1", "given", f"<html><head><title>Ada</title></head><body><p>Person: Ada Lovelace. {words} analytical engine</p></body></html>"), ("https://a.b/2", "Short", "<p>too short</p>"), ("https://a.b/3", "Other", f"<p>{words} in London harbour</p>")],
        "url string, title string, html string",
    )
    kb = KnowledgeBase.build(pages)
    questions = spark.createDataFrame([("q1", "Ada Lovelace analytical engine"), ("q2", "London harbour")], "question_id string, text string")
    best = {r.question_id: r for r in kb.ask(questions, 2).filter("rank = 1").collect()}
    assert best["q1"].title == "Ada" and best["q2"].source_url == "https://a.b/3"
    prompts = {r.question_id: r for r in kb.prompts(questions).collect()}
    assert len(prompts["q1"].cited) == 2 and "Question: London harbour" in prompts["q2"].prompt
