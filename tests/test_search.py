import json
import os

import pytest
from pyspark.sql import functions as F

from folioforge.sources import feeds, search

FEED = """<?xml version="1.0"?><rss><channel><title>all</title>
<item><title>One</title><link>https://a.b/1?utm_x=1</link></item><item><title> </title><link>https://a.b/2</link></item>
<item><title><![CDATA[Two & 2]]></title><link>https://a.b/3</link></item><item><title>One again</title><link>https://a.b/1</link></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>all</title><entry><title>E</title><link rel="self" href="https://a.b/self"/>
<link href="https://a.b/e"/></entry></feed>"""
FOUND = [{"title": "A", "url": "https://a.b/?utm_source=s"}, {"title": "B", "url": "https://a.b/"}, {"title": "C", "url": "bad"}, {"title": "D", "url": "https://s.t/l?uddg=https%3A%2F%2Fc.d%2Fx"}, {"title": None, "url": "https://e.f/"}]
BODIES = {
    "rss": {"1.xml": FEED, "2.xml": ATOM},
    "brave": {"1.json": json.dumps({"web": {"results": FOUND}})},
    "duckduckgo": {"1.json": json.dumps(FOUND), "2.json": json.dumps(json.dumps(FOUND[3:]))},
}


def put(folder, files, at=1_000):
    os.makedirs(folder, exist_ok=True)
    for name, body in files.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(body)
        os.utime(f"{folder}/{name}", (at, at))


def rows(df):
    return sorted((r.response, r.position, r.title, r.url) for r in df.collect())


@pytest.mark.parametrize("provider", sorted(BODIES))
def test_batch_gives_the_rows_of_the_parsers(spark, tmp_path, provider):
    search.register(spark)
    put(tmp_path / "in", BODIES[provider])
    got = rows(search.discovered(spark.read.format("search_results").option("provider", provider).load(str(tmp_path / "in")), unique=provider != "rss"))
    want = []
    for name, body in BODIES[provider].items():
        parsed = feeds.PROVIDERS[provider](spark.createDataFrame([(body,)], "body string"))
        want += [(name, r.position, r.title, r.url) for r in parsed.collect()]
    assert got == sorted(want) and got


def test_bad_responses_are_dead_letters(spark, tmp_path, monkeypatch):
    search.register(spark)
    bad = {"a.json": "{oops", "b.json": "{}", "c.json": json.dumps({"web": {"results": None}}), "d.json": "", "e.json": json.dumps([1]), "_tmp.json": "{", "f.json": " " * (feeds.MAX_BYTES + 1)}
    put(tmp_path / "in", bad | {"good.json": json.dumps({"web": {"results": [7, *FOUND]}})})
    found = spark.read.format("search_results").option("provider", "brave").load(str(tmp_path / "in"))
    assert sorted(r.response for r in search.failed(found).collect()) == ["a.json", "b.json", "c.json", "d.json", "e.json", "f.json"]
    assert {r.url for r in search.discovered(found).collect()} == {"https://a.b/", "https://c.d/x"}
    os.makedirs(tmp_path / "none")
    assert spark.read.format("search_results").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="unknown provider"):
        spark.read.format("search_results").option("provider", "none").load(str(tmp_path / "in")).count()


def test_files_are_dealt_to_tasks_by_bytes():
    files = [(f"f{i}", 20 << 20) for i in range(7)] + [("g", 200 << 20), ("h", 1)]
    parts = [p.files for p in search._dealt(files)]
    assert [x for p in parts for x in p] == files and [len(p) for p in parts] == [3, 3, 1, 1, 1]
    assert len(search._dealt([(f"s{i}", 0) for i in range(2049)])) == 3 and search._dealt([]) == []


def test_stream_reads_each_response_once(spark, tmp_path):
    search.register(spark)
    box, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = spark.readStream.format("search_results").option("provider", "rss").option("settle", 60).load(box)
        stream.writeStream.option("checkpointLocation", check).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
        return rows(search.discovered(spark.read.parquet(out), unique=False))

    put(box, {"1.xml": FEED})
    first = run()
    assert {r[0] for r in first} == {"1.xml"} and len(first) == 3
    assert run() == first  # nothing new
    put(box, {"2.xml": ATOM, "3.xml": "<rss><channel>"}, at=2_000)
    put(box, {"0.xml": ATOM}, at=500)  # copied in with an old time, as the docstring says
    with open(f"{box}/now.xml", "w") as f:  # not settled yet
        f.write(FEED)
    later = run()
    assert [r for r in later if r[0] == "2.xml"] == [("2.xml", 0, "E", "https://a.b/e")]
    assert [r for r in later if r[0] == "1.xml"] == first and not any(r[0] in ("now.xml", "0.xml") for r in later)
    dead = spark.read.parquet(out).filter(F.col("error").isNotNull()).collect()
    assert [r.response for r in dead] == ["3.xml"]
