import math

import pytest
from pyspark.sql import functions as F

from folioforge.functions import names, text, urls, vectors
from folioforge.operators import catalog, chunking, entities, evaluation, html, retrieval


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://Example.com:443", "https://example.com/"), ("http://a.b:8080/p?utm_source=x&q=1&UTM_Medium=y#f", "http://a.b:8080/p?q=1"), ("https://a.b/?fbclid=1", "https://a.b/"),
        ("https://a.b/?FBCLID=1", "https://a.b/?FBCLID=1"), ("https://a.b/?q=a%20b+c&e", "https://a.b/?q=a+b+c&e="), ("ftp://a.b/", None), ("nonsense", None), ("https:///x", None),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, url, urls.normalize_url) == want


def test_redirects(spark):
    assert one(spark, "https://s.com/l/?uddg=https%3A%2F%2Fa.b%2Fc&rut=1", urls.redirect_destination) == "https://a.b/c"
    assert one(spark, "https://s.com/ck?u=url%3dhttps%3a%2f%2fa.b%2fc%26mkt%3den", urls.redirect_destination) == "https://a.b/c"
    assert one(spark, "https://a.b/c", urls.redirect_destination) == "https://a.b/c"


def test_sanitize(spark):
    assert one(spark, "  a \n\n\n b\nimg DATA:x\n\n c \n", text.sanitize) == "a\n\nb\n\nc"
    assert one(spark, "a\n\ndata:\n\nb", text.sanitize) == "a\n\n\nb"
    assert one(spark, "one two  three\n", text.word_count) == 3


def test_terms_and_scores(spark):
    assert one(spark, "Graph-based a search, SEARCH é1 x", text.unique_terms) == ["graph", "based", "search", "é1"]
    score = lambda q, b, t: one(spark, q, lambda x: text.full_text_score(text.unique_terms(x), text.unique_terms(F.lit(b)), text.unique_terms(F.lit(t))))
    assert score("rust search", "Rust makes search fast", "rust search") == 1.0
    assert score("absent", "Rust makes search fast", "t") == 0.0 and score("?", "b", "t") == 0.0


def test_markup_and_sizes(spark):
    assert one(spark, "<a&\"'>", text.escape_markup) == "&lt;a&amp;&quot;&apos;&gt;"
    assert one(spark, "48.5MiB", text.memory_bytes) == int(48.5 * 2**20) and one(spark, "3 apples", text.memory_bytes) is None


def test_names(spark):
    assert names.plain_name("Ångström—Café  Ltd.") == "angstrom cafe ltd" and names.plain_name("...") is None
    assert abs(names.jaro_winkler("martha", "marhta") - 0.961111) < 1e-6 and abs(names.jaro_winkler("dixon", "dicksonx") - 0.813333) < 1e-6 and names.jaro_winkler("", "a") == 0.0
    assert one(spark, "organisation", names.entity_type) == "ORGANIZATION" and one(spark, "  (Ada  Lovelace). ", text.clean_name) == "Ada Lovelace"


def test_vectors(spark):
    import hashlib

    got = one(spark, "héllo", vectors.hash_embedding)
    want = [int.from_bytes(hashlib.sha256("héllo".encode() + i.to_bytes(8, "little")).digest()[:2], "little") / 65535 * 2 - 1 for i in range(384)]
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-12
    assert one(spark, [0.0, 0.0], lambda x: vectors.cosine(x, x), "array<double>") == 0.0
    assert abs(one(spark, [3.0, 4.0], lambda x: vectors.cosine(x, vectors.normalized(x)), "array<double>") - 1) < 1e-12
    assert abs(sum(x * x for x in one(spark, "seed", vectors.digest_vector)) - 1) < 1e-9
    assert one(spark, 1.0, lambda x: vectors.fuse(x, x, x), "double") == pytest.approx(1.0)


def test_chunks():
    sentence = "Thirteen char" + " "
    pieces = chunking.cut(sentence * 500)
    assert len(pieces) > 2 and all(len(p) <= 2400 for p in pieces)
    assert chunking.cut("x" * 5000) == ["x" * 2400, "x" * 2400, "x" * 680]
    assert chunking.cut("ab " * 50 + "y" * 5000)[-1].endswith("y") and chunking.cut(" \n") == [] and chunking.cut(None) == []
    assert chunking.cut("é " * 3000)[0] == ("é " * 1200).strip()


TEXTS = {
    "fields": "Person: Ada Lovelace (Countess). Organisation: Analytical Society aka AS; Place: London | Event= Great Exhibition\nConcept: Computing. Product: Engine",
    "words": "We met Dr Grace Hopper in New York; the Acme Bank Corporation signed the Paris Agreement at IBM 360 Hall. Uses the app engine Pro Max",
    "none": "Untyped Capitals Give Nothing here",
    "osaka": "Place: Osaka City.",
}


def brute_mentions(value):
    edge = lambda s: s.strip("".join({c for c in s if not (c.isalnum() or c in "'-_")}))
    tokens = []
    for raw in value.split():
        v = edge(raw)
        if v:
            letters = [c for c in v if c.isalpha()]
            tokens.append((v, v.lower(), (not letters) or letters[0].isupper() or any(c in "0123456789" for c in v), raw[-1] in ";|.:"))
    out = set()
    for i, (v, low, _, _) in enumerate(tokens):
        for kind, own in entities.SUFFIXES.items():
            if low in own:
                s = i
                while s > 0 and tokens[s - 1][2] and i - s < 4:
                    s -= 1
                if s < i:
                    out.add((kind, " ".join(t[0] for t in tokens[s : i + 1])))
        for kind, own in entities.CUES.items():
            if low in own and i + 1 < len(tokens) and (tokens[i + 1][2] or kind == "PRODUCT"):
                e = i + 2
                while e < len(tokens) and e - i - 1 < 5 and not tokens[e - 1][3] and tokens[e][2]:
                    e += 1
                out.add((kind, " ".join(t[0] for t in tokens[i + 1 : e])))
    return out


def test_mentions(spark):
    chunks = spark.createDataFrame(list(TEXTS.items()), "chunk_id string, text string")
    rows = entities.mentions(chunks).collect()
    for name in ("words", "none"):
        assert {(r.kind, r.surface) for r in rows if r.chunk_id == name} == brute_mentions(TEXTS[name])
    fields = {(r.kind, r.surface, r.canonical) for r in rows if r.chunk_id == "fields"}
    assert {("PERSON", "Ada Lovelace", None), ("PERSON", "Countess", "Ada Lovelace"), ("ORGANIZATION", "Analytical Society", None), ("ORGANIZATION", "AS", "Analytical Society"),
            ("LOCATION", "London", None), ("EVENT", "Great Exhibition", None), ("CONCEPT", "Computing", None), ("PRODUCT", "Engine", None)} <= fields
    assert {("LOCATION", "Os", None), ("LOCATION", "City", "Os")} <= {(r.kind, r.surface, r.canonical) for r in rows if r.chunk_id == "osaka"}
    resolved = entities.entities(entities.mentions(chunks))
    ada = resolved.filter("normalized = 'ada lovelace'").first()
    assert (ada.kind, ada.name) == ("PERSON", "Ada Lovelace") and ada.entity_id.startswith("entity-")
    vertices, edges = entities.graph(resolved)
    assert vertices.count() == resolved.select("entity_id").distinct().count() and edges.count() == resolved.count()


def test_mentions_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {}
    for r in entities.mentions(docs, "doc_id").collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.surface))
    for r in docs.collect():
        assert got.get(r.doc_id, set()) == brute_mentions(r.text)


def test_graph_scores(spark):
    questions = spark.createDataFrame([("q", "What about Ada Lovelace"), ("r", "nothing")], "question_id string, text string")
    paths = spark.createDataFrame([("c1", "Ada Lovelace", None), ("c1", "Ada", 2), ("c2", "London", 1)], "chunk_id string, name string, length int")
    got = [tuple(r) for r in retrieval.graph_scores(questions, paths).collect()]
    assert got == [("q", "c1", pytest.approx(2 / 4 + 1 / 4 / 2))]


def test_fusion_keeps_graph_rows_of_indexed_chunks_only(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "question_id string, chunk_id string, score double")
    indexed = spark.createDataFrame([("a",), ("b",), ("g",)], "chunk_id string")
    got = retrieval.hybrid_rank(rows(("q", "a", 1.0), ("q", "x", 0.0)), rows(("q", "b", 1.0)), rows(("q", "g", 1.0), ("q", "lost", 1.0), ("q", "x", 1.0)), indexed, 10).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [("a", 0.7), ("x", 0.45), ("b", 0.2), ("g", 0.1)]


def test_answers(spark):
    rows = spark.createDataFrame([("text", False), (" ", False), (None, False), ("text", True)], "t string, e boolean")
    cited = F.array(F.lit("c1"), F.lit("c2"))
    got = rows.select(retrieval.classify_answer(F.col("t"), F.col("e"), cited).alias("a")).withColumn("ok", retrieval.consistent(F.col("a"), cited)).collect()
    assert [(r.a.availability, r.a.grounding, len(r.a.citations), r.ok) for r in got] == [("available", "grounded", 2, True), ("available", "ungrounded", 0, True), ("available", "ungrounded", 0, True), ("unavailable", "ungrounded", 0, True)]
    prompt = spark.range(1).select(retrieval.render_prompt(F.lit("Why?"), F.array(F.struct(F.lit("c1").alias("chunk_id"), F.lit("Because.").alias("text"))))).first()[0]
    assert prompt.endswith("\n\nQuestion: Why?\n\nEvidence:\n[c1]\nBecause.\n\nAnswer concisely:")


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q", "c", 1), ("q", "b", 2), ("q", "a", 3)], "query_id string, chunk_id string, rank int")
    grades = spark.createDataFrame([("q", "a", 3), ("q", "b", 2), ("q", "c", 0), ("empty", "z", 0)], "query_id string, chunk_id string, grade int")
    got = {r.k: r for r in evaluation.ranking_metrics(ranked, grades).collect()}
    assert (got[1].recall, got[3].recall, got[3].mrr) == (0.0, 0.5, 0.25)
    want = (3 / math.log2(3) + 7 / 2) / (7 + 3 / math.log2(3)) / 2
    assert abs(got[3].ndcg - want) < 1e-12


def test_resolution_and_percentiles(spark):
    pairs = spark.createDataFrame([(1.0, True), (0.9875, True), (0.97, False), (None, False), (0.5, True)], "score double, expected boolean")
    sweep = evaluation.resolution_sweep(pairs, (0.95, 0.98, 1.0))
    rows = {r.threshold: (r.tp, r.fp, r.fn) for r in sweep.collect()}
    assert rows == {0.95: (2, 1, 1), 0.98: (2, 0, 1), 1.0: (1, 0, 2)}
    assert evaluation.best_threshold(sweep).first().threshold == 0.98
    values = spark.createDataFrame([(4.0,), (1.0,), (3.0,), (2.0,)], "v double")
    assert [evaluation.percentile(values, "v", p).first().value for p in (0.5, 0.95)] == [2.0, 4.0]
    assert spark.range(1).select(evaluation.index_gate(F.lit(1.0), F.lit(0.98), F.lit(5.0), F.lit(4.0))).first()[0]


def test_html():
    page = "<html><head><title>T</title></head><body><nav>menu</nav><article><h2>Head</h2><p>One <b>bold</b> <a href='/x'>link</a>.</p><ul><li>a</li><li>b</li></ul><script>no()</script></article></body></html>"
    assert html.to_markdown(page) == "## Head\n\nOne **bold** [link](/x).\n\n- a\n- b"


def test_catalog(spark):
    results = spark.createDataFrame([(1, "a", "https://x.y/?utm_a=1"), (2, "b", "https://x.y/"), (3, "", "https://z/"), (4, "d", "mailto:x"), (5, "e", "https://new/")], "position int, title string, url string")
    found = catalog.discover(results)
    assert {r.position: r.state for r in found.collect()} == {1: "enqueued", 2: "duplicate", 3: "skipped", 4: "skipped", 5: "enqueued"}
    known = found.filter("position = 5").select(F.col("document_id").alias("id"))
    assert tuple(catalog.scrape_counters(catalog.against_catalog(found, known)).first()) == (5, 1, 2, 2)
    pages = spark.createDataFrame([(f"{i:02d}", "NEW", "https://A/b", None) for i in range(5)], "id string, status string, source_url string, title string")
    page = catalog.list_documents(pages, 2, 2, "a/B", "new").collect()
    assert [r.id for r in page] == ["02", "03"] and page[0].next_cursor == 4
    assert catalog.list_documents(pages, 4, 2).first().next_cursor is None


def test_validation(spark):
    from folioforge.operators import validation

    assert validation.topic_request("  rust ") == ("rust", 5)
    for bad in (("", 1), ("x" * 201, 1), ("x", 0), ("x", 11)):
        with pytest.raises(ValueError):
            validation.topic_request(*bad)
    assert one(spark, "a_b-1", validation.collection_name, "string") and not one(spark, "a b", validation.collection_name, "string")
    docs = spark.createDataFrame([("a",), ("a",), ("b",)], "chunk_id string")
    grades = spark.createDataFrame([("q", "a", 4), ("q", "z", 1), ("r", "b", 0)], "query_id string, chunk_id string, grade int")
    assert {tuple(r) for r in validation.ranking_set(docs, grades).collect()} == {("repeated document", "a"), ("grade out of range", "q"), ("unknown document", "z"), ("query without relevant document", "r")}
    mention = "struct<name:string,entity_type:string>"
    pairs = spark.createDataFrame([("1", ("A", "person"), ("B", "person"), True), ("2", (" ", "person"), ("B", "other"), True)], f"id string, left {mention}, right {mention}, expected_same boolean")
    assert {tuple(r) for r in validation.resolution_set(pairs).collect()} == {("bad mention", "2"), ("one label only", "*")}
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0]), (3, [1.0, 0.0])], "vec_id int, embedding array<double>")
    assert {tuple(r) for r in validation.vector_set(points, 2).collect()} == {("zero vector", "1"), ("wrong dimension", "2")}


def test_ingest(spark):
    results = spark.createDataFrame([(i, f"t{i}", f"https://x.y/{i}") for i in range(4)], "position int, title string, url string")
    known = catalog.discover(results).filter("position = 0").select(F.col("document_id").alias("id"))
    new, counters = catalog.ingest(results, known, 3)
    assert sorted(r.title for r in new.collect()) == ["t1", "t2"] and counters.first().duplicate == 1


def test_only_words_around_marks_become_tokens(spark):
    """Words without letters count as none, edges are no part of a word, and windows end with the text."""
    texts = ["... Acme -- (Bank), plain words here IN: ;; Paris |New York", "in", "x in", "near Big Blue Old Far Wide Town", "a.in Paris", "One Two Three Four Five Six Treaty", "K in Berlin, … Rome", None, "", "app word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = sorted((r.k, r.kind, r.surface) for r in entities.mentions(docs, "k").collect())
    assert got == [
        (0, "LOCATION", "Paris New York"), (0, "ORGANIZATION", "Acme -- Bank"), (3, "LOCATION", "Big Blue Old Far Wide"), (5, "EVENT", "Three Four Five Six Treaty"), (6, "LOCATION", "Berlin Rome"), (9, "PRODUCT", "word"),
    ]
    sizes = docs.filter("k = 3").select(F.transform(entities.surroundings(F.col("text")), lambda f: F.size(f["own"])).alias("n")).first().n
    assert sizes == [6]


def test_chunks_leave_a_task_in_parts(spark, monkeypatch):
    """No task holds all chunks of a batch: parts have HELD characters or less and one chunk."""
    rows = [(i, "word é " * (300 * (i % 7)), [i], None if i % 2 else "t") for i in range(40)] + [(90, None, None, "x"), (91, " \n", [], "y")]
    docs = spark.createDataFrame(rows, "k long, body string, tags array<int>, title string").coalesce(1)
    want = sorted((k, tags, title, n, piece) for k, body, tags, title in rows for n, piece in enumerate(chunking.cut(body)))
    for held in (1, 5000, 1 << 20):
        monkeypatch.setattr(chunking, "HELD", held)
        got = chunking.chunks(docs, "k", "body", "tags", "title")
        assert sorted((r.k, r.tags, r.title, r.sequence, r.text) for r in got.collect()) == want
        assert got.columns == ["k", "tags", "title", "sequence", "text", "chunk_id"]
    assert {r.k: r.chunk_count for r in chunking.counts(docs, "k", "body").collect()} == {k: len(chunking.cut(body)) for k, body, *_ in rows}
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_all_entities_of_a_text_are_kept(spark):
    """However many names a text holds, each is an entity of it."""
    text = "; ".join(f"{kind}: Name {i}" for i in range(40) for kind in ("person", "place", "event"))
    resolved = entities.entities(entities.mentions(spark.createDataFrame([(1, text), (2, "person: Name 7")], "k long, text string"), "k"), "k")
    want = sorted([(1, kind, f"name {i}") for i in range(40) for kind in ("PERSON", "LOCATION", "EVENT")] + [(2, "PERSON", "name 7")])
    assert sorted((r.k, r.kind, r.normalized) for r in resolved.collect()) == want
    vertices, edges = entities.graph(resolved, "k")
    assert vertices.count() == 120 and edges.count() == 121
