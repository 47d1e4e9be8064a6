"""Registered queries over the given tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import names, text, urls, vectors
from folioforge.operators import language as languages
from folioforge.operators import article, catalog, chunking, entities, evaluation, html, retrieval, validation, vector_index
from folioforge.sources import store
from folioforge.sources.tables import spread
from folioforge.streaming import catalog_state as states
from folioforge.streaming import inbox

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


TEXTS = {"documents", "pages"}  # whose rows take long


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared folder and read again, where several parts of a query need them."""
    path = store.shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# addresses and discovery

_URL = """
p AS (
  SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
    lower(regexp_extract(url, '^(?i)(https?)://', 1)) AS scheme,
    lower(regexp_extract(url, '^(?i)https?://([^/?#:]+)', 1)) AS host,
    regexp_extract(url, '^(?i)https?://[^/?#]*([^?#]*)', 1) AS path,
    list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT starts_with(x, 'fbclid=')) AS pairs
  FROM pages
), n AS (
  SELECT *, CASE WHEN host <> '' THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END END AS normalized FROM p
)"""
_STATE = f"""WITH {_URL}, s AS (
  SELECT page_id, normalized, sha256(normalized) AS document_id,
    CASE WHEN normalized IS NULL OR trim(title) = '' THEN 'skipped'
      WHEN row_number() OVER (PARTITION BY normalized, (normalized IS NOT NULL AND trim(title) <> '') ORDER BY page_id) > 1 THEN 'duplicate' ELSE 'enqueued' END AS state FROM n
)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("position"), html.title(F.col("html")).alias("title"), "url")


@query(f"WITH {_URL} SELECT page_id, normalized AS normalized_url FROM n")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normalized_url"))


@query(f"WITH {_URL} SELECT page_id, sha256(normalized) AS document_id FROM n")
def document_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.document_id(urls.normalize_url(F.col("url"))).alias("document_id"))


@query(f"{_STATE} SELECT page_id, document_id, state FROM s")
def discover_dedupe(spark, sf_dir):
    return catalog.discover(_results(spark, sf_dir)).select(F.col("position").alias("page_id"), "document_id", "state")


@query(f"{_STATE} SELECT count(*) AS discovered, count_if(state = 'enqueued')::BIGINT AS enqueued, count_if(state = 'duplicate')::BIGINT AS duplicate, count_if(state = 'skipped')::BIGINT AS skipped FROM s")
def scrape_counters(spark, sf_dir):
    return catalog.scrape_counters(catalog.discover(_results(spark, sf_dir)))


# pages


_ARTICLE = """
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(
  regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS article FROM pages
"""


@query(_ARTICLE)
def article_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.article_text(F.col("html")).alias("article"))


@query(_ARTICLE)
def main_text(spark, sf_dir):
    """The main text found by its blocks: the authors' article elements are made plain ones first, and have to be found again."""
    unmarked = F.regexp_replace("html", r"(?i)(</?)article\b", "$1div")
    return table(spark, sf_dir, "pages").select("page_id", html.plain(article.main_part(unmarked)).alias("article"))


@query("""
WITH t AS (SELECT page_id, url, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g') AS title FROM pages)
SELECT page_id, CASE WHEN title = '' THEN url ELSE title END AS title FROM t
""")
def title_fallback(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title_or(html.title(F.col("html")), F.col("url")).alias("title"))


@query()
def html_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.markdown("html").alias("markdown"))


@query("SELECT count(html) AS files, sum(strlen(html))::BIGINT AS bytes FROM pages")
def raw_usage(spark, sf_dir):
    return catalog.raw_usage(table(spark, sf_dir, "pages"))


# texts

_SANITIZED = """
l AS (SELECT doc_id, [regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split(text, chr(10))] AS lines FROM documents),
k AS (SELECT doc_id, regexp_replace(array_to_string([lines[i] FOR i IN range(1, len(lines) + 1)
  IF NOT contains(lower(lines[i]), 'data:') AND NOT (lines[i] = '' AND i > 1 AND lines[i - 1] = '')], chr(10)), '^\\s+|\\s+$', '', 'g') AS text FROM l)"""


@query(f"WITH {_SANITIZED} SELECT doc_id, sha256(text) AS digest, length(text) AS n_chars FROM k")
def sanitize(spark, sf_dir):
    clean = table(spark, sf_dir, "documents").select("doc_id", text.sanitize(F.col("text")).alias("text"))
    return clean.select("doc_id", F.sha2("text", 256).alias("digest"), F.char_length("text").cast("long").alias("n_chars"))


@query(f"WITH {_SANITIZED}, w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM k) SELECT doc_id, n AS n_words, n >= 20 AS accepted FROM w")
def quality_gate(spark, sf_dir):
    n = text.word_count(text.sanitize(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_words"), (n >= text.MIN_WORDS).alias("accepted"))


_LANGUAGE = ", ".join(
    f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(s) for s in own)}], x))) AS {code}" for code, own in sorted(text.STOP_WORDS.items())
)


@query(f"""
WITH t AS (SELECT doc_id, [regexp_replace(lower(x), '[.,;:!?]+$', '') FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''] AS w FROM documents),
c AS (SELECT doc_id, {_LANGUAGE} FROM t)
SELECT doc_id, CASE WHEN greatest(deu, eng, fra, spa) = 0 THEN NULL WHEN deu = greatest(deu, eng, fra, spa) THEN 'deu' WHEN eng = greatest(deu, eng, fra, spa) THEN 'eng'
  WHEN fra = greatest(deu, eng, fra, spa) THEN 'fra' ELSE 'spa' END AS language FROM c
""")
def language_guess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.language(F.col("text")).alias("language"))


@query(languages.detect_sql("documents"))
def language_profiles(spark, sf_dir):
    """Languages by scripts and by trigram profiles learnt from all labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages.detect(docs, languages.profiles(docs))


_CHUNKS = """
RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
w AS (
  SELECT doc_id, t, 0::BIGINT AS s, length(t) AS n, length(regexp_extract(substring(t, 242, 2159), '(?s)^(.*)\\s', 1)) AS back,
    regexp_matches(substring(t, 242, 2159), '\\s') AS has FROM d WHERE t <> ''
  UNION ALL
  SELECT doc_id, t, e - 240, n, length(regexp_extract(substring(t, e - 240 + 242, 2159), '(?s)^(.*)\\s', 1)), regexp_matches(substring(t, e - 240 + 242, 2159), '\\s')
  FROM (SELECT *, CASE WHEN s + 2400 >= n THEN n WHEN has THEN s + 241 + back ELSE s + 2400 END AS e FROM w) x WHERE e < n
), p AS (
  SELECT doc_id, s, regexp_replace(substring(t, s + 1, (CASE WHEN s + 2400 >= n THEN n WHEN has THEN s + 241 + back ELSE s + 2400 END) - s), '^\\s+|\\s+$', '', 'g') AS piece FROM w
), c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS sequence, piece FROM p WHERE piece <> '')"""


@query(f"WITH {_CHUNKS} SELECT doc_id, sequence::INTEGER AS sequence, sha256(doc_id || ':' || sequence) AS chunk_id, sha256(piece) AS digest FROM c")
def chunk(spark, sf_dir):
    rows = chunking.chunks(table(spark, sf_dir, "documents").withColumn("body", F.col("text")).drop("text"), "doc_id", "body")
    return rows.select("doc_id", "sequence", "chunk_id", F.sha2("text", 256).alias("digest"))


@query(f"WITH {_CHUNKS} SELECT doc_id, count(*) AS chunk_count FROM c GROUP BY doc_id")
def chunk_count(spark, sf_dir):
    return chunking.counts(table(spark, sf_dir, "documents"), "doc_id", "text").filter("chunk_count > 0")


@query("""
SELECT item_id, i::INTEGER AS dim, round((('0x' || substr(h, 3, 2) || substr(h, 1, 2))::INTEGER)::DOUBLE / 65535 * 2 - 1, 9) AS value
FROM (SELECT item_id, i, sha256(encode(text) || unhex(printf('%02x%02x000000000000', i % 256, i // 256))) AS h FROM benchmark, range(384) r(i))
""")
def hash_embedding(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(vectors.hash_embedding(F.col("text"))).alias("dim", "value"))
    return rows.withColumn("value", F.round("value", 9))


# retrieval

_TERMS = "list_distinct([lower(x) FOR x IN regexp_split_to_array({0}, '[^\\p{{L}}\\p{{N}}]+') IF length(x) > 1])"
_RANKED = f"""
q AS (SELECT item_id, {_TERMS.format('text')} AS terms FROM benchmark),
b AS (SELECT doc_id, {_TERMS.format('text')} AS body, {_TERMS.format('source')} AS title FROM documents),
m AS (SELECT item_id, doc_id, least(1.0, len(list_intersect(terms, body)) / len(terms)::DOUBLE * 0.8 + len(list_intersect(terms, title)) / len(terms)::DOUBLE * 0.2) AS score FROM q, b WHERE len(terms) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM m WHERE score > 0)"""


@query(f"SELECT doc_id, len({_TERMS.format('text')})::BIGINT AS n_terms FROM documents")
def term_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.unique_terms(F.col("text"))).cast("long").alias("n_terms"))


def _text_rank(spark, sf_dir, k):
    return retrieval.full_text_rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k, "item_id", "doc_id", title="source")


@query(f"WITH {_RANKED} SELECT item_id, doc_id, round(score, 9) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def fulltext_rank(spark, sf_dir):
    return _text_rank(spark, sf_dir, 5).select("item_id", "doc_id", F.round("text_score", 9).alias("score"), "rank")


_COSINE = """
e AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, q.label AS query_label, b.vec_id, b.label, round(list_cosine_similarity(q.v, b.v), 9) AS cosine FROM e q, e b WHERE q.vec_id % 50 = 0 AND b.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s)"""


def _neighbours(spark, sf_dir, k):
    base = table(spark, sf_dir, "embeddings")
    return retrieval.vector_rank(base.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), base, k, exclude_same=True)


@query(f"WITH {_COSINE} SELECT vec_id, round(cosine, 6) AS cosine, rank::INTEGER AS rank FROM r WHERE query_id = 0 AND rank <= 10")
def vector_topk_exact(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    one = base.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.vector_rank(one, base, 10, exclude_same=True).select("vec_id", F.round("cosine", 6).alias("cosine"), "rank")


@query(f"WITH {_COSINE} SELECT query_id, vec_id, round(cosine, 6) AS cosine, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def vector_topk_batch(spark, sf_dir):
    return _neighbours(spark, sf_dir, 5).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")


def _vector_index(spark, sf_dir):
    return vector_index.VectorIndex.build(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), store.shared_path(spark, "vector_index"))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")


@query(f"WITH {_COSINE} SELECT query_id, vec_id, round(cosine, 6) AS cosine, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def vector_index_topk(spark, sf_dir):
    """Search of the cell index up to its bounds, which is exact."""
    found = _vector_index(spark, sf_dir).search(_asked(spark, sf_dir), 10, exclude_same=True)
    return found.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")


@query()
def vector_index_gate(spark, sf_dir):
    """What share of the exact neighbours each number of probed cells finds, what it reads, and whether it may be adopted."""
    return _vector_index(spark, sf_dir).gate(_asked(spark, sf_dir), 10, exclude_same=True)


_PRODUCTS = ", ".join(repr(w) for w in entities.CUES["PRODUCT"])
_PLACES = f"""
p AS (SELECT doc_id, array_to_string([lower(x) FOR x IN regexp_extract_all(text, '[A-Za-z]+')[1:4]], ' ') AS name FROM documents),
h AS (SELECT doc_id, {_TERMS.format('name')} AS names FROM p WHERE name <> '' AND NOT contains(name, 'aka ') AND NOT contains(name, 'also known as ') AND NOT list_has_any(string_split(name, ' '), [{_PRODUCTS}])),
g AS (SELECT item_id, doc_id, least(1.0, len(list_intersect(terms, names)) / len(terms)::DOUBLE) AS g FROM q, h WHERE len(terms) > 0)"""


def _named_places(spark, sf_dir):
    """Graph paths of the documents' first four words, written out as the field of a place; names that would read as aliases or products are left out."""
    words = F.transform(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 4), F.lower)
    named = table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("name"))
    clear = ~F.contains("name", F.lit("aka ")) & ~F.contains("name", F.lit("also known as ")) & ~F.arrays_overlap(F.split("name", " "), F.array(*[F.lit(w) for w in entities.CUES["PRODUCT"]]))
    typed = named.filter((F.col("name") != "") & clear).select("doc_id", F.concat(F.lit("place: "), "name").alias("text"))
    vertices, edges = entities.graph(stored(entities.entities(entities.mentions(typed, "doc_id"), "doc_id"), "entities"), "doc_id")
    return retrieval.graph_paths(edges, vertices, "doc_id")


@query(f"""
WITH {_RANKED}, {_COSINE.replace("r AS (", "n AS (").replace("q.vec_id % 50 = 0 AND b.vec_id <> q.vec_id", "q.vec_id IN (SELECT item_id FROM benchmark)")}, {_PLACES},
u AS (
  SELECT query_id AS item_id, vec_id AS doc_id, least(1, greatest(0, (cosine + 1) / 2)) AS v, 0.0 AS t, 0.0 AS g FROM n WHERE rank <= 10
  UNION ALL SELECT item_id, doc_id, 0.0, score, 0.0 FROM r WHERE rank <= 10
  UNION ALL SELECT item_id, doc_id, 0.0, 0.0, g FROM g WHERE g > 0
), f AS (SELECT item_id, doc_id, least(1, greatest(0, 0.7 * max(v) + 0.2 * max(t) + 0.1 * max(g))) AS score FROM u GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f)
SELECT item_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM z WHERE rank <= 10
""")
def hybrid_fusion(spark, sf_dir):
    """Text, vector and graph signals; embeddings stand in for the chunks' and questions' vectors by id, a document's first words for a place that it names."""
    base = table(spark, sf_dir, "embeddings")
    asked = base.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "item_id")
    by_vector = retrieval.vector_rank(asked, base.withColumnRenamed("vec_id", "doc_id"), 10, "item_id", "doc_id").select("item_id", "doc_id", F.col("cosine").alias("score"))
    by_text = _text_rank(spark, sf_dir, 10).select("item_id", "doc_id", F.col("text_score").alias("score"))
    by_graph = retrieval.graph_scores(table(spark, sf_dir, "benchmark"), _named_places(spark, sf_dir), "item_id", "doc_id").select("item_id", "doc_id", F.col("graph_score").alias("score"))
    fused = retrieval.hybrid_rank(by_vector, by_text, by_graph, table(spark, sf_dir, "documents").select("doc_id"), 10, "item_id", "doc_id")
    return fused.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query()
def graph_mentions(spark, sf_dir):
    found = entities.mentions(table(spark, sf_dir, "documents"), "doc_id")
    return entities.entities(found, "doc_id").select("doc_id", "entity_id", "kind", "name", F.array_join("aliases", "|").alias("aliases"))


@query()
def graph_signal(spark, sf_dir):
    vertices, edges = entities.graph(stored(entities.entities(entities.mentions(table(spark, sf_dir, "documents"), "doc_id"), "doc_id"), "entities"), "doc_id")
    scores = retrieval.graph_scores(table(spark, sf_dir, "benchmark"), retrieval.graph_paths(edges, vertices, "doc_id"), "item_id", "doc_id")
    return scores.select("item_id", "doc_id", F.round("graph_score", 9).alias("graph_score"))


# evaluation


@query("""
WITH p AS (SELECT a.c_nationkey = b.c_nationkey AS expected, jaro_winkler_similarity(lower(replace(a.c_name, '#', ' ')), lower(replace(b.c_name, '#', ' '))) AS score
  FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 AND a.c_mktsegment = b.c_mktsegment),
t AS (SELECT unnest([0.8, 0.9, 0.97, 1.0])::DOUBLE AS threshold),
c AS (SELECT threshold, count_if(score >= threshold AND expected)::BIGINT AS tp, count_if(score >= threshold AND NOT expected)::BIGINT AS fp, count_if(score < threshold AND expected)::BIGINT AS fn FROM p, t GROUP BY threshold),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM c)
SELECT threshold, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM m
""")
def er_sweep(spark, sf_dir):
    """Neighbouring customers stand in for labelled mention pairs; the segment is their type."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", names.normalize_name("c_name").alias("name"))
    right = rows.select((F.col("c_custkey") - 1).alias("c_custkey"), "c_mktsegment", F.col("name").alias("other"), F.col("c_nationkey").alias("nation"))
    none = F.array().cast("array<string>")
    pairs = rows.join(right, ["c_custkey", "c_mktsegment"])
    score = evaluation.pair_score(F.lit(True), F.col("name"), F.col("other"), none, none, names.name_similarity("name", "other"))
    sweep = evaluation.resolution_sweep(pairs.select((F.col("c_nationkey") == F.col("nation")).alias("expected"), score.alias("score")), (0.8, 0.9, 0.97, 1.0))
    return sweep.select("threshold", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""
WITH {_COSINE}, g AS (SELECT *, count_if(label = query_label) OVER (PARTITION BY query_id) AS n FROM r),
k AS (SELECT unnest([1, 3, 5]) AS k),
a AS (
  SELECT query_id, k, count_if(rank <= k AND label = query_label) / nullif(max(n), 0)::DOUBLE AS recall, 1.0 / min(CASE WHEN label = query_label AND rank <= 10 THEN rank END) AS rr,
    sum(CASE WHEN rank <= k AND label = query_label THEN 1 / log2(rank + 1) END) AS dcg, sum(CASE WHEN rank <= least(k, n) THEN 1 / log2(rank + 1) END) AS ideal
  FROM (SELECT * FROM g WHERE rank <= 10 OR label = query_label), k GROUP BY query_id, k
)
SELECT k, round(avg(coalesce(recall, 0)), 9) AS recall, round(avg(coalesce(rr, 0)), 9) AS mrr, round(avg(coalesce(dcg / ideal, 0)), 9) AS ndcg FROM a WHERE query_id IN (SELECT query_id FROM g WHERE label = query_label) GROUP BY k
""")
def recall_mrr_ndcg(spark, sf_dir):
    """Exact top 10 judged by equal labels."""
    base = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    scores = evaluation.class_metrics(_neighbours(spark, sf_dir, 10), base, key="vec_id")
    return scores.select("k", *[F.round(c, 9).alias(c) for c in ("recall", "mrr", "ndcg")])


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentile(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95")
    )


# answers


@query("""
SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN 'unavailable' ELSE 'available' END AS availability,
  CASE WHEN role = 'assistant' AND regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> '' THEN 'grounded' ELSE 'ungrounded' END AS grounding,
  CASE WHEN role = 'assistant' AND regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> '' THEN 1 ELSE 0 END AS n_citations, true AS consistent FROM conversations
""")
def answer_classify(spark, sf_dir):
    """Assistant turns stand in for replies, other turns for failed calls; each shows the chunk of its conversation."""
    shown = F.array(F.col("conv_id").cast("string"))
    rows = table(spark, sf_dir, "conversations").withColumn("answer", retrieval.classify_answer(F.col("text"), F.col("role") != "assistant", shown))
    return rows.select("conv_id", "turn", "answer.availability", "answer.grounding", F.size("answer.citations").alias("n_citations"), retrieval.consistent(F.col("answer"), shown).alias("consistent"))


@query(f"""
WITH {_RANKED}, e AS (SELECT item_id, string_agg('[' || doc_id || ']' || chr(10) || d.text, chr(10) || chr(10) ORDER BY rank) AS evidence FROM r JOIN documents d USING (doc_id) WHERE rank <= 3 GROUP BY item_id)
SELECT item_id, sha256('{retrieval.PROMPT}' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Evidence:' || chr(10) || evidence || chr(10) || chr(10) || 'Answer concisely:') AS prompt_digest
FROM e JOIN benchmark USING (item_id)
""")
def prompt_render(spark, sf_dir):
    ranked = _text_rank(spark, sf_dir, 3).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    shown = ranked.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("chunk_id"), "text"))).alias("evidence"))
    prompt = retrieval.render_prompt(F.col("text"), F.col("evidence"))
    return table(spark, sf_dir, "benchmark").join(shown, "item_id").select("item_id", F.sha2(prompt, 256).alias("prompt_digest"))


# catalog; orders stand in for its documents, events for stage logs


def _catalog(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("https://example.com/"), F.col("o_custkey")).alias("source_url"), F.col("o_orderpriority").alias("title")
    )


@query("SELECT o_orderstatus AS status, count(*) AS documents FROM orders GROUP BY 1")
def catalog_status_counts(spark, sf_dir):
    return catalog.status_counts(_catalog(spark, sf_dir))


@query("""
SELECT o_orderkey AS id, o_orderstatus AS status, 'https://example.com/' || o_custkey AS source_url, o_orderpriority AS title, CASE WHEN count(*) OVER () = 25 THEN 75 END::INTEGER AS next_cursor
FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'urgent') ORDER BY o_orderkey LIMIT 25 OFFSET 50)
""")
def catalog_page(spark, sf_dir):
    return catalog.list_documents(_catalog(spark, sf_dir), 50, 25, "URGENT", "f")


@query("""
SELECT o_orderkey AS id, 'CLEAN' AS stage, coalesce(c_mktsegment, 'NEW') AS status, coalesce(c_name, '') AS title
FROM orders LEFT JOIN customer ON o_orderkey = c_custkey
""")
def queue_left_join(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("title"))
    queued = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(catalog.STAGES["indexer"]).alias("stage"))
    return catalog.queue_items(queued, known)


@query("""
SELECT event_type AS stage, count_if(value < 20)::BIGINT AS PENDING, count_if(value >= 20 AND value < 80)::BIGINT AS DONE, count_if(value >= 80)::BIGINT AS FAILED, count(*) AS total FROM events GROUP BY 1
""")
def stage_pivot(spark, sf_dir):
    status = F.when(F.col("value") < 20, "PENDING").when(F.col("value") < 80, "DONE").otherwise("FAILED")
    return catalog.stage_pivot(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), status.alias("status")), ("PENDING", "DONE", "FAILED"))


@query("""
SELECT event_type AS process, count(*) AS input_count, count_if(event_type <> 'error')::BIGINT AS output_count, count_if(event_type = 'error')::BIGINT AS failure_count,
  round(sum(value), 2) AS total_latency, arg_max(value, (ts, value)) AS last_latency, max(value) AS max_latency FROM events GROUP BY 1
""")
def stage_metrics(spark, sf_dir):
    failed = (F.col("event_type") == "error").cast("long")
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("process"), "ts", F.lit(1).cast("long").alias("inputs"), (1 - failed).alias("outputs"), failed.alias("failures"), F.col("value").alias("latency"))
    return catalog.stage_metrics(log).withColumn("total_latency", F.round("total_latency", 2)).drop("updated_at")


@query("""
SELECT CASE WHEN count_if(epoch(m) - epoch(ts) < 86400) = 0 THEN 'offline' WHEN count_if(epoch(m) - epoch(ts) >= 86400) = 0 THEN 'healthy' ELSE 'degraded' END AS health
FROM (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1), (SELECT max(ts) AS m FROM events)
""")
def health(spark, sf_dir):
    """Users stand in for workers, a day for the heartbeat's limit."""
    events = table(spark, sf_dir, "events")
    beats = events.groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("beat"))
    latest = events.agg(F.max("ts").cast("timestamp").alias("now"))
    return catalog.health(beats.crossJoin(F.broadcast(latest)), F.col("now"), 86400)


@query("""
SELECT coalesce(d.status, q.status) AS status, coalesce(documents, 0) AS documents, coalesce(queued, 0) AS queued
FROM (SELECT c_mktsegment AS status, count(*) AS documents FROM customer GROUP BY 1) d
FULL JOIN (SELECT coalesce(c_mktsegment, 'NEW') AS status, count(*) AS queued FROM orders LEFT JOIN customer ON o_orderkey = c_custkey GROUP BY 1) q ON d.status = q.status
""")
def overview(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("title"))
    queued = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("CLEAN").alias("stage"))
    return catalog.overview(known, queued)


@query("SELECT CASE WHEN value < 20 THEN 'PENDING' WHEN value < 80 THEN 'DONE' ELSE 'FAILED' END AS status, count(*) AS jobs FROM events GROUP BY 1")
def status_totals(spark, sf_dir):
    status = F.when(F.col("value") < 20, "PENDING").when(F.col("value") < 80, "DONE").otherwise("FAILED")
    return catalog.status_totals(table(spark, sf_dir, "events").select(status.alias("status")))


@query("""
SELECT problem, count(*) AS n FROM (
  SELECT 'wrong dimension' AS problem FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64
  UNION ALL SELECT 'unknown document' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
  UNION ALL SELECT 'grade out of range' FROM labels WHERE quality IS NULL OR quality NOT BETWEEN 0 AND 3
  UNION ALL SELECT 'query without relevant document' FROM labels GROUP BY toxic HAVING max(quality) <= 0
  UNION ALL SELECT 'repeated document' FROM documents GROUP BY doc_id HAVING count(*) > 1
  UNION ALL SELECT 'repeated point' FROM embeddings GROUP BY vec_id HAVING count(*) > 1
) GROUP BY 1 UNION ALL SELECT 'checked', (SELECT count(*) FROM labels) + (SELECT count(*) FROM embeddings)
""")
def dataset_validate(spark, sf_dir):
    """Labels stand in for judgements (toxic as the query), embeddings for index points."""
    labels, points = table(spark, sf_dir, "labels"), table(spark, sf_dir, "embeddings")
    judged = labels.select(F.col("toxic").alias("query_id"), "doc_id", F.col("quality").alias("grade"))
    found = validation.ranking_set(table(spark, sf_dir, "documents").select("doc_id"), judged, "doc_id").unionByName(validation.vector_set(points, 64))
    checked = labels.select(F.lit(1)).unionAll(points.select(F.lit(1))).agg(F.count("*").alias("n")).select(F.lit("checked").alias("problem"), "n")
    return found.groupBy("problem").agg(F.count("*").alias("n")).unionByName(checked)


@query("""
SELECT event_type AS process, count(*) AS input_count, count_if(event_type <> 'error')::BIGINT AS output_count, count_if(event_type = 'error')::BIGINT AS failure_count,
  round(sum(value), 2) AS total_latency, max(value) AS max_latency FROM events GROUP BY 1
""")
def stream_stage_metrics(spark, sf_dir):
    """The events as a stream, summed up by micro-batches until all is read."""
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    log = rows.select(F.col("event_type").alias("process"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"))
    name = f"stage_log_{uuid.uuid4().hex}"
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    inbox.running_metrics(log, name, f"{root}/{name}" if root else None).awaitTermination()
    return spark.table(name).withColumn("total_latency", F.round("total_latency", 2))


_EVENTS = """
e AS (SELECT user_id::VARCHAR AS id, event_id AS seq, event_type AS stage, CASE WHEN event_type = 'signup' THEN 'https://example.com/' || user_id END AS source_url, CASE WHEN event_type = 'view' THEN props END AS title,
  upper(event_type) AS status, CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT END AS chunk_count, CASE event_type WHEN 'error' THEN props WHEN 'signup' THEN '' END AS error FROM events)"""
_CURRENT = f"""WITH {_EVENTS}
SELECT id, min(seq) AS created_at, max(seq) AS processed_at, arg_max(source_url, seq) FILTER (source_url IS NOT NULL) AS source_url, arg_max(title, seq) FILTER (title IS NOT NULL) AS title, arg_max(status, seq) AS status,
  arg_max(chunk_count, seq) FILTER (chunk_count IS NOT NULL) AS chunk_count, nullif(arg_max(error, seq) FILTER (error IS NOT NULL), '') AS error FROM e GROUP BY id"""


def _events(rows):
    """Users stand in for documents, kinds of events for stages."""
    kind = F.col("event_type")
    return rows.select(
        F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("at"), kind.alias("stage"), F.when(kind == "signup", F.concat(F.lit("https://example.com/"), "user_id")).alias("source_url"),
        F.when(kind == "view", F.col("props")).alias("title"), F.upper(kind).alias("status"), F.when(kind == "purchase", F.floor("value")).alias("chunk_count"), F.when(kind == "error", F.col("props")).when(kind == "signup", states.NO_ERROR).alias("error"),
    )


@query(_CURRENT)
def catalog_state(spark, sf_dir):
    """The current row of every document, from the whole log at once."""
    return states.current(_events(table(spark, sf_dir, "events")))


@query(_CURRENT)
def stream_catalog_state(spark, sf_dir):
    """The same rows from the log as a stream with state, merged into a stored table batch by batch."""
    log = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    path = store.shared_path(spark, "catalog")
    held = states.catalog_table(spark, f"{path}/table", 8)
    states.start(_events(log), held, f"{path}/checkpoint").awaitTermination()
    return held.rows().drop("batch")
