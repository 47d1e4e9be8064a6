import random
import re

import pytest

from folioforge.operators import retrieval, text_index

SCHEMA = "chunk_id string, text string, title string"
WORDS = [f"w{k:02d}" for k in range(60)]


def terms(text):
    return list(dict.fromkeys(t.lower() for t in re.split(r"[\W_]+", text or "") if len(t) > 1))


def brute(questions, chunks, k):
    out = []
    for q, text in questions:
        asked, scored = terms(text), []
        for key, body, title in chunks:
            b, t = (len(set(asked) & set(terms(x))) for x in (body, title))
            if asked and key is not None and (score := min(1.0, b / len(asked) * 0.8 + t / len(asked) * 0.2)) > 0:
                scored.append((-score, key))
        out += [(q, key, round(-s, 9), r) for r, (s, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def made(n, seed):
    dice = random.Random(seed)
    text = lambda most: " ".join(WORDS[min(int(dice.expovariate(0.08)), 59)].title() for _ in range(dice.randrange(most)))
    return [(f"c{k:05d}", dice.choice([None, "", *[text(90)] * 8]), dice.choice([None, "", text(4)])) for k in range(n)]


@pytest.mark.parametrize("shard", [16, 4096])
def test_postings_equal_brute_force(spark, shard):
    chunks = made(400, 1)
    questions = [(f"q{k}", " ".join(random.Random(k).sample(WORDS, 1 + k % 12))) for k in range(25)] + [("none", ""), ("null", None), ("far", "unknown words")]
    asked = spark.createDataFrame(questions, "question_id string, text string")
    base = spark.createDataFrame([*chunks, (None, "w00 w01", "w02")], SCHEMA).repartition(3)
    got = retrieval.full_text_rank(asked, base, 5, title="title", index=text_index.index_rows(base, "chunk_id", "text", "title", shard))
    assert sorted((r.question_id, r.chunk_id, round(r.text_score, 9), r["rank"]) for r in got.collect()) == brute(questions, chunks, 5)


def test_join_beyond_the_bound_gives_the_same(spark, monkeypatch):
    chunks, questions = made(120, 2), [("a", "w00 w05 w09"), ("b", "w30")]
    monkeypatch.setattr(retrieval, "ASKED_TERMS", 2)
    got = retrieval.full_text_rank(spark.createDataFrame(questions, "question_id string, text string"), spark.createDataFrame(chunks, SCHEMA), 4, title="title")
    assert sorted((r.question_id, r.chunk_id, round(r.text_score, 9), r["rank"]) for r in got.collect()) == brute(questions, chunks, 4)


def test_few_blocks_are_opened_and_few_rows_leave_a_shard(spark, tmp_path):
    chunks = made(3000, 3)
    rare = [(f"r{k}", " ".join(WORDS[40:60]), "") for k in range(6)]
    base = spark.createDataFrame([*chunks, *rare], SCHEMA).coalesce(1)
    text_index.index_rows(base, "chunk_id", "text", "title").write.parquet(f"file://{tmp_path}/index")
    index = spark.read.parquet(f"file://{tmp_path}/index")
    asked = {"q": WORDS[40:60]}
    scored = sum(r.scored for r in text_index.ranked_rows(index, asked, 5, "question_id", "string", "chunk_id", counted=True).collect())
    assert scored < 0.1 * 3006
    found = text_index.ranked_rows(index, asked, 5, "question_id", "string", "chunk_id")
    assert found.count() == 5 and {r.chunk_id[0] for r in found.collect()} == {"r"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan


def test_no_chunks_and_no_questions(spark):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([("q", "w01")], "question_id string, text string")
    assert retrieval.full_text_rank(asked, none, 3).count() == 0
    assert retrieval.full_text_rank(asked.limit(0), spark.createDataFrame(made(5, 4), SCHEMA), 3).count() == 0
