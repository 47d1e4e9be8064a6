import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from folioforge.llm import ngram_lm as lm
from folioforge.llm.textops import word_chunks


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), 0]


class Brute:
    def __init__(self, texts):
        self.c, self.pairs = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.c.update(w)
            self.pairs.update(zip([1, *w[:-1]], w, strict=True))
        self.followers, self.before = defaultdict(dict), Counter()
        for (h, w), n in self.pairs.items():
            self.followers[h][w] = n
            self.before[w] += 1
        of = lambda values: [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        self.d1, self.d2 = lm.discounts(of(self.before.values())), lm.discounts(of(self.pairs.values()))

    def unigram(self, w):
        total = sum(self.before.values())
        spare = sum(self.d1[min(n, 3)] for n in self.before.values()) / total if total else 1
        n = self.before.get(w, 0)
        return (max(n - self.d1[min(n, 3)], 0) / total if total else 0) + spare / (len(self.c) + 1)

    def p(self, h, w):
        own = self.followers.get(h)
        if not own:
            return self.unigram(w)
        n, total = own.get(w, 0), sum(own.values())
        return max(n - self.d2[min(n, 3)], 0) / total + sum(self.d2[min(v, 3)] for v in own.values()) / total * self.unigram(w)

    def score(self, text):
        w = tokens(text)
        n, v = sum(self.c.values()), len(self.c)
        return len(w), sum(x in self.c for x in w), sum(math.log10((self.c[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(self.p(h, x)) for h, x in zip([1, *w[:-1]], w, strict=True))


def texts():
    rng = np.random.default_rng(9)
    made = [" ".join(f"w{int(v)}" for v in rng.zipf(1.4, rng.integers(0, 60))) for _ in range(150)]
    return [None, "", " \n", "One ONE one é É", "long " * 5000, *made, *made[:5]]


@pytest.mark.parametrize("held", [4_000_000, 50])
def test_equals_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(lm, "HELD_ENTRIES", held)
    rows = texts()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(rows)], "doc_id long, text string, score double").repartition(3)
    model = lm.train(docs.filter("doc_id % 5 != 2"))
    brute = Brute([t for i, t in enumerate(rows) if i % 5 != 2])
    assert model.tokens == sum(brute.c.values()) and model.types == len(brute.c)
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    for i, t in enumerate(rows):
        want = brute.score(t)
        assert (got[i].n_tokens, got[i].n_known) == want[:2]
        assert np.allclose((got[i].base_score, got[i].score), want[2:], rtol=1e-9)
    whole = sum(brute.p("w1", w) for w in brute.c) + brute.p("w1", "unseen")
    assert abs(whole - 1) < 1e-9


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    model = lm.train(docs.limit(0))
    assert [(r.n_known, r.base_score, r.score) for r in lm.score(docs, model).collect()] == [(0, 0.0, 0.0)] * 2
    assert lm.score(docs.limit(0), lm.train(docs)).count() == 0


def test_beats_the_base_on_held_out_rows(spark):
    row = lm.op1_lm_score(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "count(*) n").first()
    assert row.n > 50 and row.s > row.b


def test_vectorised_hashes_tell_words_apart():
    words = [f"{a}{b}" for a in "abcxyz" for b in range(3000)]
    (_, _, got), = list(word_chunks(pa.array([" ".join(words)]), lower=False))
    assert len(set(got.hashes().tolist())) == len(words)


def test_too_large_counts_and_vocabularies_stop_the_job(spark, tmp_path, monkeypatch):
    with pytest.raises(OverflowError, match="count"):
        lm.write_arrays(str(tmp_path / "pairs-0"), lm.PAIRS, {"key": np.array([1], dtype="u8"), "count": np.array([1 << 32])})
    assert not list(tmp_path.iterdir())
    monkeypatch.setattr(lm, "MOST_TYPES", 3)
    with pytest.raises(OverflowError, match="distinct words"):
        lm.train(spark.createDataFrame([("a b c d",)], "text string"))
