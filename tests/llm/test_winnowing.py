import random
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import winnowing as w

SCHEMA = "doc_id long, text string"


def plain(text, gram=w.GRAM, window=w.WINDOW):
    """Chosen (hash, place) by the definition, window by window."""
    text = text or ""
    grams = [text[i : i + gram] for i in range(max(len(text) - gram + 1, 1))] if text else []
    hashes = [int(w.gram_hashes(np.array([ord(c) for c in g], dtype=np.uint32), gram)[0]) for g in grams]
    out = []
    for i in range(max(len(hashes) - window + 1, 1) if hashes else 0):
        own = hashes[i : i + window]
        at = i + max(k for k, h in enumerate(own) if h == min(own))
        if not out or out[-1][1] != at:
            out.append((hashes[at], at))
    return out


def pairs(f):
    return list(zip(f.hashes.tolist(), f.places.tolist(), strict=True))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é語\U0001f600", max_size=120), st.integers(1, 9), st.integers(1, 12), st.integers(1, 40))
def test_equals_the_definition(text, gram, window, run):
    assert pairs(w.fingerprint(text, gram, window, run)) == plain(text, gram, window)


def test_defaults_and_edge_texts():
    dice = random.Random(5)
    texts = [None, "", "a", "a" * 19, "a" * 20, "a" * 49, "a" * 400, "".join(dice.choice("abcdefgh ") for _ in range(3000))]
    assert [pairs(w.fingerprint(t)) for t in texts] == [plain(t) for t in texts]
    assert w.fingerprint("x" * 3).text() == w.fingerprint("x" * 3).text() != w.fingerprint("y" * 3).text()


def test_a_shared_run_of_the_guaranteed_length_is_found_in_place():
    dice = random.Random(3)
    letters = lambda n: "".join(dice.choice("abcdefghijklmnop ") for _ in range(n))
    for _ in range(60):
        shared, before, other = letters(w.GUARANTEE), letters(dice.randrange(200)), letters(dice.randrange(200))
        a, b = before + shared + letters(80), other + shared + letters(70)
        found = w.common_places(w.fingerprint(a), w.fingerprint(b))
        assert any(len(before) <= p <= len(before) + w.WINDOW - 1 and p - len(before) == q - len(other) for p, q in found)


def test_runs_of_long_texts_do_not_matter():
    dice = random.Random(9)
    text = "".join(dice.choice("ab") for _ in range(2 * w.RUN + 1234))
    whole = w.fingerprint(text, run=len(text))
    assert pairs(w.fingerprint(text)) == pairs(whole)


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (name, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        sets = [{h for h, _ in plain(t)} for t in (text, changed, following)]
        near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        shown = [",".join(f"{h:016x}:{p}" for h, p in plain(t)) for t in (text, changed)]
        out.append((name, len(text), sha256(changed.encode()).hexdigest(), *shown, near(sets[0], sets[1]), near(sets[0], sets[2])))
    return sorted(out, key=str)


def check(spark, rows):
    got = w.against_next(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 5, 120])
def test_next_document_equals_brute_force(spark, n):
    dice = random.Random(n)
    text = lambda: " ".join(dice.choice(["alpha", "beta", "gamma", "é語", "delta"]) for _ in range(dice.randrange(60)))
    check(spark, [(dice.randrange(1 << 40), dice.choice([None, "", text(), text(), text()])) for _ in range(n)])


def test_null_ids_ties_repeated_rows_large_ids_and_no_rows(spark):
    check(spark, [(None, "no id " * 20), (None, None), (4, "same " * 30), (4, "same " * 30), (4, "other " * 9), (-5, "x"), ((1 << 62) + 1, "big"), ((1 << 62) + 2, "bigger")])
    check(spark, [(7, f"text {k} " * 8) for k in range(9)])
    assert w.against_next(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text_and_further_columns(spark):
    rows = [(1, "long text " * 40_000), (2, "short"), (3, "long text " * 40_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("block", "guest", "p", "a.b")})
    got = {r.doc_id: r for r in w.against_next(docs.select("doc_id", "text", "block", "guest", "p", F.col("`a.b`"))).collect()}
    assert got[1].fingerprint == got[3].fingerprint and got[1].n_chars == 400_000


def test_listed_fingerprints_equal_single_ones(spark):
    rows = [(1, "some text " * 30), (2, None), (3, "é語" * 40)]
    got = {r.doc_id: list(zip([h % (1 << 64) for h in r.hashes], r.places, strict=True)) for r in w.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: pairs(w.fingerprint(t)) for k, t in rows}
