import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import quality_rules as q
from folioforge.llm.textops import word_chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), lines


def measured(texts):
    out = []
    for _, _, words in word_chunks(pa.array(texts, pa.string()), lower=False):
        got = q.chunk_counts(words)
        out += list(zip(*[np.asarray(got[c]).tolist() for c in q.COUNTS[:6]], strict=True))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#é語\x1c", max_size=60)), max_size=6))
def test_counts_equal_brute_force(texts):
    assert measured(texts) == [brute(t) for t in texts]


def test_long_and_edge_texts():
    long = "x y z w v u t s " * 50_000
    texts = [None, "", "\n", long, "a\na\n", "a\n", "one " * 7, "one " * 9]
    assert measured(texts) == [brute(t) for t in texts]


def test_filter_handles_odd_rows(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    rows = [(1, clean, "en", "a", "x"), (1, clean, "en", "a", "x"), (None, clean, None, None, None), (3, None, "en", "a", "y"), (4, "### " * 30, "en", "a", "z"), (5, "", None, "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality_counts string")
    kept = q.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1]
    assert q.filter_documents(docs.limit(0)).count() == 0


def test_columns_with_dots(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "en", "a", 7), (2, None, "en", "a", 8)], "doc_id long, text string, lang string, source string, `a.b` int")
    kept = q.filter_documents(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, "en", "a", 7)]


def test_sketches_merge_and_bound_the_error(spark):
    values = np.random.default_rng(5).lognormal(0, 1, 4000)
    rows = [(f"s{i % 2}", int(v * 10_000)) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "source string, word_chars long").selectExpr("'en' lang", "source", "struct(10000L n_words, word_chars, 0L n_symbols, 0L n_dup_lines, 0L n_repeat_words, 1L n_lines, 0L n_upper) q")
    merged = q._quantiles(q.sketches(frame, "q"), ["lang"]).filter("rule = 'mean_word_chars'").first()
    exact = np.sort([v // 1 / 10_000 for v in (values * 10_000)])
    for p, got in ((0.25, merged.q25), (0.75, merged.q75)):
        want = exact[int(np.ceil(p * len(exact))) - 1]
        assert abs(got - want) <= 0.011 * want


def fences_of(spark, groups):
    """Learnt fences by source of groups: source -> list of (n_symbols, n_words)."""
    rows = [(s, "en", w, y) for s, own in groups.items() for y, w in own]
    frame = spark.createDataFrame(rows, "source string, lang string, w long, y long").selectExpr(
        "source", "lang", "struct(w n_words, 5 * w word_chars, y n_symbols, 0L n_dup_lines, 0L n_repeat_words, 1L n_lines, 0L n_upper) q"
    )
    return {r.source: r.fences["symbol_ratio"].high for r in q.thresholds(q.sketches(frame, "q")).collect()}


def test_fences_of_sparse_ratios_follow_their_group(spark):
    """Two groups with symbols in a tenth of the texts, in one of them ten times as many, have fences ten times apart."""
    got = fences_of(spark, {"a": [(0, 100)] * 9000 + [(30, 100)] * 1000, "b": [(0, 100)] * 9000 + [(300, 100)] * 1000})
    assert 0.05 > got["a"] > 0.025 and 0.35 > got["b"] > 0.25
    assert 6 < got["b"] / got["a"] < 12


def test_small_groups_lean_on_their_language_without_a_switch(spark):
    """The fence of a group moves from its language's to its own as it grows, with no jump."""
    wide = [(0, 100)] * 9000 + [(100, 100)] * 1000
    at = [fences_of(spark, {"big": wide, "small": [(0, 100)] * (9 * n) + [(10, 100)] * n})["small"] for n in (1, 10, 40, 200)]
    assert all(a > b for a, b in zip(at, at[1:])) and at[0] > 0.09 and at[-1] < 0.02


def test_no_symbols_anywhere(spark):
    assert fences_of(spark, {"a": [(0, 100)] * 30, "b": [(0, 50)]}) == {"a": 0.0, "b": 0.0}
