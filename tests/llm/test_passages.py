import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import passages as p


def test_fenwick_is_a_prefix_maximum():
    rng = np.random.default_rng(1)
    tree, plain = p.Fenwick(50), [-1e18] * 50
    for t in range(300):
        i, v = int(rng.integers(50)), float(rng.random())
        tree.put(i, v, t)
        plain[i] = max(plain[i], v)
        j = int(rng.integers(51))
        assert tree.upto(j)[0] == max(plain[:j], default=-1e18)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_common_is_the_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert p.common(np.array(a), np.array(b)) == table[-1][-1]


def test_chains_follow_both_orders():
    start, own, size = np.array([0, 30, 60, 20]), np.array([100, 131, 160, 10]), np.array([20, 20, 20, 8])
    got = p.chains(start, own, size)
    assert [0, 1, 2] in got and [3] in got


def texts():
    rng = np.random.default_rng(6)
    words = lambda n: [f"v{int(x)}" for x in rng.integers(0, 10**6, n)]
    passage = words(80)
    fuzzy = passage.copy()
    fuzzy[20], fuzzy[45:46] = "changed", []
    out = {i: " ".join(words(200)) for i in range(1, 12)}
    out[20] = " ".join(words(60) + passage + words(60))
    out[21] = " ".join(words(30) + passage + words(90))
    out[22] = " ".join(words(100) + fuzzy + words(10))
    out[23] = " ".join([*words(10), *passage, *words(50), *passage])
    out[24] = " ".join(words(40) + passage[:30] + words(40))
    out[12] = " ".join(words(20) + passage[:34] + words(20))  # owns a part of the passage, too short for one itself
    out[30] = out[31] = "again and " * 300
    out[32] = out[5]
    return out


def test_passages_and_removal(spark):
    rows = [(i, t, len(t), "x") for i, t in texts().items()] + [(40, None, 0, "x"), (41, "", 0, "x"), (None, texts()[20], 0, "x"), (1, texts()[1], 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, passages string").repartition(5)
    got = {(min(r.id, p.NO_ID), r.own_id): (r.start, r.end) for r in p.passages(p.keyed(docs)).collect() if r.id not in (23,)}
    assert got[21, 20] == (30, 110) and got[22, 20] == (100, 179) and got[32, 5] == (0, 200) and got[31, 30] == (0, 600) and got[p.NO_ID, 20] == (0, 200)
    assert not any(24 in k or i in k for k in got for i in range(1, 5)) and len(got) == 5
    assert sorted((r.start, r.end) for r in p.passages(p.keyed(docs)).filter("id = 23").collect()) == [(10, 90), (140, 220)]
    left = p.drop_passages(docs)
    assert left.columns == docs.columns
    left = {r.doc_id: r.text for r in left.collect()}
    assert set(left) == {*range(1, 13), 20, 21, 22, 23, 24, 30, 40, 41}
    old = texts()
    assert left[21].split() == old[21].split()[:30] + old[21].split()[110:] and left[20] == old[20] and left[40] is None
    assert len(left[23].split()) == 60
    assert p.drop_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table_against_exact_runs(spark, sf):
    """Every run of 60 equal words in two documents is found, in the later one."""
    docs = {r.doc_id: (r.text or "").encode().lower().split() for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    covered = {}
    for r in p.op7_substring_dedup(spark, f"/root/testdata/{sf}").collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    seen = {}
    for i in sorted(docs):
        w = docs[i]
        for j in range(len(w) - 59):
            run = b" ".join(w[j : j + 60])
            if seen.setdefault(run, i) != i and len(set(w[j : j + 60])) > 30:
                assert set(range(j, j + 60)) <= covered.get(i, set()), (i, j)


def covered(spark, texts, ids):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = {}
    for r in p.passages(p.keyed(docs)).filter(f"id IN ({', '.join(map(str, ids))})").collect():
        out.setdefault(r.id, set()).update(range(r.start, r.end))
    return out


def test_passages_with_fragmented_owners(spark):
    """Earlier texts hold parts of a passage, each too short for one, and two later texts hold it whole."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"u{int(x)}" for x in rng.integers(0, 10**6, n)]
    long, short, late = words(200), words(60), words(60)
    texts = {i: " ".join(words(30) + long[40 * i : 40 * i + 40] + words(30)) for i in range(5)}
    texts |= {10: " ".join(words(20) + long + words(20)), 11: " ".join(words(50) + long + words(5))}
    texts |= {20: " ".join(words(20) + short[:45] + words(20)), 21: " ".join(words(20) + short[15:] + words(20))}
    texts |= {22: " ".join(words(20) + short + words(20)), 23: " ".join(words(40) + short + words(20))}
    texts |= {30: " ".join(words(9) + late[:30] + words(9)), 31: " ".join(words(20) + late + words(20)), 32: " ".join(words(9) + late[20:65] + words(9)), 33: " ".join(words(7) + late + words(7))}
    got = covered(spark, texts, [11, 23, 33])
    assert set(range(50, 250)) <= got[11] and set(range(40, 100)) <= got[23] and set(range(7, 67)) <= got[33]


def fuzzy_copies(rng, length, edits, n=60):
    """Texts with passages of so many words, copies with so many words changed, and where these are."""
    words = lambda n: [f"z{int(x)}" for x in rng.integers(0, 10**6, n)]
    texts = {}
    for i in range(n):
        passage = words(length)
        copy = passage.copy()
        for at in rng.choice(np.arange(1, length - 1), edits, replace=False).tolist():
            copy[at] = words(1)[0]
        texts[i] = " ".join(words(40) + passage + words(40))
        texts[1000 + i] = " ".join(words(60) + copy + words(20))
    return texts


@pytest.mark.parametrize("length,share,least", [(60, 0.1, 0.95), (80, 0.15, 0.93), (120, 0.15, 0.95), (120, 0.18, 0.9), (200, 0.18, 0.9)])
def test_recall_of_fuzzy_passages(spark, length, share, least):
    """Passages with random words changed, at a similarity of 0.82 to 0.9: how many are found over most of their length."""
    texts = fuzzy_copies(np.random.default_rng(length), length, int(length * share))
    got = covered(spark, texts, [i for i in texts if i >= 1000])
    found = sum(len(got.get(1000 + i, set()) & set(range(60, 60 + length))) >= 0.75 * length for i in range(60))
    print(length, share, found / 60)
    assert found >= least * 60
    assert all(min(r) >= 50 and max(r) < 70 + length for r in got.values())


def test_columns_with_dots(spark):
    docs = spark.createDataFrame([(1, "x y", 3), (2, None, 0)], "doc_id long, text string, `a.b` int")
    left = p.drop_passages(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [(1, "x y", 3), (2, None, 0)]


def test_texts_of_one_id_keep_their_owner_in_any_order(spark):
    rng = np.random.default_rng(8)
    words = lambda n: [f"t{int(x)}" for x in rng.integers(0, 10**6, n)]
    shared = words(70)
    rows = [(5, " ".join(words(20 + 7 * k) + shared)) for k in range(4)] + [(9, " ".join(words(3) + shared + words(9)))]
    runs = []
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        runs.append({tuple(r) for r in p.passages(p.keyed(docs)).collect()})
    assert runs[0] == runs[1] == runs[2] and any(r[0] == 9 for r in runs[0])
