import numpy as np
import pytest

import corpus_pipeline
from folioforge.llm import near_copies as n


def shingles(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_components(rows):
    """Least id reachable over pairs of five-word Jaccard 0.8 or more, of (id, text)."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(rows)}


def family():
    """Texts with copies of 1 to 12 changed words, and chains of copies of copies."""
    rng = np.random.default_rng(5)
    rows = [(1000, None), (1001, " "), (1002, "one"), (1003, "ONE"), (1004, "one two three four"), (1005, "one two three four five")]
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        for copy in range(10):
            rows.append((base * 20 + copy, " ".join(words)))
            if copy == 6:
                words = words * 2
            for at in rng.choice(len(words), base % 6 + 1, replace=False).tolist():
                words[at] = f"x{rng.integers(10**6)}"
    return rows


def test_the_stage_drops_copies_of_jaccard_0_8(spark):
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {k for k, c in want.items() if k == c} and 1 < len(kept) < len(rows) / 2


@pytest.mark.parametrize("cell,whole", [(8, 4096), (4, 4)])
def test_cut_groups_are_exact(spark, monkeypatch, cell, whole):
    monkeypatch.setattr(n, "CELL", cell)
    monkeypatch.setattr(n, "WHOLE", whole)
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component for r in n.near_copies(docs, "doc_id").collect()} == brute_components(rows)


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert {r.doc_id: r.component for r in n.near_copies(docs, "doc_id").collect()} == brute_components(rows)


def test_fingerprints_and_keys_reach_the_least_similarity():
    """Of pairs at the least similarity 99 % share a key and are within the radii; strangers share none."""
    rng, missed = np.random.default_rng(11), 0
    for size in (9, 90, 900):
        for _ in range(400):
            sets = rng.integers(0, 2**63, 10 * size // 9, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            a, b, c = sets[:size], sets[len(sets) - size :], sets[:size] + np.uint64(1)  # a and b have 8 of 10 in common
            flags, keys = [], []
            for x in (a, b, c):
                run = np.array([0, len(x)])
                words = np.concatenate([n.majority(n.mix64(x ^ seed), run) for seed in n._SEEDS])
                flags.append(np.unpackbits(words.view(np.uint8), bitorder="little"))
                keys.append(n.minima_keys(x, run)[0])
            differ = flags[0] != flags[1]
            missed += not (keys[0] == keys[1]).any() or differ[:64].sum() > n.RADII[0] or differ.sum() > n.RADII[1]
            assert len(set(keys[0].tolist())) == n.KEYS and not (keys[0] == keys[2]).any()
    assert missed <= 12


def test_keys_are_shared_as_often_as_the_similarity_says():
    rng, want, got = np.random.default_rng(3), 0.0, 0
    for half in (10, 100):
        for _ in range(300):
            sets = rng.integers(0, 2**63, 4 * half, dtype=np.int64).astype(np.uint64)
            a, b = (n.minima_keys(x, np.array([0, len(x)]))[0] for x in (sets[: 3 * half], sets[half:]))
            want, got = want + 0.5**n.ROWS * n.KEYS, got + int((a == b).sum())
    assert 0.8 * want < got < 1.2 * want


def test_majority():
    rng = np.random.default_rng(3)
    hashes, first = rng.integers(0, 2**63, 2000, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1), np.array([0, 1, 3, 258, 513, 2000])
    got = n.majority(hashes, first)
    for k, (a, b) in enumerate(zip(first, first[1:])):
        assert int(got[k]) == sum(1 << bit for bit in range(64) if 2 * sum(int(h) >> bit & 1 for h in hashes[a:b]) > b - a)


def test_candidates_come_through_pivot_tables(spark, monkeypatch):
    """Every group is met with pivots of its own members."""
    asked, find = [], n.group_links

    def seen(keyed, radii, pivots=None, members=False):
        asked.append((pivots, members))
        return find(keyed, radii, pivots, members)

    monkeypatch.setattr(n, "group_links", seen)
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component for r in n.near_copies(docs, "doc_id").collect()} == brute_components(rows)
    assert asked == [(n.PIVOTS, True)] and n.PIVOTS > 0
