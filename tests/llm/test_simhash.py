import re

import numpy as np
import pytest
import xxhash

from folioforge.llm import simhash as s
from folioforge.llm.components import components


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(ids, fps):
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= s.RADIUS:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(least.get(find(i), k), k)
    return [least[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B c", "A b\tc  d E", "x y z w " * 3000, "é Ü ß 語\x85x y z q", "a\x1cb c d e f"])
def test_fingerprint(text):
    assert s.fingerprint(text) == brute_fingerprint(text)


def test_links_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base[:12].tolist():
        for _ in range(25):
            x = b
            for bit in rng.integers(0, 63, rng.integers(1, 5)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    want = brute_components(fps, fps)
    for cell in (4096, 8):
        monkeypatch.setattr(s, "CELL", cell)
        links = s.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
        got = {r.node: r.component for r in components(links).collect()}
        assert [got.get(f, f) for f in fps] == want


def test_components_of_a_path(spark):
    links = spark.range(60).selectExpr("id * 7 % 61 a", "(id + 1) * 7 % 61 b")
    assert {(r.node, r.component) for r in components(links).collect()} == {(i, 0) for i in range(61)}
    assert components(links.limit(0)).count() == 0


def test_keep_first_and_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "c"), (None, None, "d"), (9, "", "e"), (7, text.upper(), "f"), (8, "other words stand here now", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = s.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 8, 9]
    assert s.keep_first(docs.limit(0)).count() == 0
    got = s.near_duplicates(docs, "doc_id").collect()
    assert sorted((r.doc_id or 0, r.component) for r in got) == [(0, 9), (3, 3), (3, 3), (5, 3), (7, 3), (8, 8), (9, 9)]


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], fps)
    got = s.op5_simhash(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in got] == [(r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True)]


def test_pivots_of_a_group_discard_at_wide_radii_and_lose_no_link():
    """Clusters of copies that share a key: members as pivots discard most pairs of strangers, random references none."""
    rng, sizes, radii = np.random.default_rng(6), [1, 2, 5, 120, 300], (26, 36)
    group = np.repeat(np.arange(len(sizes)), sizes)
    base = rng.integers(0, 2**63, (2, 5 * len(sizes)), dtype=np.int64).astype(np.uint64)
    words = base[:, group * 5 + rng.integers(0, 5, len(group))]
    for row in words:
        for _ in range(6):
            row ^= np.uint64(1) << rng.integers(0, 64, len(row)).astype(np.uint64)
    words = words[:, : len(group)]
    far = np.bitwise_count(words[:, :, None] ^ words[:, None, :]).astype(int).cumsum(axis=0)
    linked = (group[:, None] == group[None]) & (far[0] <= radii[0]) & (far[1] <= radii[1])
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True)}
    for members in (True, False):
        got = [(min(i, j), max(i, j)) for a, b in s.linked_pairs(group, words, radii, s.PIVOTS, members) for i, j in zip(a, b, strict=True)]
        assert len(got) == len(want) and set(got) == want
    table = s.member_table(group, words, s.PIVOTS).astype(int)
    own = np.triu(group[:, None] == group[None], 1)
    left = own & (np.abs(table[:, :, None] - table[:, None, :]) <= radii[1]).all(axis=0)
    assert (left & ~linked).sum() < 0.2 * (own & ~linked).sum() and (left | ~(own & linked)).all()
    assert list(s.linked_pairs(group[:0], words[:, :0], radii, s.PIVOTS, True)) == []
