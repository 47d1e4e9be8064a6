import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from folioforge.llm import manifest as m

LOWER = str.maketrans(m.UPPER, m.UPPER.lower())
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes):
    """Levels up to the single node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    """Left and right siblings from a leaf up."""
    for nodes in levels[:-1]:
        run = at // 8 * 8
        yield nodes[run:at], nodes[at + 1 : run + 8]
        at //= 8


def brute(rows):
    """The manifest of rows (doc_id, text, lang, source, n_chars), by plain recursion."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for x in langs}
    trees = {x: tree([leaf(r, r[1]) for r in own[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    root, out = top[-1][0] if rows else None, []
    for k, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            steps = [*path(trees[x], i), *path(top, k)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            now = leaf(r, r[1].translate(LOWER) if tampered else r[1])
            for left, right in steps:
                now = h([*left, now, *right])
            out.append((r[0], leaf(r, r[1]), trees[x][-1][0], root, h(d for left, right in steps for d in [*left, *right]), now, now == root))
    return sorted(out, key=str)


def check(spark, rows, height):
    got = m.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def made(n, langs, seed=0):
    dice = random.Random(seed)
    text = lambda: dice.choice([None, "", "Abc é語", "lower only", "X" * 20])
    return [(dice.randrange(10 * n), text(), dice.choice(langs), dice.choice([None, "", "web"]), dice.choice([None, -1, 12])) for _ in range(n)]


@pytest.mark.parametrize(("n", "langs", "height"), [(1, ["en"], 4), (9, ["en", None, ""], 4), (300, ["en"] * 9 + ["fr", None], 1), (700, ["en"], 1), (260, [str(k) for k in range(40)], 1), (600, ["en", "de"], 2)])
def test_equals_plain_recursion(spark, n, langs, height):
    check(spark, made(n, langs), height)


def test_null_ids_repeated_rows_long_texts_and_no_rows(spark):
    same = (7, "Twice", "en", "web", 5)
    check(spark, [same, same, (7, "Other", "en", "web", 5), (None, "No Id", None, None, None), (None, None, None, None, None), (8, "Long " * 100_000, "en", "web", 1)], 1)
    assert m.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_positions_are_the_postorder_ones():
    for n in [*range(1, 70), 511, 512, 513, 700]:
        order, seen = [], []

        def visit(level, index, n=n, order=order):
            for child in range(8 * index, min(8 * index + 8, m.width(level - 1, n)) if level else 8 * index):
                visit(level - 1, child)
            order.append((level, index))

        top = 0
        while m.width(top, n) > 1:
            top += 1
        visit(top, 0)
        seen = [m.position(level, index, n) for level, index in order]
        assert seen == list(range(len(order)))


def test_changed_text_or_place_changes_the_root(spark):
    rows = made(40, ["en", "fr"])
    root = lambda own: {r[3] for r in brute(own)}
    other = [(*rows[0][:1], "changed", *rows[0][2:]), *rows[1:]]
    assert root(rows) != root(other) and root(rows) == root(rows[::-1])


def test_further_columns_are_not_read(spark):
    rows = made(20, ["en"])
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("tree", "digest", "index", "a.b")})
    assert sorted(map(tuple, m.manifest(docs).collect()), key=str) == brute(rows)
