import random
import re
from collections import Counter

from pyspark.sql import functions as F

from folioforge.llm import collocations as c

SCHEMA = "lang string, text string"
LOWER = str.maketrans(c.UPPER, c.UPPER.lower())


def brute(rows, longest=3, least=10, percent=50, best=2000):
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for m in range(1, longest + 1):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        long = {k: v for k, v in f.items() if len(k) >= 2 and v >= least}
        found = []
        for k, a in long.items():
            score, _, left, right = min((1_000_000 * a * a // (f[k[:i]] * f[k[i:]]), i, f[k[:i]], f[k[i:]]) for i in range(1, len(k)))
            inside = lambda x, k=k: len(x) > len(k) and any(x[i : i + len(k)] == k for i in range(len(x) - len(k) + 1))
            if not any(100 * v >= percent * a for x, v in long.items() if inside(x)):
                found.append((-score, -a, " ".join(k).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def check(spark, rows, **how):
    got = c.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), **how)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert sorted(map(tuple, got.collect())) == brute(rows, **how)


def made(n, seed):
    dice = random.Random(seed)
    words = ["New", "york", "CITY", "é", "ß\x00", "the", "of", "a", " x", "語"]
    ends = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", "!?"]
    text = lambda: "".join(dice.choice(words) + dice.choice(ends) for _ in range(dice.randrange(80)))
    return [(dice.choice(["en", "fr", None, "und", ""]), dice.choice([None, "", " \t\n", text(), text(), text()])) for _ in range(n)]


def test_equals_brute_force(spark):
    check(spark, made(150, 1))
    check(spark, made(60, 2), best=3, least=4)


def test_phrases_of_other_lengths(spark):
    check(spark, made(80, 3), longest=5, least=6, percent=70)
    check(spark, made(80, 4), longest=2)


def test_cut_ties_covered_phrases_and_long_texts(spark):
    rows = [("en", "one two three. " * 30), ("en", "two three, " * 5), ("de", "a a a a a a a a a a a a a a"), ("fr", "x y " * 60_000)]
    check(spark, rows)


def test_repeated_rows_clashing_columns_and_no_rows(spark):
    rows = [("en", "same old story")] * 12
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit(1) for x in ("window", "n", "w1", "phrase", "a.b")})
    assert sorted(map(tuple, c.collocations(docs).collect())) == brute(rows)
    assert c.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_products_beyond_64_bits_are_exact(spark):
    counts = [("en", 1, "big", 9 * 10**14), ("en", 1, "count", 8 * 10**14), ("en", 2, "big count", 7 * 10**14)]
    row = c.scored(spark.createDataFrame(counts, "lang string, m int, phrase string, f long")).first()
    assert row.score == 10**6 * (7 * 10**14) ** 2 // (9 * 10**14 * 8 * 10**14)
