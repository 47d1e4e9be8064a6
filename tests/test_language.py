import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from folioforge.operators import language

DIR = "/root/testdata/sf0.01"


def brute_grams(text):
    words = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
    return [words[i : i + 3] for i in range(len(words) - 2)]


def test_profiles_and_detection_against_plain_python(spark):
    rows = [(1, "the cat and the hat", "en"), (2, "le chat et la hat", "fr"), (3, None, "en"), (4, "", "fr"), (5, "THE, the! the?", None), (6, "12 34", None), (7, "le la le", None), (8, "öäü ßab", "de"), (8, "öäü", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {}
    for _, text, lang in rows:
        if lang and text is not None:
            counts.setdefault(lang, Counter()).update(brute_grams(text))
    want = {}
    for lang, own in counts.items():
        for rank, (gram, _) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0].encode()))[: language.TOP]):
            want[lang, gram] = language.TOP - rank
    known = language.profiles(docs)
    assert {(r.lang, r.gram): r.weight for r in known.collect()} == want
    texts = {}
    for key, text, _ in rows:
        texts.setdefault(key, []).extend(brute_grams(text) if text is not None else [])
    best = {}
    for key, own in texts.items():
        total = Counter()
        for gram in own:
            for lang in counts:
                total[lang] += want.get((lang, gram), 0)
        total = {k: v for k, v in total.items() if v}
        best[key] = min(total, key=lambda x: (-total[x], x)) if total else None
    got = {r.doc_id: r.language for r in language.detect(docs, known).collect()}
    assert got == best and got[3] is None


def test_scripts_of_one_language(spark):
    texts = ["Καλημέρα κόσμε", "안녕하세요", "こんにちは 世界", "カタカナ", "สวัสดี", "שלום", "Բարեւ", "გამარჯობა", "hello Ωmega", "plain", "", None, "Ω" * 1000 + "a" * 1999, "Ω" * 1000 + "a" * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.language for r in docs.select("doc_id", language.script_language(F.col("text")).alias("language")).orderBy("doc_id").collect()]
    assert got == ["el", "ko", "ja", "ja", "th", "he", "hy", "ka", None, None, None, None, "el", None]


def test_a_very_long_text_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abcé" * 250_000, "xx"), (2, "abc", "xx"), (3, "zzz", "yy")], "doc_id long, text string, lang string")
    known = language.profiles(docs)
    assert {r.doc_id: r.language for r in language.detect(docs, known).collect()} == {1: "xx", 2: "xx", 3: "yy"}
    assert language.detect(docs.limit(0), known).count() == 0
    assert {r.language for r in language.detect(docs, known.limit(0)).collect()} == {None}


def test_held_out_agreement_with_labels(spark):
    """Learnt from three quarters of the documents; of the others with 20 words or more 99 % have their label."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    known = language.profiles(docs.filter(~out))
    rated = docs.filter(out & F.col("lang").isNotNull() & (F.size(F.split("text", " ")) >= 20))
    found = {r.doc_id: r.language for r in language.detect(rated, known).collect()}
    labels = {r.doc_id: r.lang for r in rated.collect()}
    assert all(zlib.crc32(str(k).encode()) % 4 == 2 for k in labels) and len(labels) > 100
    assert sum(found[k] == v for k, v in labels.items()) >= 0.99 * len(labels)


def test_trigrams_are_counted_in_tasks_and_one_row_a_text_and_language_is_left(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").repartition(3)
    want = Counter()
    for r in docs.filter("lang IS NOT NULL AND text IS NOT NULL").collect():
        want.update((r.lang, g) for g in brute_grams(r.text))
    counts = language.gram_counts(docs).collect()
    got = Counter()
    for r in counts:
        got[r.lang, r.gram] += r.n
    assert got == want and len(counts) <= 3 * len(want)
    rows = language.scores(docs, language.profiles(docs))
    assert not re.search("Generate|Join", rows._jdf.queryExecution().executedPlan().toString())


def test_small_parts_large_alphabets_and_many_profiles(spark, monkeypatch):
    """Cut anywhere, counted by sorting, looked up by search, or joined: the same languages."""
    rows = [(i, "".join(chr(0x4E00 + (i * 7 + k * k) % 400) if i % 3 else "ab\U00020000c "[(i + k) % 5] for k in range(40)), "xyz"[i % 3]) for i in range(30)]
    docs = spark.createDataFrame([*rows, (99, None, "x"), (3, "ab", None)], "doc_id long, text string, lang string")

    def result():
        known = language.profiles(docs)
        return sorted(map(tuple, known.collect())), sorted(map(tuple, language.scores(docs, known).collect())), sorted(map(tuple, language.detect(docs, known).collect()), key=str)

    want = result()
    counts = Counter((lang, g) for _, text, lang in rows for g in brute_grams(text))
    assert {(lang, g) for lang, g, _ in want[0]} <= set(counts) and len({r[1] for r in want[1]}) == 3
    for name, value in (("DENSE", 1), ("BROADCAST_ROWS", 1)):
        monkeypatch.setattr(language, name, value)
        assert result() == want


def test_parts_of_texts_lose_no_trigram(monkeypatch):
    texts = ["abcdefgh" * 3, None, "", "ab", " \U00020000xy ", "aaaa", "語" * 9]
    group = language.np.array([0, 1, 1, 0, 1, -1, 0])
    want = Counter((int(g), t[i : i + 3]) for t, g in zip(texts, group, strict=True) if t and g >= 0 for i in range(len(t) - 2))
    for part in (1, 2, 5, 30, 10**6):
        for dense in (1, 1 << 22):
            monkeypatch.setattr(language, "PART", part)
            monkeypatch.setattr(language, "DENSE", dense)
            got = Counter()
            for points, rows in language._letters(language.pa.array(texts)):
                for own, code, n in zip(*language._counted(points, rows, group), strict=True):
                    got[int(own), language._gram_text(int(code))] += int(n)
            assert got == want
