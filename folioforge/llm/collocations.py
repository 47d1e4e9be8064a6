"""Phrases whose words belong together, by language.

Texts are split at punctuation and line ends into pieces and those into words.
Only the longest windows are counted: at every word the one that begins there,
padded where its piece ends.  They are counted over runs of texts first and sent
by their first word and a salt of the second, so that equal beginnings travel
once and a frequent word has many tasks.  Every shorter phrase is a prefix of the
windows at its places, so one ROLLUP over the windows' word columns sums the
counts of all lengths, the number of words of each language included.  A phrase
below the least count is no candidate and no part of one: its last word is
padding by then, so that rare windows meet in their prefix before they are dealt
out again.

A null text is empty, a null language is `und`; an empty text has no phrase.
Repeated rows count as often as they occur.  Equal scores are ordered by count
and phrase.  A language without candidates, or a table without rows, gives no
rows.  Long texts are counted whole.  Columns other than lang and text are not
read, whatever their names.  Counts are exact up to 10^15.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.shared import documents, write_table
from folioforge.llm.textops import as_binary, pieces

LONGEST = 3  # words of a phrase
LEAST = 10  # occurrences
COVERED_PERCENT = 50  # of a phrase's occurrences inside one longer phrase
BEST = 2000  # phrases reported for a language
SCALE = 1_000_000
UNKNOWN = "und"
BREAKS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SALTS, PARTS = 8, 32  # of a frequent first word, and of a language's phrases
RUN_BYTES, RUN_WORDS = 8 << 20, 1 << 20  # texts counted together

_KIND = np.zeros(256, dtype=np.uint8)  # 0: part of a word, 1: blank, 2: break
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(offsets: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of some texts, the text of each, and its piece, counted over all texts."""
    data, n = _LOWER[data], len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    word = _KIND[data] == 0
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:n]
    stops[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(stops) + 1 - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[word])])
    piece = np.cumsum(edge[:n] | (_KIND[data] == 2))[starts]
    return words, np.searchsorted(offsets, starts, side="right") - 1, piece


def _combined(key: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """One number for each pair (key, ids < n), in the same order."""
    if len(key) and int(key.max()) >= (1 << 62) // n:
        key = np.unique(key, return_inverse=True)[1]
    return key * n + ids


def counted_windows(words: pa.Array, group: np.ndarray, piece: np.ndarray, begin: int, end: int, longest: int) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """group, first word, salt and rests of the windows that begin at words begin to end.

    A rest is the words after the first, space-joined, none for a padded window,
    with `<tab>count` where there are several; rests of one first word and salt
    are joined by line ends.  The salt is a number of the second word.
    """
    upto = min(end + longest - 1, len(words))
    coded = words.slice(begin, upto - begin).dictionary_encode()
    own, n = coded.indices.to_numpy().astype(np.int64) + 1, len(coded.dictionary) + 1
    salts = np.array([0, *(zlib.crc32(w.encode()) % SALTS for w in coded.dictionary.to_pylist())])
    size, leads, key = end - begin, [], group[begin:end].astype(np.int64)
    for k in range(longest):  # the word k places on, 0 beyond the piece
        lead = np.zeros(size, dtype=np.int64)
        m = min(size, upto - begin - k)
        lead[:m] = np.where(piece[begin + k : begin + k + m] == piece[begin : begin + m], own[k : k + m], 0)
        leads.append(lead)
        key = _combined(_combined(key, salts[lead], SALTS) if k == 1 else key, lead, n)
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    of, first, salt = group[begin:end][at], leads[0][at], salts[leads[1][at]]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (first[1:] != first[:-1]) | (salt[1:] != salt[:-1])]))
    named = lambda ids: coded.dictionary.take(pa.array(ids - 1, mask=ids == 0))
    rests = pc.ascii_rtrim(pc.binary_join_element_wise(*[named(lead[at]).fill_null("") for lead in leads[1:]], " "), " ")
    rests = pc.if_else(pa.array(count == 1), rests, pc.binary_join_element_wise(rests, pa.array(count).cast(pa.string()), "\t"))
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)), pa.int32()), rests)
    return of[new], named(first[new]), salt[new], pc.binary_join(lists, "\n")


def windows(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, w1, salt, rests: the longest windows, counted over runs of texts, by their first word and a part of the second ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).fill_null(UNKNOWN).dictionary_encode()
            offsets, data = as_binary(batch.column(1))
            for i, j in pieces(offsets, RUN_BYTES):
                words, text, piece = _words(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                group = lang.indices.to_numpy()[i:j][text]
                for begin in range(0, len(words), RUN_WORDS):
                    of, first, salt, rests = counted_windows(words, group, piece, begin, min(begin + RUN_WORDS, len(words)), longest)
                    yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(of)), first, pa.array(salt, pa.int32()), rests], names=["lang", "w1", "salt", "rests"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, w1 string, salt int, rests string")


def frequencies(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, m, phrase, f: every phrase of m words that occurs `least` times; with m = 0 the number of words of the language."""
    word = [f"w{k}" for k in range(1, longest + 1)]
    dealt = windows(docs, longest).repartition("lang", "w1", "salt").select("lang", "w1", "salt", F.explode(F.split("rests", "\n")).alias("rest"))
    one = dealt.select("lang", "w1", "salt", F.substring_index("rest", "\t", 1).alias("rest"), F.coalesce(F.get(F.split("rest", "\t"), F.lit(1)).cast("long"), F.lit(1)).alias("n"))
    counted = one.groupBy("lang", "w1", "salt", "rest").agg(F.sum("n").alias("n"))
    parts = F.split(F.when(F.col("rest") != "", F.col("rest")), " ")
    few = counted.select("lang", "w1", "salt", "n", *[F.get(parts, F.lit(k)).alias(w) for k, w in enumerate(word[1:])])
    # all windows with the same first two words are here: a rare phrase goes into its prefix before the rest is dealt out
    few = few.withColumn(word[-1], F.when(F.col("n") >= least, F.col(word[-1]))).groupBy("lang", "w1", "salt", *word[1:]).agg(F.sum("n").alias("n"))
    for m in range(longest - 1, 1, -1):
        total = F.sum("n").over(Window.partitionBy("lang", "w1", "salt", *word[1:m]))
        few = few.withColumn(word[m - 1], F.when(total >= least, F.col(word[m - 1])))
    summed = few.rollup("lang", *word).agg(F.grouping_id().alias("level"), F.sum("n").alias("f")).filter(F.col("level") < 1 << longest)
    m = sum((F.when(F.col("level") == (1 << k) - 1, F.lit(longest - k)).otherwise(0) for k in range(longest + 1)), F.lit(0))
    whole = F.size(F.array_compact(F.array(*[F.col(w) for w in word])))  # a padded window is a phrase of the level above
    return summed.withColumn("m", m).filter((whole == F.col("m")) & ((F.col("m") == 0) | (F.col("f") >= least))).select("lang", "m", F.concat_ws(" ", *word).alias("phrase"), "f")


def _run(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def scored(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, m, a, l, r, score of each phrase of two words and more in counts, at its lowest-scoring cut."""
    found = counts.filter("m >= 2").select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cut = found.select("lang", "phrase", "m", "a", "words", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "m", "a", "k", _run(F.col("words"), F.lit(1), F.col("k")).alias("first"), _run(F.col("words"), F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    of = lambda name, n: counts.filter("m > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    met = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    product = F.lit(SCALE).cast("decimal(7,0)") * exact("a") * exact("a")
    score = F.call_function("div", product, exact("l") * exact("r"))
    best = met.withColumn("score", score).groupBy("lang", "phrase", "m", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "m", "a", "best.l", "best.r", "best.score")


def covered(counts: DataFrame) -> DataFrame:
    """lang, phrase, longer: the greatest count of a longer phrase that the words of phrase lie in."""
    long = counts.filter("m >= 3").select("lang", "m", "f", F.split("phrase", " ").alias("words"))
    sized = long.select("lang", "m", "f", "words", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("n"))
    placed = sized.select("lang", "f", "n", "words", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("n") + 1)).alias("start"))
    return placed.groupBy("lang", _run(F.col("words"), F.col("start"), F.col("n")).alias("phrase")).agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = COVERED_PERCENT, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    counts, _ = write_table(frequencies(docs, longest, least), "phrases")
    kept = scored(counts, longest).join(covered(counts), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a language's best are among the best of its parts
    part = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    few = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("place", part).filter(F.col("place") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    n = counts.filter("m = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language."""
    return collocations(documents(spark, sf_dir).select("lang", "text"))
