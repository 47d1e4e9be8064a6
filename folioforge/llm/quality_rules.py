"""Quality rules with thresholds learnt from the corpus (operator 10).

Per document a few ratios are computed.  Per (lang, source) each ratio goes into
a mergeable quantile sketch: counts in logarithmic buckets (relative error
`ACCURACY`), so sketches merge by adding counts, in any order, with one result.
A rule's fences lie a width beyond the sketch's quartiles: the greater of
reach * (q75 - q25) and part * top, with top the 0.9 quantile of the ratios that
aren't 0.  Ratios that are 0 in three quarters of the texts have no spread to go by,
so there the second decides, and a text fails with `part` of what the group's worst
have.  A text fails above the upper fence, for two-sided rules also below the lower
one.  A group's statistics are blended with those of its language, and these with the
corpus's, as if the wider group gave `PRIOR` documents more (for top: documents whose
ratio isn't 0), so a small group leans on its language without a switch.  No width is
a number of its own.  Repeated words have no fence: the base rule's is fixed.

Defined results: null text is an empty text; null lang or source is a group of
its own (shared with the empty string); repeated rows are judged one by one;
null ids are ordinary; texts of any length are read whole; extra columns are kept by
`filter_documents` whatever their names; empty tables give empty results; a document
without words always fails the base rule; a ratio equal to its fence passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.shared import documents, write_table
from folioforge.llm.textops import _BYTE, _INVERSE, _BASE, _power, Words, mix64, segment_sum, windows, word_chunks

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
PRIOR = 20
ACCURACY = 0.002
SMALLEST = 1e-4
BROADCAST_ROWS = 20_000  # of thresholds, each under 200 bytes: 4 MB

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: ratio -> (numerator, denominator, reach in quartile distances, part of top, two-sided)
RULES = {
    "symbol_ratio": ("n_symbols", "n_words", 8.0, 0.10, False),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 8.0, 1.5, False),
    "upper_ratio": ("n_upper", "word_chars", 12.0, 1.0, False),
    "mean_word_chars": ("word_chars", "n_words", 6.0, 0.1, True),
}
ZERO = -(10**6)  # the bucket of ratios under SMALLEST

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def _duplicates(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and which places of it equal their predecessor."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), dtype=bool)
    ranked = keys[order]
    same[1:] = ranked[1:] == ranked[:-1]
    return order, same


def chunk_counts(words: Words) -> dict[str, np.ndarray]:
    """COUNTS of each text of a chunk."""
    data, offsets, first = words.data, words.offsets, words.first
    n_texts = len(offsets) - 1
    out = {"n_words": words.counts}

    def per_text(mask: np.ndarray) -> np.ndarray:
        return segment_sum(mask.astype(np.int64), offsets)

    in_word = np.zeros(len(data) + 1, dtype=np.int8)
    in_word[words.starts] += 1
    in_word[words.ends] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool) if len(data) else np.zeros(0, dtype=bool)
    # a word may touch the next text's first word: both +1 and -1 fall on that place and cancel
    out["word_chars"] = per_text(in_word & ((data & 0xC0) != 0x80))
    out["n_symbols"] = per_text(_SYMBOL[data])
    out["n_upper"] = per_text(_UPPER[data])

    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    breaks = np.flatnonzero(data == 10)
    # lines lie one after another, so sorted begins and sorted ends pair up
    begins, ends = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    held = np.searchsorted(words.starts, ends) - np.searchsorted(words.starts, begins) > 0
    begins, ends = begins[held], ends[held]
    owner = np.searchsorted(offsets, begins, side="right") - 1
    h = (sums[ends] - sums[begins]) * _power(_INVERSE, len(data) + 1)[begins]
    h = mix64(mix64(h ^ (ends - begins).astype(np.uint64)) + mix64(owner.astype(np.uint64)))
    order, same = _duplicates(h)
    out["n_dup_lines"] = np.bincount(owner[order[same]], minlength=n_texts)
    out["n_lines"] = np.bincount(owner, minlength=n_texts)

    runs = windows(words.hashes(), WINDOW)
    owner = words.owner()
    at = np.flatnonzero(owner[: len(runs)] == owner[WINDOW - 1 :]) if len(runs) else np.zeros(0, dtype=np.int64)
    order, same = _duplicates(mix64(runs[at] + mix64(owner[at].astype(np.uint64))))
    twice = same.copy()
    twice[:-1] |= same[1:]
    found = at[order[twice]]
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + WINDOW, -1)
    out["n_repeat_words"] = segment_sum((np.cumsum(cover[:-1]) > 0).astype(np.int64), first)
    return out


def with_counts(docs: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns `keep` of it) with a struct `column` of COUNTS."""
    kept = keep if keep is not None else docs.columns
    at = {c: f"c{k}" for k, c in enumerate(kept)}  # Arrow tasks look names with dots up as fields
    source = docs.select(F.col("text").alias("measured_text"), *[F.col(f"`{c}`").alias(n) for c, n in at.items() if c != "text"])
    struct = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    kinds = {c: docs.schema[c].dataType for c in kept}
    schema = T.StructType([*[T.StructField(n, kinds[c]) for c, n in at.items()], T.StructField("counts", struct)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column(0), lower=False):
                got = chunk_counts(words)
                part = batch.slice(i, j - i)
                counts = pa.StructArray.from_arrays([pa.array(np.asarray(got[c], dtype=np.int64)) for c in COUNTS], names=list(COUNTS))
                columns = [part.column("measured_text" if c == "text" else n) for c, n in at.items()]
                yield pa.RecordBatch.from_arrays([*columns, counts], names=[*at.values(), "counts"])

    return source.mapInArrow(measure, schema).toDF(*kept, column)


def _ratios(counts: str) -> dict[str, Column]:
    at = lambda n: F.col(f"{counts}.{n}").cast("double")
    return {r: F.when(at(d) > 0, at(n) / at(d)).otherwise(F.lit(0.0)) for r, (n, d, *_) in RULES.items()}


def sketches(measured: DataFrame, counts: str) -> DataFrame:
    """Bucket counts (lang, source, rule, bucket, n) over documents that pass the base rule; add n to merge."""
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    bucket = lambda v: F.when(v < SMALLEST, F.lit(ZERO)).otherwise(F.ceil(F.log(v) / np.log(gamma)).cast("int"))
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(v).alias("bucket")) for r, v in _ratios(counts).items()]))
    return (
        measured.filter(~base_failed(counts))
        .select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), values.alias("v"))
        .groupBy("lang", "source", "v.rule", "v.bucket")
        .agg(F.count("*").alias("n"))
    )


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """q25, q75 and top per group and rule, and the group's numbers of documents and of those whose ratio isn't 0."""
    from pyspark.sql import Window

    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    of = Window.partitionBy(*by, "rule")
    value = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1))
    ranked = (
        sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(of.orderBy("bucket")))
        .withColumn("all", F.sum("n").over(of))
        .withColumn("zeros", F.sum(F.when(F.col("bucket") == ZERO, F.col("n")).otherwise(0)).over(of))
        .withColumn("value", value)
    )
    q = lambda p: F.min(F.when(F.col("upto") >= F.ceil(p * F.col("all")), F.col("value")))
    top = F.min(F.when((F.col("bucket") != ZERO) & (10 * (F.col("upto") - F.col("zeros")) >= 9 * (F.col("all") - F.col("zeros"))), F.col("value")))
    return ranked.groupBy(*by, "rule").agg(
        q(0.25).alias("q25"), q(0.75).alias("q75"), F.coalesce(top, F.lit(0.0)).alias("top"), F.max("all").alias("n_docs"), F.max(F.col("all") - F.col("zeros")).alias("n_some")
    )


def blended(own: Column, n: Column, wider: Column) -> Column:
    """A group's own statistic with the wider group's as PRIOR documents beside its n."""
    return (n * own + PRIOR * wider) / (n + PRIOR)


STATISTICS = {"q25": "n_docs", "q75": "n_docs", "top": "n_some"}


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): a map from rule to its lower and upper fence."""
    own, of_lang = _quantiles(sketch, ["lang", "source"]), _quantiles(sketch, ["lang"])
    of_all = _quantiles(sketch, []).select("rule", F.struct(*STATISTICS).alias("a"))
    of_lang = of_lang.join(F.broadcast(of_all), "rule").select(  # a row a rule
        "lang", "rule", F.struct(*[blended(F.col(q), F.col(n), F.col(f"a.{q}")).alias(q) for q, n in STATISTICS.items()]).alias("l")
    )
    of_rule = lambda k: F.element_at(F.create_map(*[x for r, v in RULES.items() for x in (F.lit(r), F.lit(v[k]))]), F.col("rule"))
    fenced = own.join(of_lang, ["lang", "rule"]).select(
        "lang", "source", "rule", of_rule(4).alias("two"), *[blended(F.col(q), F.col(n), F.col(f"l.{q}")).alias(q) for q, n in STATISTICS.items()]
    )
    fenced = fenced.withColumn("width", F.greatest(of_rule(2) * (F.col("q75") - F.col("q25")), of_rule(3) * F.col("top")))
    ends = F.struct(F.when(F.col("two"), F.col("q25") - F.col("width")).alias("low"), (F.col("q75") + F.col("width")).alias("high"))
    return fenced.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rule", ends))).alias("fences"))


def base_failed(counts: str) -> Column:
    n, repeat = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n)


def judged(measured: DataFrame, counts: str, fences: DataFrame, failed: str) -> DataFrame:
    """measured with `failed`, the list of broken rules ('base' first)."""
    lang, source = F.coalesce(measured["lang"], F.lit("")), F.coalesce(measured["source"], F.lit(""))
    table = fences.select(F.col("lang").alias(f"{failed}_l"), F.col("source").alias(f"{failed}_s"), F.col("fences").alias(f"{failed}_f"))
    if fences.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    joined = measured.join(table, (lang == F.col(f"{failed}_l")) & (source == F.col(f"{failed}_s")), "left")
    broken = [F.when(base_failed(counts), F.lit("base"))]
    for rule, value in _ratios(counts).items():
        fence = F.col(f"{failed}_f")[rule]
        broken.append(F.when((value > fence["high"]) | F.coalesce(value < fence["low"], F.lit(False)), F.lit(rule)))
    return joined.withColumn(failed, F.array_compact(F.array(*broken))).drop(f"{failed}_l", f"{failed}_s", f"{failed}_f")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while any(t.startswith(name) for t in taken):
        name += "_"
    return name


def learn(docs: DataFrame) -> DataFrame:
    """Fences per (lang, source) from all of docs, as a written table."""
    measured = with_counts(docs.select("text", "lang", "source"), "q", ["lang", "source"])
    return write_table(thresholds(write_table(sketches(measured, "q"), "sketches")[0]), "fences")[0]


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass the base rule and all learnt fences, with docs' columns."""
    counts, failed = fresh(docs, "quality_counts"), fresh(docs, "quality_failed")
    fences = learn(docs)
    return judged(with_counts(docs, counts), counts, fences, failed).filter(F.size(failed) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base verdict and the adaptive one."""
    measured, _ = write_table(with_counts(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), "q", ["doc_id", "lang", "source"]), "quality")
    fences, _ = write_table(thresholds(sketches(measured, "q")), "fences")
    rated = judged(measured, "q", fences, "failed")
    return rated.select(
        "doc_id", *[f"q.{c}" for c in COUNTS], base_failed("q").alias("base_failed"), (F.size("failed") == 0).alias("kept"), F.array_join("failed", ",").alias("failed_rules")
    )
