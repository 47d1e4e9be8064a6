"""Quality classifier by naive Bayes support vectors (operator 2).

Features are indicators of hashed n-grams: byte n-grams within and across words,
word pairs, and a mark for an n-gram of words that a text repeats.  Spark counts
each feature's documents per class over all labelled training rows; the smoothed
log-count ratios scale the indicators.  A linear hinge-loss model is then fitted
by dual coordinate descent on a bounded sample of `SAMPLE_ROWS` labelled rows,
those whose id has the smallest hash.

Scores are a logistic function of the margin, so 0.5 is the margin's zero.

Defined results: null text is an empty text and gets the score of the bias; a
null label teaches nothing; a null id is not held out and has no label; several
labels for one id count as several rows; of sampled rows with equal hashes those of
lesser id and label come first; repeated rows are scored one by one; texts of any
length are read whole; an empty table gives no rows; extra columns are not read;
without labels of both classes every score is the share of label 1 (0.5 without
labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.shared import documents, write_table
from folioforge.llm.textops import mix64, windows, word_chunks

BITS = 16
BYTE_GRAMS = (1, 2, 3)
WORD_GRAMS = (1, 2)
REPEATED = (2, 4, 8)  # marks for a word n-gram seen so many times
SAMPLE_ROWS = 4000
BROADCAST_LABELS = 1_000_000  # rows of an id and a label: under 24 MB
CHUNK = 1 << 20
PASSES = 12
COST = 0.05
ALPHA = 1.0


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(hashes + np.uint64(0x5851F42D4C957F2D * kind % 2**64)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each text."""
    seen = np.zeros(1 << BITS, dtype=bool)
    for i, j, words in word_chunks(column, lower=False, limit=CHUNK):
        data = words.data.astype(np.uint64)
        grams = [_bucket(data, 1)]
        rolled = data
        for n in range(2, max(BYTE_GRAMS) + 1):
            rolled = rolled[:-1] * np.uint64(257) + data[n - 1 :] if len(rolled) else rolled
            if n in BYTE_GRAMS:
                grams.append(_bucket(rolled, n))
        hashes = words.hashes()
        worded = {n: windows(hashes, n) for n in WORD_GRAMS}
        bucketed = {n: _bucket(w, 10 + n) for n, w in worded.items()}
        for row in range(j - i):
            a, b = words.offsets[row], words.offsets[row + 1]
            for n, g in zip(BYTE_GRAMS, grams, strict=True):
                seen[g[a : max(a, b - n + 1)]] = True
            a, b = words.first[row], words.first[row + 1]
            for n in WORD_GRAMS:
                seen[bucketed[n][a : max(a, b - n + 1)]] = True
                own = np.sort(worded[n][a : max(a, b - n + 1)])
                for times in REPEATED:
                    if len(own) >= times and (own[times - 1 :] == own[: len(own) - times + 1]).any():
                        seen[_bucket(np.array([times * 100 + n], dtype=np.uint64), 99)] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias minimising |w|^2 / 2 + cost * sum of hinge losses, by dual coordinate descent."""
    w, alpha = np.zeros(len(ratio)), np.zeros(len(rows))
    scaled = [ratio[r].astype(np.float32) for r in rows]
    norms = np.array([1.0 + float(x @ x) for x in scaled])
    bias, rng = 0.0, np.random.default_rng(11)
    costs = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(passes):
        for i in rng.permutation(len(rows)).tolist():
            r, x = rows[i], scaled[i]
            gradient = y[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), costs[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and label of docs' rows with a label; labels are broadcast if few, else joined once and written."""
    if labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("text", "label")
    return write_table(docs.select("doc_id", "text").join(labels, "doc_id").select("text", "label"), "labelled")[0]


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Weights per feature (ratio included) and bias, from docs (doc_id, text) and labels (doc_id, label 0 or 1)."""
    size = 1 << BITS
    labelled = labelled_texts(docs, labels)
    few = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, size), dtype=np.int64)
        for batch in batches:
            for found, label in zip(features(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                totals[label, found] += 1
        label, feature = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(label), pa.array(totals[label, feature])], names=["feature", "label", "n"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [f.astype("<u4").tobytes() for f in features(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1)], names=["features", "label"])

    counted = labelled.select("text", "label").mapInArrow(count, "feature long, label long, n long").groupBy("feature", "label").agg(F.sum("n").alias("n")).toPandas()
    totals = np.full((2, size), ALPHA)
    totals[counted["label"].to_numpy(), counted["feature"].to_numpy()] += counted["n"].to_numpy()
    of = {r.label: r["count"] for r in labels.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("label").count().collect()}
    if len(of) < 2:
        share = (of.get(1, 0) + 0.5) / (sum(of.values()) + 1) if of else 0.5
        return np.zeros(size), float(np.log(share / (1 - share)))
    ratio = np.log(totals[1] / totals[1].sum()) - np.log(totals[0] / totals[0].sum())
    # repeated ids give more rows than labels, so the rows are bounded too
    rows = sample.mapInArrow(extract, "features binary, label int").orderBy(F.xxhash64("features"), "features", "label").limit(sample_rows).toPandas().sort_values(["features", "label"])
    w, bias = fit_hinge([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in rows["features"]], np.where(rows["label"].to_numpy() == 1, 1.0, -1.0), ratio)
    return w * ratio, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id") -> DataFrame:
    """key and score of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            margins = np.array([weights[f].sum() for f in features(batch.column(1))], dtype=float) + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margins, -30, 30))))], names=[key, "score"])

    source = docs.select(key, "text")
    return source.mapInArrow(run, f"{key} {source.dtypes[0][1]}, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from labels whose remainder isn't 1."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))
    return score(docs, learn(docs, labels.filter(~held_out))).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
