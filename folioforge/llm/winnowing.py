"""Document fingerprints by winnowing.

Every run of GRAM neighbouring characters (code points) has a rolling hash; of
each WINDOW neighbouring hashes the least is chosen, the rightmost of equal
ones, and kept with its place.  Two texts that share a run of GUARANTEE
characters share a chosen hash inside it, wherever it lies in either; no run
under GRAM characters is ever seen.  A text of fewer than GRAM characters is
one gram as a whole, an empty or null one has no fingerprint; a text of fewer
than WINDOW grams is one window.

Texts are read whole: long ones in runs of bounded length, whose windows overlap
as those of one run would.  Equal texts have equal fingerprints.  The likeness
of two fingerprints is the share of their distinct hashes that both have, 1 for
two without any.  Rows of one id follow each other by text, a null id is first;
equal rows are rows of their own.  A table without rows gives none.  Columns
other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.shared import documents
from folioforge.llm.textops import mix64
from folioforge.llm.tokens import text_batches

GRAM, WINDOW = 20, 31
GUARANTEE = GRAM + WINDOW - 1  # 50 characters
RUN = 1 << 18  # hashes at a time
BLOCKS_PER_TASK = 4

_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


@dataclass(frozen=True)
class Fingerprint:
    hashes: np.ndarray  # uint64, by place
    places: np.ndarray  # int64, where each gram begins

    def text(self) -> str:
        """hash:place of each, by place."""
        return ",".join(f"{h:016x}:{p}" for h, p in zip(self.hashes.tolist(), self.places.tolist(), strict=True))

    def distinct(self) -> np.ndarray:
        return np.unique(self.hashes)


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of each run of `gram` codes: one multiplication and addition carries it from place to place."""
    if not len(codes):
        return np.zeros(0, dtype=np.uint64)
    values = mix64((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    n = len(values) - gram + 1
    if n <= 1:
        gram, n = len(values), 1
    # by doubling: runs of 1, 2, 4 ... codes, joined to runs of `gram`
    out, have, step, run = np.zeros(n, dtype=np.uint64), 0, 1, values
    while True:
        if gram & step:
            out = out * np.uint64(pow(_BASE, step, _ALL + 1)) + run[have : have + n]
            have += step
        if have == gram:
            return mix64(out)
        run = run[:-step] * np.uint64(pow(_BASE, step, _ALL + 1)) + run[step:]
        step *= 2


def chosen(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of each window, rightmost of equal ones, each once."""
    span = min(window, len(hashes))
    if not span:
        return np.zeros(0, dtype=np.int64)
    least, at, have = hashes, np.arange(len(hashes)), 1
    while have < span:  # windows of twice the length, or overlapping ones for the rest
        step = min(have, span - have)
        left, right = least[:-step], least[step:]
        at = np.where(right <= left, at[step:], at[:-step])
        least, have = np.minimum(left, right), have + step
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def fingerprint(text: str | None, gram: int = GRAM, window: int = WINDOW, run: int = RUN) -> Fingerprint:
    codes = np.frombuffer((text or "").encode("utf-32-le"), dtype="<u4")
    hashes, places, last = [], [], -1
    for start in range(0, max(len(codes) - gram - window + 2, 1), run):  # first gram of a run's first window
        own = gram_hashes(codes[start : start + run + window + gram - 2], gram)
        at = chosen(own, window)
        at = at[at + start > last]
        hashes.append(own[at])
        places.append(at + start)
        last = int(places[-1][-1]) if len(at) else last
    return Fingerprint(np.concatenate(hashes), np.concatenate(places).astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct hashes of two fingerprints that both have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def common_places(a: Fingerprint, b: Fingerprint) -> list[tuple[int, int]]:
    """Places in a and b of each hash that both have chosen, every pair once."""
    order = np.argsort(b.hashes, kind="stable")
    low, high = (np.searchsorted(b.hashes[order], a.hashes, side=s) for s in ("left", "right"))
    return [(int(p), int(b.places[order[k]])) for p, i, j in zip(a.places, low, high, strict=True) for k in range(i, j)]


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes (64 bits as long) and places of each whole text; joined on hashes they give shared passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in text_batches(batch.column(1)):
                found = [fingerprint(t, gram, window) for t in texts]
                lists = [pa.array([x.tolist() for x in own], pa.list_(pa.int64())) for own in ([f.hashes.view(np.int64) for f in found], [f.places for f in found])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), *lists], names=["doc_id", "hashes", "places"])

    kind = docs.select("doc_id").dtypes[0][1]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, hashes array<long>, places array<long>")


# each text beside the next one


def in_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs in order, dealt to `block`s of neighbouring ids; `guest` marks a row that is there only as the next of the block's last.

    Block borders are ids of the table, so the guest of a block is the row that
    begins the following one; the last block's guest is the first row of all.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    held = ids.agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    n = BLOCKS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = sorted(set(ids.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [k / n for k in range(1, n)], 0.2 / n)))
    # doubles may lie between long ids, so each border is set to an id that is there
    real = spark.createDataFrame([(b,) for b in borders], "d double").join(ids.withColumn("d", F.col("doc_id").cast("double")), "d").select("doc_id").distinct() if borders else None
    splits = np.array(sorted(r[0] for r in real.collect()) if real is not None else [], dtype=np.int64)  # at most n
    if not held["nulls"]:
        splits = splits[splits > held["least"]] if len(splits) else splits
    first = None if held["nulls"] else held["least"]

    @F.pandas_udf("struct<block:int,host:int>")
    def place(values: pd.Series, nulls: pd.Series) -> pd.DataFrame:
        own, null = values.to_numpy(dtype=np.int64), nulls.to_numpy(dtype=bool)
        at = np.where(null, 0, np.searchsorted(splits, own, side="right"))
        host = np.where(~null & np.isin(own, splits), at - 1, -1)
        begins = null if first is None else ~null & (own == first)
        return pd.DataFrame({"block": at, "host": np.where(begins, len(splits), host)})

    name = F.col("doc_id").cast("long")
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("p", place(F.coalesce(name, F.lit(0).cast("long")), name.isNull()))
    seats = F.array_compact(F.array(F.struct(F.col("p.block").alias("block"), F.lit(False).alias("guest")), F.when(F.col("p.host") >= 0, F.struct(F.col("p.host").alias("block"), F.lit(True).alias("guest")))))
    seated = placed.select("doc_id", "text", F.inline(seats))
    return seated.repartition("block").sortWithinPartitions("block", "guest", "doc_id", "text").select("doc_id", "text", "block", "guest")


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as many first characters of the following text, or all of them."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def against_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs (doc_id, text)."""
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kind = docs.select("doc_id").dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out, size = None, [], 0
        types = None
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            ids, blocks, guests = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for i, texts in text_batches(batch.column(1)):
                for k, text in enumerate(texts, i):
                    if guests[k] and before is None:
                        continue  # a further row of the same id as the block's guest
                    own = fingerprint(text)
                    now = (blocks[k], ids[k], text, own, own.distinct())
                    if before is not None:
                        assert before[0] == now[0], "a block ends with its guest"
                        _, name, held, mark, parts = before
                        changed = edited(held, text)
                        other = fingerprint(changed)
                        row = (name, len(held), sha256(changed.encode()).hexdigest(), mark.text(), other.text(), likeness(parts, other.distinct()), likeness(parts, now[4]))
                        out.append(row)
                        size += len(row[3]) + len(row[4])
                    before = None if guests[k] else now
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(names))
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(names))

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_blocks(docs).mapInArrow(run, schema)


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness to each other and to the next document's."""
    return against_next(documents(spark, sf_dir).select("doc_id", "text"))
