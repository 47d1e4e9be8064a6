"""Interpolated modified Kneser-Ney bigram model (operator 1).

Spark counts words, then word pairs: each task sums its part with numpy and
sends one sorted block of keys and counts per shard, so a frequent word or pair
costs each task one entry.  Shards are merged into sorted hash arrays, files in
the shared folder that scoring workers map into memory:

* vocabulary shards, by ranges of the word hash: hash, count; a word's id is its
  rank over all shards;
* continuation shards, aligned to them: as a context the total and the numbers
  of followers seen once, twice and more often; as a word its distinct contexts;
* pair shards: context id << 32 | word id, and count.  A pair's shard follows its
  context, or the whole pair where the context is frequent, so no shard is hot.

The order is two: in this kind of text most trigrams are new (19 of 27 million
in a tenth of a gigabyte), and their tables would not fit the disk set for this
operator.  Words lie between ASCII white space, A-Z lowered; an end token closes
each text.  A word that training lacks gets the uniform share of the unigrams.

Defined results: null text is an empty text (the end token alone); a null id
trains and isn't held out; repeated rows count and are scored one by one; without
training rows every token has probability 1; texts of any length are scored whole;
an empty table gives no rows; extra columns are not read.  Equal
64-bit hashes of different words would be counted as one word.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.shared import documents, mounted, shared_path
from folioforge.llm.textops import Words, mix64, word_chunks

END = np.uint64(0x0E0D0E0D0E0D0E0D)
HELD_ENTRIES = 2_000_000
SHARD_BYTES = 32 << 20  # of text for each shard at most
VOCABULARY = {"hash": "u8", "count": "u8"}
CONTEXTS = {"total": "u8", "once": "u4", "twice": "u4", "more": "u4", "preceded": "u4"}
PAIRS = {"key": "u8", "count": "u4"}
MOST_TYPES = (1 << 32) - 2  # word numbers, the start of text and no word included, are halves of a pair's key


# files of equally long arrays, one after another


def write_arrays(path: str, layout: dict[str, str], arrays: dict[str, np.ndarray]) -> None:
    """Written under a name of its own and renamed, so a repeated task leaves one whole file. A value too large for its array is an error."""
    for name, kind in layout.items():
        if len(arrays[name]) and int(arrays[name].max()) > np.iinfo(kind).max:
            raise OverflowError(f"{name} of {path} exceeds {kind}")
    part = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(part, "wb") as f:
        for name, kind in layout.items():
            f.write(np.ascontiguousarray(arrays[name], dtype=f"<{kind}").data)
    os.replace(part, path)


@lru_cache(maxsize=4096)
def map_arrays(path: str, n: int, layout: tuple[tuple[str, str], ...]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, kind in layout:
        out[name] = np.memmap(path, dtype=f"<{kind}", mode="r", offset=at, shape=(n,)) if n else np.zeros(0, dtype=kind)
        at += n * int(kind[1])
    return out


@dataclass
class Model:
    folder: str
    words: list[int] = field(default_factory=list)  # of each vocabulary shard
    pairs: list[int] = field(default_factory=list)  # of each pair shard
    tokens: int = 0
    busy: int = 0  # a context of over so many tokens is dealt by whole pairs
    discounts: tuple[tuple[float, ...], ...] = ((0.0,) * 4,) * 2  # by count 0, 1, 2, 3+ for unigrams and pairs
    preceded: int = 0
    spare: float = 1.0  # unigram mass for the uniform distribution

    @property
    def types(self) -> int:
        return sum(self.words)

    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.words)]).astype(np.int64)

    def vocabulary(self, r: int) -> dict[str, np.ndarray]:
        return map_arrays(f"{mounted(self.folder)}/vocabulary-{r}", self.words[r], tuple(VOCABULARY.items()))

    def contexts(self, r: int) -> dict[str, np.ndarray]:
        last = r == len(self.words) - 1  # holds the start of text too
        return map_arrays(f"{mounted(self.folder)}/contexts-{r}", self.words[r] + last, tuple(CONTEXTS.items()))

    def pair_table(self, s: int) -> dict[str, np.ndarray]:
        return map_arrays(f"{mounted(self.folder)}/pairs-{s}", self.pairs[s], tuple(PAIRS.items()))

    def pair_shard(self, keys: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
        context = mix64(keys >> np.uint64(32))
        return (np.where(context_counts > self.busy, mix64(keys), context) % np.uint64(len(self.pairs))).astype(np.int64)


def token_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end tokens included, and where each text's begin."""
    texts = len(words.offsets) - 1
    first = words.first + np.arange(texts + 1)
    out = np.full(first[-1], END, dtype=np.uint64)
    out[np.arange(len(words)) + words.owner()] = words.hashes()
    return out, first


def locate(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of sorted `wanted` in a sorted array, and whether they are there."""
    spot = np.searchsorted(table, wanted)
    inside = spot < len(table)
    inside[inside] = table[spot[inside]] == wanted[inside]
    return spot, inside


def word_ids(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: unknown) and counts of sorted distinct hashes."""
    ids, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
    offsets, shards = model.offsets(), len(model.words)
    cuts = np.searchsorted(hashes >> np.uint64(64 - shards.bit_length() + 1), np.arange(shards + 1)) if shards > 1 else np.array([0, len(hashes)])
    for r in range(shards):
        own = slice(cuts[r], cuts[r + 1])
        if own.stop > own.start and model.words[r]:
            table = model.vocabulary(r)
            spot, there = locate(table["hash"], hashes[own])
            ids[own][there] = spot[there] + offsets[r]
            counts[own][there] = table["count"][spot[there]]
    return ids, counts


class Summed:
    """Sums counts by key, holding about HELD_ENTRIES at most."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = summed([k for k, _ in self.parts], [c for _, c in self.parts])
        self.parts, self.size = [], 0
        return out


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[heads], np.add.reduceat(count, heads) if len(heads) else count


def blocks(shard: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per shard with its rows of each column as bytes; order inside a shard is kept."""
    order = np.argsort(shard, kind="stable")
    names, starts = np.unique(shard[order], return_index=True)
    ends = np.append(starts[1:], len(order))[: len(starts)]
    cut = {n: [x[order[a:b]].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] for n, x in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), *(pa.array(v, pa.binary()) for v in cut.values())], names=["shard", *cut])


def unblocked(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype=kind) for x in table.column(name)]


def times(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in range(1, 5)]


def discounts(n: list[int]) -> tuple[float, ...]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3+ from the numbers of counts 1 to 4."""
    if min(n) == 0:
        return 0.0, 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return 0.0, *(min(max(d, 0.01), k) for k, d in enumerate(raw, 1))


def train(docs: DataFrame) -> Model:
    """A model of docs' texts, in the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wide = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))  # a shard stays as large when the input grows
    shards = 1 << (wide - 1).bit_length()
    model = Model(shared_path(spark, "kneser-ney"), [0] * shards, [0] * wide)
    folder, texts = mounted(model.folder), docs.select("text")
    bits = np.uint64(64 - shards.bit_length() + 1)
    range_of = lambda h: (h >> bits).astype(np.int64) if shards > 1 else np.zeros(len(h), dtype=np.int64)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Summed()
        send = lambda kc: blocks(range_of(kc[0]), {"keys": kc[0], "counts": kc[1]})
        for batch in batches:
            for _, _, words in word_chunks(batch.column(0), lower=True):
                held.add(*np.unique(token_hashes(words)[0], return_counts=True))
                if held.size > HELD_ENTRIES:
                    yield send(held.take())
        yield send(held.take())

    def merge_words(table: pa.Table) -> pa.Table:
        r = table.column("shard")[0].as_py()
        key, count = summed(unblocked(table, "keys", "<u8"), unblocked(table, "counts", "<i8"))
        write_arrays(f"{folder}/vocabulary-{r}", VOCABULARY, {"hash": key, "count": count})
        return pa.table({"shard": [r], "types": [len(key)], "tokens": [int(count.sum())]})

    sent = "shard long, keys binary, counts binary"
    for row in texts.mapInArrow(count_words, sent).groupBy("shard").applyInArrow(merge_words, "shard long, types long, tokens long").collect():
        model.words[row.shard] = row.types
        model.tokens += row.tokens
    if model.types > MOST_TYPES:
        raise OverflowError(f"{model.types} distinct words; pair keys hold {MOST_TYPES}")
    model.busy = model.tokens // (8 * wide)
    start = np.uint64(model.types)
    offsets = model.offsets()

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, often = Summed(), Summed()

        def send() -> pa.RecordBatch:
            key, count = held.take()
            context, many = often.take()
            spot, _ = locate(context, key >> np.uint64(32))
            return blocks(model.pair_shard(key, many[spot]), {"keys": key, "counts": count})

        for batch in batches:
            for _, _, words in word_chunks(batch.column(0), lower=True):
                hashes, first = token_hashes(words)
                unique, back = np.unique(hashes, return_inverse=True)
                ids, counts = word_ids(model, unique)
                word = ids[back].astype(np.uint64)
                context = np.empty_like(word)
                context[1:] = word[:-1]
                context[first[:-1]] = start
                held.add(*np.unique(context << np.uint64(32) | word, return_counts=True))
                order = np.argsort(ids)
                often.parts = [(np.append(ids[order].astype(np.uint64), start), np.append(counts[order], np.iinfo(np.int64).max >> 1))] + often.parts
                if len(often.parts) > 1:
                    k = np.concatenate([p[0] for p in often.parts])
                    at = np.unique(k, return_index=True)[1]
                    often.parts = [(k[at], np.concatenate([p[1] for p in often.parts])[at])]
                if held.size > HELD_ENTRIES:
                    yield send()
        if held.parts:
            yield send()

    def merge_pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        s = table.column("shard")[0].as_py()
        key, count = summed(unblocked(table, "keys", "<u8"), unblocked(table, "counts", "<i8"))
        write_arrays(f"{folder}/pairs-{s}", PAIRS, {"key": key, "count": count})
        context, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        sums = lambda x: np.add.reduceat(x.astype(np.int64), heads)
        as_context = {"ids": context[heads], "total": sums(count), "once": sums(count == 1), "twice": sums(count == 2), "more": sums(count > 2)}
        words, preceded = np.unique(word, return_counts=True)
        for kind, ids, columns in (("context", as_context["ids"], as_context), ("word", words, {"ids": words, "total": preceded})):
            r = np.minimum(np.searchsorted(offsets, ids, side="right") - 1, shards - 1)
            own = {n: x.astype("<i8" if n == "total" else "<u4") for n, x in columns.items()}
            for n in ("once", "twice", "more"):
                own.setdefault(n, np.zeros(len(ids), dtype="<u4"))
            made = blocks(r, own)
            yield pa.table({"shard": made.column("shard"), "kind": [kind] * made.num_rows, **{n: made.column(n) for n in own}, "pair_shard": [s] * made.num_rows, "types": [len(key)] * made.num_rows, "times": [times(count)] * made.num_rows})

    def merged_pairs(table: pa.Table) -> pa.Table:
        return pa.concat_tables(list(merge_pairs(table)))

    stats = "shard long, kind string, ids binary, total binary, once binary, twice binary, more binary, pair_shard long, types long, times array<long>"
    from folioforge.llm.shared import write_table

    parts, _ = write_table(texts.mapInArrow(count_pairs, sent).groupBy("shard").applyInArrow(merged_pairs, stats), "continuations")
    seen = np.zeros(4, dtype=np.int64)
    for row in parts.select("pair_shard", "types", "times").dropDuplicates(["pair_shard"]).collect():
        model.pairs[row.pair_shard] = row.types
        seen += row.times

    def merge_contexts(table: pa.Table) -> pa.Table:
        r = table.column("shard")[0].as_py()
        n = model.words[r] + (r == shards - 1)
        out = {name: np.zeros(n, dtype=np.int64) for name in CONTEXTS}
        for kind, names in (("context", ("total", "once", "twice", "more")), ("word", ("preceded",))):
            own = table.filter(pa.compute.equal(table.column("kind"), kind))
            at = np.concatenate([*unblocked(own, "ids", "<u4"), np.zeros(0, dtype="<u4")]).astype(np.int64) - offsets[r]
            for name in names:
                column = "total" if name == "preceded" else name
                values = np.concatenate([*unblocked(own, column, "<i8" if column == "total" else "<u4"), np.zeros(0, dtype="<i8")])
                np.add.at(out[name], at, values.astype(np.int64))
        write_arrays(f"{folder}/contexts-{r}", CONTEXTS, out)
        p = out["preceded"]
        return pa.table({"shard": [r], "times": [times(p)], "more": [int((p > 2).sum())], "preceded": [int(p.sum())]})

    every = spark.range(shards).select(F.col("id").alias("shard"))  # a shard without words still gets its file
    filled = parts.drop("pair_shard", "types", "times").unionByName(every, allowMissingColumns=True)
    rows = filled.groupBy("shard").applyInArrow(merge_contexts, "shard long, times array<long>, more long, preceded long").collect()
    of_words = np.sum([r.times for r in rows], axis=0)
    model.discounts = discounts(of_words.tolist()), discounts(seen.tolist())
    model.preceded = sum(r.preceded for r in rows)
    if model.preceded:
        d = model.discounts[0]
        model.spare = float((d[1] * of_words[0] + d[2] * of_words[1] + d[3] * sum(r.more for r in rows)) / model.preceded)
    return model


def chunk_scores(model: Model, words: Words) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text of a chunk."""
    hashes, first = token_hashes(words)
    unique, back = np.unique(hashes, return_inverse=True)
    ids, counts = word_ids(model, unique)
    offsets, shards = model.offsets(), len(model.words)
    fields = {name: np.zeros(len(unique) + 1, dtype=np.float64) for name in CONTEXTS}  # the last: start of text
    known = ids >= 0
    shard = np.searchsorted(offsets, ids, side="right") - 1
    for r in np.unique(shard[known]).tolist():
        own = np.flatnonzero(known & (shard == r))
        table = model.contexts(r)
        for name, x in fields.items():
            x[own] = table[name][ids[own] - offsets[r]]
    if model.tokens:
        for name, x in fields.items():
            x[-1] = model.contexts(shards - 1)[name][model.words[-1]]
    one, two = np.array(model.discounts[0]), np.array(model.discounts[1])
    less = lambda c, d: np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0)
    unigram = less(fields["preceded"], one) / max(model.preceded, 1) + model.spare / (model.types + 1)
    total = fields["total"]
    reserve = np.where(total > 0, (two[1] * fields["once"] + two[2] * fields["twice"] + two[3] * fields["more"]) / np.maximum(total, 1), 1.0)

    before = np.empty(len(back), dtype=np.int64)
    before[1:] = back[:-1]
    before[first[:-1]] = len(unique)
    id_of = np.append(ids, model.types)
    key = id_of[before].astype(np.uint64) << np.uint64(32) | ids[back].astype(np.uint64)
    both = np.flatnonzero((id_of[before] >= 0) & (ids[back] >= 0))
    keys, at, inverse = np.unique(key[both], return_index=True, return_inverse=True)
    often = np.append(counts, np.iinfo(np.int64).max >> 1)[before[both[at]]]
    found = np.zeros(len(keys), dtype=np.float64)
    if len(keys):
        own_shard = model.pair_shard(keys, often)
        order = np.argsort(own_shard, kind="stable")
        names, begins = np.unique(own_shard[order], return_index=True)
        for s, a, b in zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
            table, own = model.pair_table(s), order[a:b]
            spot, there = locate(table["key"], keys[own])
            found[own[there]] = table["count"][spot[there]]
    times_seen = np.zeros(len(back))
    times_seen[both] = found[inverse]
    p = less(times_seen, two) / np.maximum(total[before], 1) + reserve[before] * unigram[back]
    base = np.log10((counts[back] + 1) / (model.tokens + model.types + 1))
    per_text = lambda x: np.add.reduceat(x, first[:-1])
    return {"n_tokens": np.diff(first), "n_known": per_text((counts[back] > 0).astype(np.int64)), "base_score": per_text(base), "score": per_text(np.log10(p))}


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, base_score, score (log10) and perplexity of each row of docs."""
    source = docs.select(key, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column(1), lower=True):
                got = chunk_scores(model, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x) for x in got.values())], names=[key, *got])

    rows = source.mapInArrow(run, f"{key} {source.dtypes[0][1]}, n_tokens long, n_known long, base_score double, score double")
    return rows.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the model of those whose remainder isn't 2."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = train(docs.filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
