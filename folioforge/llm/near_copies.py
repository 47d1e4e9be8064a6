"""Near copies by SimHash, at a Jaccard similarity (the form of operator 5 that the pipeline uses).

Two texts are near copies if their sets of `SHINGLE`-word shingles have a
Jaccard similarity of `SIMILARITY` or more; copies of copies belong together.
Texts of equal sets are one node.  At 0.8 two fingerprints of 64 bits differ in
some 10 bits, with so wide a spread that bits of them are poor keys: the more texts
there are, the more bits a key must have to leave few strangers in a group, and the
more keys a pair needs to share one.  So a set's keys come from its least shingles:
each of `KEYS` keys is made of the set's minima under `ROWS` orders, and two sets of
similarity s share it with the chance s^ROWS.  At the least similarity a pair shares
none of them with a chance of 0.07 %, strangers share none, and the number of keys
is the same for any number of texts.  Pairs in a group whose fingerprints of two
words differ in `RADII` bits at most are candidates, found by pivot distance tables
as in operator 5.  All distances to a random reference lie so close together that
with `RADII` of this size it discards nothing, so a group's `PIVOTS` pivots are members of its
own, far from one another: a copy of one is near it, what is no copy is far off.
Candidates that connect form a group, and inside it whole sets are compared, so a
link is never an estimate.

Groups of over `CELL` nodes are cut into chunks, and each pair of chunks is a
group of its own; where over `WHOLE` nodes connect, the keys' groups are compared.

Defined results: texts of 1 to SHINGLE - 1 words have one shingle; wordless and
null texts are copies of one another; texts of any length are read whole; null
ids come after all others; of equal rows one stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.components import components
from folioforge.llm.shared import drop_tables, write_table
from folioforge.llm.simhash import group_links, keep_least, named_classes
from folioforge.llm.textops import Words, mix64, windows, word_chunks

SHINGLE = 5
SIMILARITY = (4, 5)  # at least 4 fifths
WORDS = 2
RADII = (26, 36)  # most differing bits of the first 64 and 128; at the least similarity 9.8 and 19.5 on average, by 2.9 and 4.1
ROWS = 6
KEYS = 24
PIVOTS = 16
CELL = 512
WHOLE = 16 * CELL

_SEEDS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ORDERS = mix64(np.arange(1, ROWS * KEYS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, and where each text's begin (one more than texts)."""
    hashes, owner, counts = words.hashes(), words.owner(), words.counts
    found = windows(hashes, SHINGLE)
    inside = owner[: len(found)] == owner[len(hashes) - len(found) :]
    found, text = found[inside], owner[: len(found)][inside]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = np.array([windows(hashes[words.first[i] : words.first[i + 1]], int(counts[i]))[0] for i in short.tolist()], dtype=np.uint64)
        found, text = np.concatenate([found, whole]), np.concatenate([text, short])
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each of the runs hashes[first[i]:first[i + 1]] (none empty): bits set in over half of it."""
    n = np.diff(first)
    parts = -(-n // 255)  # eight counters to a word, of eight bits each
    head = np.cumsum(parts) - parts
    starts = np.repeat(first[:-1], parts) + 255 * (np.arange(parts.sum()) - np.repeat(head, parts))
    counts = np.empty((len(starts), 8, 8), dtype=np.int64)
    for k in range(8):
        counts[:, :, k] = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
    bits = 2 * np.add.reduceat(counts.reshape(-1, 64), head, axis=0) > n[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def minima_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """KEYS keys of each of the runs hashes[first[i]:first[i + 1]] (none empty)."""
    keys = np.zeros((len(first) - 1, KEYS), dtype=np.uint64)
    for at, order in enumerate(_ORDERS):  # hashes are mixed, so an odd multiple orders them anew
        least = np.minimum.reduceat(hashes * order, first[:-1])
        keys[:, at // ROWS] = mix64(keys[:, at // ROWS] ^ least ^ np.uint64(at))
    return keys


def signatures(docs: DataFrame, key: str) -> DataFrame:
    """key, node (hash of the shingle set, 0 if empty) and bits (WORDS of fingerprint, then KEYS keys, binary) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column(1), lower=True):
                found, first = shingle_sets(words)
                full = np.flatnonzero(np.diff(first))
                node, bits = np.zeros(j - i, dtype=np.uint64), np.zeros((j - i, WORDS + KEYS), dtype=np.uint64)
                if len(full):
                    runs = np.append(first[full], first[-1])
                    node[full] = mix64(np.add.reduceat(mix64(found), runs[:-1]) ^ np.diff(runs).astype(np.uint64))
                    for k, seed in enumerate(_SEEDS):
                        bits[full, k] = majority(mix64(found ^ seed), runs)
                    bits[full, WORDS:] = minima_keys(found, runs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(node.view(np.int64)), pa.array([b.tobytes() for b in bits], pa.binary())], names=[key, "node", "bits"])

    source = docs.select(key, "text")
    return source.mapInArrow(run, f"{key} {source.dtypes[0][1]}, node long, bits binary")


def keyed(nodes: DataFrame) -> DataFrame:
    """key, node and the fingerprint's words w0, w1, once for each key of nodes (node, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                bits = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint64).reshape(-1, WORDS + KEYS)
                every = np.repeat(np.arange(len(bits)), KEYS)
                columns = [bits[:, WORDS:].ravel(), part.column(0).to_numpy()[every], bits[every, 0], bits[every, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["key", "node", "w0", "w1"])

    return nodes.select("node", "bits").mapInArrow(run, "key long, node long, w0 long, w1 long")


def sets_of(texts: DataFrame) -> DataFrame:
    """node and shingles (64-bit hashes, sorted) of texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column(1), lower=True):
                found, first = shingle_sets(words)
                held = pa.array([found[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), held], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each of some sets (none empty) the position of one that it connects to by similar pairs; one for each connected part."""
    part, over, under = np.arange(len(sets)), *SIMILARITY
    order = np.argsort([len(s) for s in sets], kind="stable")
    _, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mask = np.zeros(int(flat.max()) + 1, dtype=np.int32)
    size = np.array([len(sets[i]) for i in order])
    while len(order):  # order, size and flat hold the sets that no part has yet, by size
        first = np.concatenate([[0], np.cumsum(size)])
        left = np.ones(len(order), dtype=bool)
        left[0], queue = False, [0]
        while queue and left.any():
            x = queue.pop()
            lo = int(np.searchsorted(size * under, size[x] * over, side="left"))
            hi = int(np.searchsorted(size * over, size[x] * under, side="right"))
            own = flat[first[x] : first[x + 1]]
            mask[own] = 1
            both = np.add.reduceat(mask[flat[first[lo] : first[hi]]], first[lo:hi] - first[lo])
            mask[own] = 0
            near = lo + np.flatnonzero(left[lo:hi] & ((over + under) * both >= over * (size[lo:hi] + size[x])))
            left[near] = False
            queue.extend(near.tolist())
        part[order[~left]] = order[0]
        flat = flat[np.repeat(left, size)]
        order, size = order[left], size[left]
    return part


def set_links(nodes: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Links (a, b long) that connect exactly the candidates with similar sets, of nodes (node, least, bits); least is the key of one of a node's docs."""
    own = nodes.filter("node != 0")
    member, _ = write_table(components(group_links(keyed(own), RADII, PIVOTS, members=True)), "candidates")
    counts, _ = write_table(member.groupBy("component").agg(F.count("*").alias("n")), "counts")
    joined = member.join(counts.hint("shuffle_hash"), "component")
    whole = joined.filter(F.col("n") <= WHOLE).select("node", F.col("component").alias("part"), "n")
    dealt = whole
    if not counts.filter(F.col("n") > WHOLE).isEmpty():
        wide, _ = write_table(keyed(own.join(joined.filter(F.col("n") > WHOLE).select("node"), "node")).select("key", "node"), "wide")
        shared, _ = write_table(wide.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("n > 1"), "shared")
        once = shared.groupBy("n", "members").agg(F.min("key").alias("key")).select("key", "n")  # groups of the same nodes
        dealt = whole.unionByName(wide.join(once, "key").select("node", F.col("key").alias("part"), "n"))
    chunks = F.when(F.col("n") > CELL, F.ceil(F.col("n") * 2 / CELL)).otherwise(1).cast("int")
    dealt = dealt.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("chunks = 1 OR own != other")  # a chunk's own pairs are looked at beside any other chunk
    dealt = dealt.select("node", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    texts = docs.join(nodes.join(member.select("node"), "node").select("node", F.col("least").alias(key)), key).select("node", "text")
    sets, _ = write_table(sets_of(texts).dropDuplicates(["node"]), "sets")

    def group(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        part = linked([np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in table.column("shingles")]) if len(node) > 1 else np.zeros(1, dtype=np.int64)
        joined = part != np.arange(len(node))
        return pa.table({"a": node[joined], "b": node[part[joined]]})

    return dealt.join(sets, "node").select("node", "part", "i", "j", "shingles").groupBy("part", "i", "j").applyInArrow(group, "a long, b long").distinct()


def near_copies(docs: DataFrame, key: str) -> DataFrame:
    """key and component (least key reachable) of each row of docs."""
    rows, _ = write_table(signatures(docs, key), "signatures")
    nodes, path = write_table(rows.groupBy("node").agg(F.min(key).alias("least"), F.min("bits").alias("bits")), "nodes")
    links, links_path = write_table(set_links(nodes, docs, key), "links")
    of = named_classes(nodes.select("node", "least"), links)
    drop_tables(docs.sparkSession, path, links_path)
    return rows.join(of, "node").select(key, "component")


def keep_first(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without all but one row of each group of near copies: that of its least key (null keys last)."""
    return keep_least(docs, key, near_copies)
