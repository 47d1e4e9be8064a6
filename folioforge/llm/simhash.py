"""SimHash near-duplicate detection with pivot distance tables (operator 5).

A text's fingerprint is the bitwise majority over the XXH64 hashes of its word
shingles.  Equal fingerprints are one node.  Two nodes link at `RADIUS` or fewer
differing bits, found exactly: the 64 bits are cut into blocks, and since at most
RADIUS blocks can differ, any link agrees on all others; each such choice of
blocks is a key to group by.  Keys are as coarse as the number of nodes allows
(`blocks_for`), so that groups are large and the pivots do the discarding: each
fingerprint has a table of Hamming distances to `PIVOTS` reference fingerprints,
and by the triangle inequality a pair whose coordinates differ by more than
RADIUS anywhere can't link.  A group is sorted by its first coordinate, which
limits the pairs looked at to a band; every other coordinate is then applied to
every pair, and survivors are verified.  What is returned is a spanning forest
of each group's links.

Groups of over `CELL` nodes are cut into chunks, and each pair of chunks is a
group of its own, so no task holds a large group.

Defined results: null or wordless text has fingerprint zero and links like any
other; texts of any length are read whole; repeated rows (and repeated ids) are
returned one by one; null ids are fingerprinted but don't name a component; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.components import components
from folioforge.llm.shared import documents, drop_tables, write_table
from folioforge.llm.textops import mix64

SHINGLE = 4
SEED = 42
RADIUS = 4
PIVOTS = 16
CELL = 4096
CROWD = 2048  # nodes that a group of equal block keys may have on average
CHUNK_PAIRS = 2_000_000
GROUP_ROWS = 100_000  # rows whose whole groups are compared at once

REFERENCES = mix64(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if over half the shingles' hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest, k = xxhash.xxh64_intdigest, min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str, shingle: int = SHINGLE) -> DataFrame:
    """key and fp (the fingerprint's bits as a long) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    source = docs.select(key, "text")
    return source.mapInArrow(run, f"{key} {source.dtypes[0][1]}, fp long")


def blocks_for(nodes: int, radius: int = RADIUS) -> int:
    """The fewest blocks whose keys leave CROWD nodes or fewer in a group of random fingerprints; any number is exact."""
    blocks = radius + 1
    while blocks < 16 and nodes > CROWD << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """One mask of bits for each choice of blocks that a link may agree on."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(block, blocks - radius)]


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference: [reference, fingerprint]."""
    return np.bitwise_count(REFERENCES[:, None] ^ fps[None, :]).astype(np.int8)


def member_table(group: np.ndarray, words: np.ndarray, pivots: int) -> np.ndarray:
    """Hamming distance over all words of each fingerprint to `pivots` members of its own group: [pivot, fingerprint].

    The first of a group is its first pivot, each next one is the member farthest from those before.
    """
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes, place = np.diff(np.append(starts, len(group))), np.arange(len(group))
    table, pivot, near = np.empty((pivots, len(group)), dtype=np.int16), starts, np.full(len(group), 1 << 14)
    for row in table:
        row[:] = np.bitwise_count(words ^ words[:, np.repeat(pivot, sizes)]).sum(axis=0, dtype=np.int16)
        near = np.minimum(near, row)
        pivot = np.maximum.reduceat(near << 40 | place, starts) & ((1 << 40) - 1)
    return table


def linked_pairs(group: np.ndarray, words: np.ndarray, radii: tuple[int, ...], pivots: int, members: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs in one group whose first k words (rows of `words`) differ in radii[k - 1] bits at most.

    group is sorted; the pairs of each group are those in a band of the first
    coordinate, less those that any other coordinate discards.  Pivots are the
    fixed references, for the first word, or `members` of the group, for all words.
    """
    if not len(group):
        return
    table, reach, width = (member_table(group, words, pivots), radii[-1], 64 * len(words) + 1) if members else (pivot_table(words[0])[:pivots], radii[0], 65)
    first = group * width + table[0]
    order = np.argsort(first, kind="stable")
    high = np.searchsorted(first[order], np.minimum(first[order] + reach, group[order] * width + width - 1), side="right")
    words, table = words[:, order], table[:, order]
    own = np.arange(len(order))
    sizes, at = high - own - 1, 0
    while at < len(order):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK_PAIRS, side="right")))
        part = sizes[at : at + n]
        a = np.repeat(own[at : at + n], part)
        b = np.arange(len(a)) - np.repeat(np.cumsum(part) - part, part) + a + 1
        for column in table[1:]:
            near = np.abs(column[a] - column[b]) <= reach
            a, b = a[near], b[near]
        differ = np.zeros(len(a), dtype=np.int64)
        for row, radius in zip(words, radii, strict=True):
            differ += np.bitwise_count(row[a] ^ row[b])
            near = differ <= radius
            a, b, differ = a[near], b[near], differ[near]
        if len(a):
            yield order[a], order[b]
        at += n


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least position connected to each of n positions."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            np.minimum.at(root, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def group_links(keyed: DataFrame, radii: tuple[int, ...], pivots: int = PIVOTS, members: bool = False) -> DataFrame:
    """Links (a, b long) that connect, in each group of keyed (key, node long, and a column of bits per radius), the nodes within radii of one another."""
    columns = [c for c in keyed.columns if c not in ("key", "node")]
    large, path = write_table(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CELL), "large")
    dealt = keyed.withColumn("own", F.lit(0)).withColumn("other", F.lit(0))
    if not large.isEmpty():
        chunks = keyed.join(large, "key", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("n") * 2 / CELL), F.lit(1)).cast("int"))
        chunks = chunks.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = chunks.filter("chunks = 1 OR own != other")  # a chunk's own pairs are looked at beside any other chunk
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", *columns)

    def links(rows: dict[str, np.ndarray], heads: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(heads)
        n = np.diff(np.append(at, len(heads)))
        shared = np.repeat(n > 1, n)
        node, group = rows["node"][shared], np.cumsum(heads)[shared]
        root = spanning(len(node), linked_pairs(group, np.stack([rows[c][shared].view(np.uint64) for c in columns]), radii, pivots, members))
        joined = (root != np.arange(len(node))) & (node != node[root])
        pairs = np.unique(np.stack([node[joined], node[root[joined]]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            rows = {n: np.concatenate([b.column(n).to_numpy() for b in held]) for n in held[0].schema.names}
            heads = np.ones(len(rows["key"]), dtype=bool)
            heads[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["i"][1:] != rows["i"][:-1]) | (rows["j"][1:] != rows["j"][:-1])
            end = len(heads) if last else int(np.flatnonzero(heads)[-1])  # the last group may go on
            rest = pa.RecordBatch.from_arrays([pa.array(x[end:]) for x in rows.values()], names=list(rows))
            held[:] = [rest] if rest.num_rows else []
            if end:
                yield links({n: x[:end] for n, x in rows.items()}, heads[:end])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= GROUP_ROWS:
                yield from flush(False)
        if held:
            yield from flush(True)

    found, links_path = write_table(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct(), "links")
    drop_tables(keyed.sparkSession, path)
    return found


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Links (a, b long) between distinct fingerprints fp that connect exactly those within radius of one another."""
    blocks = blocks or blocks_for(nodes.count(), radius)
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, radius)]
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])  # keys that collide share a group, no more
    return group_links(nodes.select(F.explode(keys).alias("key"), F.col("fp").alias("node"), F.col("fp").alias("bits")), (radius,))


def near_duplicates(docs: DataFrame, key: str, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """key, fp and component (least key reachable) of each row of docs."""
    rows, _ = write_table(fingerprints(docs, key, shingle), "fingerprints")
    nodes, path = write_table(rows.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    of = named_classes(nodes.withColumnRenamed("fp", "node"), fingerprint_links(nodes, radius))
    drop_tables(docs.sparkSession, path)
    return rows.join(of.withColumnRenamed("node", "fp"), "fp").select(key, "fp", "component")


def named_classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and component, the least `least` of those connected, of all nodes (node, least); a written table."""
    least = components(links).join(nodes, "node").select("node", "component", "least")
    named, path = write_table(least.groupBy("component").agg(F.min("least").alias("own")), "named")  # apart from the sums, so that the join may split a large component's partition
    of, _ = write_table(nodes.join(least.join(named, "component").select("node", "own"), "node", "left").select("node", F.coalesce("own", "least").alias("component")), "classes")
    drop_tables(links.sparkSession, path)
    return of


def keep_least(docs: DataFrame, key: str, find: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """docs without all but one row of each component (of find's result: key, component): that of its least key (null keys last)."""
    own = "near_key"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    place = F.struct(F.col(key).isNull().alias("none"), F.coalesce(key, F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"))
    component = find(docs.select(place.alias(own), "text"), own)
    kept, _ = write_table(component.filter(F.col(own) == F.col("component")).groupBy(own).agg(F.count("*").alias("rows")), "kept")
    left = docs.withColumn(own, place).join(kept.select(own), own, "left_semi")
    if not kept.filter("rows > 1").isEmpty():  # equal rows: one of them
        left = left.dropDuplicates([own])
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_first(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """docs without all but one row of each component: that of its least key (null keys last)."""
    return keep_least(docs, key, lambda rows, own: near_duplicates(rows, own, shingle=shingle))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = near_duplicates(documents(spark, sf_dir), "doc_id")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
