"""Hierarchical residual best-fit packing (operator 4).

Documents become token pieces of at most `CAPACITY` tokens.  Partitions pack
their pieces best-fit in falling order.  Bins that are nearly full are final.
The others travel up a tree: each round deals them to nodes of at most
`NODE_BINS` bins, every node packs its bins as items of their used length, and
the next round has fewer bins and nodes, down to one node.  Rounds also end when
one joins under 1 % of the bins, as when every bin is over half full, so no node
ever holds more than `NODE_BINS` bins.

Ids are those of the tokenizers file of the same vocabulary, its added tokens
(`<|endoftext|>`) among them; the rank file gives them faster, and the tests hold
them equal.

Defined results: null text is an empty text (one piece, the separator alone);
null ids are kept; repeated rows are packed one by one; texts of any length are cut
into pieces whole; pieces of equal length are placed in the order of their rows;
extra columns are not read; no documents give no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.shared import documents, write_table
from folioforge.llm.tokens import CachedEncoder, pack as packed_ids, text_batches, vocabulary

CAPACITY = 2048
SEPARATOR = 0
NEARLY_FULL = CAPACITY - 8
NODE_BINS = 100_000
LOCAL_PIECES = 200_000
LEAST_GAIN = 0.01


@lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> CachedEncoder:
    """A CachedEncoder over a rank file, for this worker.

    New pieces are encoded as one string: each begins with a space before a
    non-space, so no token crosses from one to the next, and token lengths tell
    where a piece ends.
    """
    import tiktoken

    ranks = vocabulary(path).ranks
    library = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    length = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        length[rank] = len(token)

    def encode(pieces: list[str], heads: list[str]) -> tuple[list[bytes], list[bytes]]:
        ids = np.asarray(library.encode_to_numpy("".join(pieces), disallowed_special=()), dtype="<u4")
        cuts = 4 * np.searchsorted(np.cumsum(length[ids]), np.cumsum([len(p.encode()) for p in pieces]), side="right")
        data, at, out = ids.tobytes(), 0, []
        for end in cuts.tolist():
            out.append(data[at:end])
            at = end
        return out, [packed_ids(library.encode_ordinary(h)) for h in heads]

    return CachedEncoder(encode)


@lru_cache(maxsize=2)
def added_tokens(path: str) -> dict[str, bytes]:
    """Packed ids of the added tokens in the tokenizers file beside a rank file, longest first; none without that file."""
    beside = Path(path).with_suffix(".json")
    tokens = json.loads(beside.read_text(encoding="utf-8"))["added_tokens"] if beside.exists() else []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
        raise ValueError(f"{beside}: added tokens that depend on their surroundings")
    return {t["content"]: packed_ids([t["id"]]) for t in sorted(tokens, key=lambda t: -len(t["content"]))}


def token_ids(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """Packed ids of each text; texts are cut at added tokens, which have ids of their own."""
    encoder, added = rank_encoder(path, pattern), added_tokens(path)
    if not any(a in t for a in added for t in texts):
        return encoder.batch(texts)
    cut = re.compile(f"({'|'.join(map(re.escape, added))})")
    parts = [cut.split(t) for t in texts]  # every other part is an added token
    ids = iter(encoder.batch([p for own in parts for p in own[::2]]))
    return [b"".join(added[p] if k % 2 else next(ids) for k, p in enumerate(own)) for own in parts]


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: the first takes the rest, all others are full."""
    rest = n % capacity
    return [rest] * (rest > 0) + [capacity] * (n // capacity)


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, largest first into the fullest bin that still holds it."""
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    some, used = 0, []  # bit r of some: free[r] isn't empty
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        room -= size
        if room:
            free[room].append(b)
            some |= 1 << room
    return bins, offsets


def tokenized_pieces(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([SEPARATOR], dtype="<u4").tobytes()
        for batch in batches:
            for i, texts in text_batches(batch.column(1)):
                rows, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(token_ids(texts, path, pattern)):
                    ids += end
                    at = 0
                    for k, n in enumerate(piece_lengths(len(ids) // 4)):
                        rows.append(i + row)
                        piece.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                        at += n
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.select("doc_id").dtypes[0][1]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def packed_locally(pieces: DataFrame) -> DataFrame:
    """pieces with bin, bin_at (offset in it) and bin_used, packed inside each partition in bounded blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(held).combine_chunks()
            sizes = table.column("length").to_numpy()
            bins, offsets = best_fit(sizes)
            used = np.bincount(bins, weights=sizes).astype(np.int64)
            for name, x in (("bin", bins + made), ("bin_at", offsets), ("bin_used", used[bins])):
                table = table.append_column(name, pa.array(x))
            made += len(used)
            held.clear()
            return table.to_batches()[0]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= LOCAL_PIECES:
                yield flush()
        if held:
            yield flush()

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", bin long, bin_at long, bin_used long"
    return pieces.mapInArrow(run, schema)


def _node(table: pa.Table) -> pa.Table:
    """One node of the tree: bins packed as items of their used length."""
    table = table.sort_by("bin")  # the same result however the rows came
    ids, sizes = table.column("bin").to_numpy(), table.column("used").to_numpy()
    to, offsets = best_fit(sizes)
    used = np.bincount(to, weights=sizes).astype(np.int64)
    name = np.full(len(used), np.iinfo(np.int64).max)
    np.minimum.at(name, to, ids)
    return pa.table({"bin": ids, "new_bin": name[to], "shift": offsets, "used": used[to]})


def merged_bins(bins: DataFrame) -> DataFrame:
    """bins (bin, used), none nearly full: where each bin goes, as (bin, new_bin, shift)."""
    moves = bins.select("bin", F.col("bin").alias("new_bin"), F.lit(0).cast("long").alias("shift"))
    n, turn = bins.count(), 0
    while n > 1:
        nodes = -(-n // NODE_BINS)
        dealt = bins.withColumn("node", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(nodes)))
        step, _ = write_table(dealt.groupBy("node").applyInArrow(_node, "bin long, new_bin long, shift long, used long"), "moves")
        joined = moves.select("bin", F.col("new_bin").alias("via"), F.col("shift").alias("base")).join(step.select(F.col("bin").alias("via"), "new_bin", "shift"), "via", "left")
        moves, _ = write_table(joined.select("bin", F.coalesce("new_bin", "via").alias("new_bin"), (F.col("base") + F.coalesce("shift", F.lit(0))).alias("shift")), "moves")
        bins = step.filter((F.col("bin") == F.col("new_bin")) & (F.col("used") < NEARLY_FULL)).select("bin", "used")
        joined_now = n - step.filter(F.col("bin") == F.col("new_bin")).count()
        n, turn = bins.count(), turn + 1
        if nodes == 1 or joined_now < LEAST_GAIN * n:
            break
    return moves


def pack(pieces: DataFrame) -> DataFrame:
    """pieces (a written table with `length`) with sequence_id and offset."""
    placed, _ = write_table(packed_locally(pieces), "placed")
    bins = placed.filter((F.col("bin_at") == 0) & (F.col("bin_used") < NEARLY_FULL)).select("bin", F.col("bin_used").alias("used"))
    moves = merged_bins(bins)
    return placed.join(moves, "bin", "left").select(
        *pieces.columns, F.coalesce("new_bin", "bin").alias("sequence_id"), (F.col("bin_at") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def pack_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every piece of docs with its sequence and place."""
    return pack(write_table(tokenized_pieces(docs, path, pattern), "pieces")[0])


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers as public

    return pack_documents(documents(spark, sf_dir), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
