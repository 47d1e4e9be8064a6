"""Byte-level BPE by prefix dynamic programming (operator 8), and cached piecewise encoding.

For every prefix of a byte string exactly one last token is possible in its BPE
encoding: the token t ending there whose predecessor (the last token of the
prefix without t) forms a pair with it that BPE leaves unmerged.  Storing that
token per prefix gives the encoding of each prefix, so appends are exact and an
edit is re-encoded only until the stored tokens repeat.

Batches fill the tables of many strings at once: an automaton over the tokens
names the longest token that each prefix ends with, and arrays of prefixes of one
length try it, then the next shorter ones, against a table of unmerged pairs.

Defined results: null text is an empty text (no tokens, digests of no bytes);
null ids are kept as they are; repeated rows are encoded one by one; texts of any
length are encoded whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.shared import documents
from folioforge.llm.textops import mix64, pieces as row_ranges

CACHE_PIECES = 400_000
CACHE_CHARS = 64
CACHE_PAIRS = 1_000_000
LONG_PIECE = 128  # bytes
TABLE_CELLS = 4_000_000


class Vocabulary:
    """Ranks of a .tiktoken file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.unmerged: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: joins the neighbouring parts of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def pair(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are; left -1: `right` stands alone."""
        key = (left + 1) << 32 | right
        known = self.unmerged.get(key)
        if known is None:
            if len(self.unmerged) >= CACHE_PAIRS:
                self.unmerged.clear()
            alone = [] if left < 0 else [left]
            known = self.merge(b"".join(self.tokens[t] for t in [*alone, right])) == [*alone, right]
            self.unmerged[key] = known
        return known


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PrefixEncoder:
    """The encoding of every prefix of a byte string that may grow and change."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, b"", [-1]
        self.append(data)

    def _extend(self, upto: int, stop: Callable[[int], bool] | None = None) -> int:
        """Fills `last` for prefixes up to `upto`; returns where it ended."""
        vocab, last, data = self.vocab, self.last, self.data
        rank_of, known, longest = vocab.ranks.get, vocab.unmerged.get, vocab.longest
        for end in range(len(last), upto + 1):
            for start in range(max(0, end - longest), end):
                rank = rank_of(data[start:end])
                if rank is not None:
                    left = last[start]
                    ok = known((left + 1) << 32 | rank)
                    if vocab.pair(left, rank) if ok is None else ok:
                        last.append(rank)
                        break
            else:
                raise ValueError("the vocabulary lacks single bytes")
            if stop and stop(end):
                return end
        return upto

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """data[start:end] = new; returns how many prefixes were encoded anew."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        run = 0

        def settled(at: int) -> bool:
            nonlocal run
            run = run + 1 if at > start + len(new) and old[at - shift] == self.last[at] else 0
            return run >= self.vocab.longest

        reached = self._extend(len(self.data), settled)
        self.last += old[reached - shift + 1 :] if reached < len(self.data) else []
        return reached - start

    def ids(self, upto: int | None = None) -> list[int]:
        at = len(self.data) if upto is None else upto
        out = []
        while at:
            out.append(self.last[at])
            at -= len(self.vocab.tokens[out[-1]])
        return out[::-1]


class Automaton:
    """Suffix search over the vocabulary's tokens: one state per prefix of a token.

    `step[state * 256 + byte]` is the next state, `longest[state]` the longest token
    that a text in this state ends with, `shorter[token]` the next shorter one
    (-1: none).
    """

    def __init__(self, vocab: Vocabulary):
        child: dict[int, int] = {}
        at_depth: list[list[tuple[int, int, int]]] = [[]]
        node_of, nodes = {}, 1
        for token, rank in vocab.ranks.items():
            node = 0
            for depth, byte in enumerate(token):
                key = node << 8 | byte
                node = child.get(key, 0)
                if not node:
                    child[key] = node = nodes
                    nodes += 1
                    if len(at_depth) <= depth + 1:
                        at_depth.append([])
                    at_depth[depth + 1].append((key >> 8, byte, node))
            node_of[rank] = node
        token = np.full(nodes, -1, dtype=np.int32)
        token[list(node_of.values())] = list(node_of)
        size = max(vocab.ranks.values()) + 1
        step, fail = np.zeros((nodes, 256), dtype=np.int32), np.zeros(nodes, dtype=np.int32)
        self.longest, self.shorter, self.length = token.copy(), np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32)
        for level in at_depth[1:]:
            parent, byte, node = np.array(level, dtype=np.int64).T
            fail[node] = np.where(parent > 0, step[fail[parent], byte], 0)
            step[parent, byte] = node
            step[node] = step[fail[node]]  # its own children are set when their level comes
            own, behind = token[node], self.longest[fail[node]]
            self.longest[node] = np.where(own >= 0, own, behind)
            self.shorter[own[own >= 0]] = behind[own >= 0]
        self.step = step.ravel()
        for t, rank in vocab.ranks.items():
            self.length[rank] = len(t)


class PairTable:
    """Whether BPE leaves two tokens as they are (`Vocabulary.pair`), for whole arrays; a bounded table keeps answers."""

    SLOTS = 21  # bits

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.n = vocab, max(vocab.ranks.values()) + 1
        joined = sorted((vocab.ranks[t[:i]] * self.n + vocab.ranks[t[i:]], rank) for t, rank in vocab.ranks.items() for i in range(1, len(t)) if t[:i] in vocab.ranks and t[i:] in vocab.ranks)
        self.joins, self.rank = np.array([j for j, _ in joined], dtype=np.int64), np.array([r for _, r in joined], dtype=np.int64)
        self.byte = np.array([vocab.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.keys, self.answers = np.full(1 << self.SLOTS, -1, dtype=np.int64), np.zeros(1 << self.SLOTS, dtype=bool)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """left -1: right stands alone."""
        key = (left.astype(np.int64) + 1) * (self.n + 1) + right
        slot = (mix64(key.view(np.uint64)) >> np.uint64(64 - self.SLOTS)).view(np.int64)
        out = self.answers[slot]
        new = np.flatnonzero(self.keys[slot] != key)
        if len(new):
            asked, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            first = new[first]
            answer = self.left_alone(left[first].tolist(), right[first].tolist())
            out[new] = answer[back]
            self.keys[slot[first]], self.answers[slot[first]] = asked, answer
        return out

    def left_alone(self, left: list[int], right: list[int]) -> np.ndarray:
        """Runs plain BPE on all pairs at once: per round each joins its leftmost neighbours of lowest rank."""
        tokens, out = self.vocab.tokens, np.empty(len(left), dtype=bool)
        texts = [(tokens[a] if a >= 0 else b"") + tokens[b] for a, b in zip(left, right, strict=True)]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        end = np.array([len(tokens[a]) if a >= 0 else 0 for a in left], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            n = int(sizes[part[0]])
            parts = self.byte[np.frombuffer(b"".join(texts[i] for i in part.tolist()), dtype=np.uint8).reshape(-1, n)]
            begin = np.tile(np.arange(n), (len(part), 1))  # where each part begins
            border, alone = end[part], end[part] == 0
            whole, open_ = np.zeros(len(part), dtype=bool), np.arange(len(part))
            while parts.shape[1] > 1 and len(open_):
                ranks, rows, width = self.join(parts[:, :-1], parts[:, 1:]), np.arange(len(open_)), parts.shape[1]
                at = ranks.argmin(axis=1)
                done = ranks[rows, at] == NEVER
                whole[open_[done]] = ~alone[open_[done]] & (width == 2)
                go = ~done & (begin[rows, at + 1] != border[open_])  # a join over the border ends it: not two tokens
                parts, begin, open_, at, joined = parts[go], begin[go], open_[go], at[go], ranks[rows, at][go]
                rows = rows[: len(open_)]
                parts[rows, at] = joined
                keep = np.ones(parts.shape, dtype=bool)
                keep[rows, at + 1] = False
                parts, begin = parts[keep].reshape(-1, width - 1), begin[keep].reshape(-1, width - 1)
            whole[open_] = alone[open_]
            out[part] = whole
        return out

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the joined token, or NEVER."""
        key = left * self.n + right
        spot = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
        return np.where(self.joins[spot] == key, self.rank[spot], NEVER)


NEVER = np.int64(1 << 40)


@lru_cache(maxsize=2)
def tables(path: str) -> tuple[Automaton, PairTable]:
    return Automaton(vocabulary(path)), PairTable(vocabulary(path))


def last_tokens(pieces: list[bytes], automaton: Automaton, unmerged: PairTable) -> np.ndarray:
    """The last token of each prefix: [prefix length, piece], for pieces in falling order of length."""
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    longest, n = int(sizes[0]), len(pieces)
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int32)
    first = np.cumsum(sizes) - sizes
    last, state = np.full((longest + 1, n), -1, dtype=np.int32), np.zeros(n, dtype=np.int32)
    for end in range(1, longest + 1):
        n = int(np.searchsorted(-sizes, -end, side="right"))
        state = automaton.step[(state[:n] << 8) + data[first[:n] + end - 1]]
        token, open_ = automaton.longest[state], np.arange(n)
        while len(open_):
            if token.min() < 0:
                raise ValueError("the vocabulary lacks single bytes")
            fits = unmerged(last[end - automaton.length[token], open_], token)
            last[end, open_[fits]] = token[fits]
            open_, token = open_[~fits], automaton.shorter[token[~fits]]
    return last


def encode_pieces(path: str, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after the other, and where each piece's end."""
    automaton, unmerged = tables(path)
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    order = np.argsort(-sizes, kind="stable")
    order = order[: int((sizes > 0).sum())]
    counts, found = np.zeros(len(pieces), dtype=np.int64), []
    at = 0
    while at < len(order):
        if sizes[order[at]] > LONG_PIECE:  # one by one, as steps over few pieces are not worth their arrays
            k = int(order[at])
            ids = PrefixEncoder(vocabulary(path), pieces[k]).ids()
            counts[k] = len(ids)
            found.append((np.full(len(ids), k), np.arange(len(ids)), np.array(ids, dtype=np.int64)))
            at += 1
            continue
        own = order[at : at + max(1, TABLE_CELLS // (int(sizes[order[at]]) + 1))]
        at += len(own)
        last = last_tokens([pieces[k] for k in own.tolist()], automaton, unmerged)
        left, open_, turn = sizes[own].copy(), np.arange(len(own)), 0
        while len(open_):
            token = last[left[open_], open_]
            found.append((own[open_], np.full(len(open_), -1 - turn), token.astype(np.int64)))
            counts[own[open_]] += 1
            left[open_] -= automaton.length[token]
            open_, turn = open_[left[open_] > 0], turn + 1
    ends = np.cumsum(counts)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, dtype="<u4")
    for piece, place, token in found:
        ids[np.where(place < 0, ends[piece] + place, ends[piece] - counts[piece] + place)] = token
    return ids, ends


_INNER = re.compile(r" (?=\s|$)")
_CUT = re.compile(r" (?=\S)")


def cut(text: str) -> list[str]:
    """Text cut at each space before a non-space, which starts a new match of the pattern whatever stands around it."""
    return _CUT.split(text) if _INNER.search(text) else text.split(" ")


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()


class CachedEncoder:
    """Encodes batches of texts cut by cut(), keeping the ids of frequent pieces; `encode` maps strings to packed ids."""

    def __init__(self, encode: Callable[[list[str], list[str]], tuple[list[bytes], list[bytes]]]):
        self.encode, self.spaced = encode, {}

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.spaced) > CACHE_PIECES:
            self.spaced = {}
        cuts = [cut(t) for t in texts]
        known, fresh = self.spaced, set()
        for parts in cuts:
            fresh.update(p for p in parts[1:] if p not in known)
        heads = list(dict.fromkeys(parts[0] for parts in cuts))
        missing = list(fresh)
        made, of_heads = self.encode([" " + p for p in missing], heads)
        head = dict(zip(heads, of_heads, strict=True))
        rare = {}
        for p, ids in zip(missing, made, strict=True):
            (known if len(p) <= CACHE_CHARS else rare)[p] = ids
        if rare:
            return [head[c[0]] + b"".join(known[p] if p in known else rare[p] for p in c[1:]) for c in cuts]
        return [head[c[0]] + b"".join(map(known.__getitem__, c[1:])) for c in cuts]


def text_batches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in bounded runs; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    sizes = np.asarray(pa.compute.binary_length(column))
    for i, j in row_ranges(np.concatenate([[0], np.cumsum(sizes)])):
        yield i, column.slice(i, j - i).to_pylist()


@lru_cache(maxsize=4)
def prefix_encoder(path: str, pattern: str) -> CachedEncoder:
    """A CachedEncoder by prefix dynamic programming, for this worker."""
    import regex

    matches = regex.compile(pattern).findall

    def packed(texts: list[str]) -> list[bytes]:
        found = [[t] if t.isalpha() or t[:1] == " " and t[1:].isalpha() else matches(t) for t in texts]
        ids, ends = encode_pieces(path, [m.encode() for own in found for m in own])
        stops = np.concatenate([[0], ends])[np.cumsum([len(own) for own in found], dtype=np.int64)] * 4
        data, at, out = ids.tobytes(), 0, []
        for stop in stops.tolist():
            out.append(data[at:stop])
            at = stop
        return out

    def encode(pieces: list[str], heads: list[str]) -> tuple[list[bytes], list[bytes]]:
        return packed(pieces), packed(heads)

    return CachedEncoder(encode)


def decode(vocab: Vocabulary, ids: bytes) -> bytes:
    return b"".join(map(vocab.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, ids (little-endian unsigned 32-bit) and the decoded bytes."""
    source = docs.select(key, "text")
    schema = f"{key} {source.schema[0].dataType.simpleString()}, ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocab = prefix_encoder(path, pattern), vocabulary(path)
        for batch in batches:
            for i, texts in text_batches(batch.column(1)):
                ids = encoder.batch(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array(ids, pa.binary()), pa.array([decode(vocab, x) for x in ids], pa.binary())], names=[key, "ids", "decoded"])

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """encode_documents reduced to counts and digests inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocab = prefix_encoder(path, pattern), vocabulary(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for i, texts in text_batches(batch.column(1)):
                ids = encoder.batch(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(decode(vocab, x)) for x in ids])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    import public_tokenizers as public

    return digests(documents(spark, sf_dir), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
