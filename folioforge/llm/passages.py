"""Fuzzy repeated passages by collinear chaining (operator 7).

Seeds are `K`-word windows: those whose hash is among the least `SHARE`th, whatever
stands around them, and the least of each run of `WINDOW` windows, so that any
`K + WINDOW - 1` equal words in two texts share one.  Spark finds each seed's owner,
its first place in the text of least id, and joins every other place of the seed to
it, so a seed with n places gives n - 1 matches, however many share it.  Per text and
owner, matches on one diagonal merge into anchors; anchors in order in both texts are
chained, with a cost per word of gap, through a Fenwick tree of prefix maxima.  The
words around each chain are fetched from both texts, the chain's ends are extended
over edits, its gaps aligned, and passages kept that have at least `MIN_WORDS` words
and `SIMILARITY` of them aligned.

A passage's seeds may belong to several owners that each hold a part of it only.
Where the chains of a text add up to MIN_WORDS words or more without being such a
passage, a second pass takes all windows of MIN_WORDS words there, and in what the
chains matched: the owner of such a window holds all of it, so no exact repeat is
lost, however its parts are owned (where a text repeats itself within so many words,
the first window stands for the overlapping ones).

Repeated seeds of one text also count their turn, so repetitive texts align with
their copies.

Defined results: null text is an empty text; a null id comes after all others and is
null again in results, its texts told apart by their hash; rows of one id and equal
texts are one text and aren't compared with themselves; rows of one id and different
texts are told apart by a hash of the text; texts of any length are read whole; an
empty table gives no rows; extra columns are kept by `drop_passages` whatever their
names.  Ids are below 2^61.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.shared import documents, drop_tables, write_table
from folioforge.llm.textops import Words, mix64, windows, word_chunks

K = 5
SHARE = 4
WINDOW = 12
MIN_WORDS = 50
SIMILARITY = 0.8
GAP_COST = 0.1
MAX_GAP = 50  # words; a chain is cut at longer gaps
MARGIN = K + WINDOW
REACH = MIN_WORDS  # words fetched around a chain, for other parts of its passage may have other owners
LEAST_CHAIN = 8
EDIT_COSTS = (2, 3, 4)  # in equal words: an end is extended over edits as long as that pays
DROP = 16  # equal words that an extension may fall behind its best
SKIP = 5  # words left out at once on either side
NO_ID = 1 << 61


def sampled(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows, and the places (word numbers) of those that are seeds."""
    hashes = windows(words.hashes(), K)
    owner, last = words.owner(), K + WINDOW - 2
    low = np.flatnonzero((hashes < np.uint64((1 << 64) // SHARE)) & (owner[: len(hashes)] == owner[len(words) - len(hashes) :]))
    if len(words) <= last:
        return hashes, low
    starts = np.flatnonzero(owner[: len(words) - last] == owner[last:])
    runs = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    least = [starts[i : i + 65536] + runs[starts[i : i + 65536]].argmin(axis=1) for i in range(0, len(starts), 65536)]
    return hashes, np.unique(np.concatenate([low, *least]))


def seeds(docs: DataFrame) -> DataFrame:
    """seed, turn (id * 2, plus 1 for a seed that the text had before), place (word << 31 | tag) of docs (id, tag, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, words in word_chunks(batch.column(2), lower=True):
                hashes, at = sampled(words)
                if not len(at):
                    continue
                seed = hashes[at]
                text = words.owner()[at]
                order = np.lexsort((at, seed, text))
                s, t = seed[order], text[order]
                head = np.concatenate([[True], (s[1:] != s[:-1]) | (t[1:] != t[:-1])])
                turn = np.arange(len(s)) - np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
                place = (at[order] - words.first[t]) << 31 | tags[i:j][t]
                again = turn > 0
                seed = np.concatenate([s, mix64(s[again] + turn[again].astype(np.uint64))])
                later = np.concatenate([again, np.zeros(again.sum(), dtype=bool)])
                turns = np.concatenate([ids[i:j][t], ids[i:j][t][again]]) * 2 + later
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(turns), pa.array(np.concatenate([place, place[again]]))], names=["seed", "turn", "place"])

    return docs.select("id", "tag", "text").mapInArrow(run, "seed long, turn long, place long")


def seed_matches(found: DataFrame) -> DataFrame:
    """id, tag, at and own_id, own_tag, own_at: each place of a seed with its owner's, in other texts only."""
    # the least (turn, place): different texts of one id keep the same owner in every run
    owners = found.groupBy("seed").agg(F.count("*").alias("n"), F.min(F.struct("turn", "place")).alias("own")).filter("n > 1").select("seed", F.col("own.turn").alias("own_turn"), F.col("own.place").alias("own_place"))
    owners, _ = write_table(owners, "owners")  # apart from the sums, so that the join may split a frequent seed's partition
    joined = found.join(owners.hint("shuffle_hash"), "seed")
    tag = lambda c: F.col(c).bitwiseAND(F.lit((1 << 31) - 1))
    at = lambda c: F.shiftright(c, 31).cast("int")
    split = joined.select(
        F.shiftright("turn", 1).alias("id"), tag("place").alias("tag"), at("place").alias("at"),
        F.shiftright("own_turn", 1).alias("own_id"), tag("own_place").alias("own_tag"), at("own_place").alias("own_at"),
    )
    return split.filter("id != own_id OR tag != own_tag")


def anchors(at: np.ndarray, own: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of matches on one diagonal of one pair: (pair, start, own start, words)."""
    order = np.lexsort((at, at - own, pair))
    at, own, pair = at[order], own[order], pair[order]
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (at[1:] - own[1:] != at[:-1] - own[:-1]) | (at[1:] - at[:-1] > MARGIN)])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    return pair[heads], at[heads], own[heads], at[tails] - at[heads] + K


class Fenwick:
    """Prefix maxima with the place of the maximum."""

    def __init__(self, n: int):
        self.best, self.who = [-1e18] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i], self.who[i] = value, who
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """The maximum over places below i."""
        value, who = -1e18, -1
        while i > 0:
            if self.best[i] > value:
                value, who = self.best[i], self.who[i]
            i -= i & -i
        return value, who


def chains(start: np.ndarray, own: np.ndarray, size: np.ndarray) -> list[list[int]]:
    """Anchors (one pair's) as chains in order in both texts, best first, cut at long gaps."""
    n = len(start)
    if n == 1:
        return [[0]]
    order = np.lexsort((own, start))
    s, o, m = start[order].tolist(), own[order].tolist(), size[order].tolist()
    # an anchor counts as passed from its last seed on, for edits may leave neighbours overlapping
    s_last, o_last = [a + b - K + 1 for a, b in zip(s, m, strict=True)], [a + b - K + 1 for a, b in zip(o, m, strict=True)]
    ranks = np.sort(np.unique(o_last))
    put_at, ask = np.searchsorted(ranks, o_last).tolist(), np.searchsorted(ranks, o, side="right").tolist()
    tree, score, before = Fenwick(len(ranks)), [0.0] * n, [-1] * n
    passed = np.argsort(s_last, kind="stable").tolist()
    p = 0
    for i in range(n):
        while p < n and s_last[passed[p]] <= s[i]:
            j = passed[p]
            tree.put(put_at[j], score[j] + GAP_COST * (s_last[j] + o_last[j] + 2 * K), j)
            p += 1
        value, who = tree.upto(ask[i])
        gain = value - GAP_COST * (s[i] + o[i])
        score[i] = m[i] + max(0.0, min(gain, score[who] if who >= 0 else 0.0))
        if gain > 0:
            before[i] = who
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        path.reverse()
        part: list[int] = []
        for i in path:
            if part and (s[i] - s[part[-1]] - m[part[-1]] > MAX_GAP or o[i] - o[part[-1]] - m[part[-1]] > MAX_GAP):
                out.append(part)
                part = []
            part.append(i)
        if part:
            out.append(part)
    return [[int(order[i]) for i in c] for c in out]


def chained(matches: DataFrame) -> DataFrame:
    """One row per chain: both texts, the chain's ends in both, and its anchors (start, own start, words; 32-bit)."""
    names = ["id", "tag", "own_id", "own_tag"]

    def of_texts(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = np.zeros(len(rows["id"]), dtype=bool)
        new[:1] = True
        for n in names:
            new[1:] |= rows[n][1:] != rows[n][:-1]
        heads = np.flatnonzero(new)
        pair, start, own, size = anchors(rows["at"].astype(np.int64), rows["own_at"].astype(np.int64), np.cumsum(new) - 1)
        begins = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        out = []
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(pair)], strict=True):
            if size[a:b].sum() < LEAST_CHAIN:
                continue
            for c in chains(start[a:b], own[a:b], size[a:b]):
                i = [a + x for x in c]
                first, last = i[0], i[-1]
                if start[last] + size[last] - start[first] >= LEAST_CHAIN:
                    out.append((heads[pair[a]], start[first], start[last] + size[last], own[first], own[last] + size[last], np.stack([start[i], own[i], size[i]], axis=1).astype("<i4").tobytes()))
        at = np.array([o[0] for o in out], dtype=np.int64)
        columns = [pa.array(rows[n][at]) for n in names] + [pa.array([int(o[k]) for o in out], pa.int32()) for k in range(1, 5)] + [pa.array([o[5] for o in out], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "start", "end", "own_start", "own_end", "anchors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        join = lambda: {n: np.concatenate([h[n] for h in held]) for n in held[0]}
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({n: batch.column(n).to_numpy() for n in batch.schema.names})
            if any(held[0][n][0] != held[-1][n][-1] for n in ("id", "tag")):  # whole texts are done: all but the last
                rows = join()
                cut = len(rows["id"]) - int(np.count_nonzero((rows["id"] == rows["id"][-1]) & (rows["tag"] == rows["tag"][-1])))
                yield of_texts({n: x[:cut] for n, x in rows.items()})
                held = [{n: x[cut:] for n, x in rows.items()}]
        if held:
            yield of_texts(join())

    ordered = matches.repartition("id", "tag").sortWithinPartitions(*names, "at")
    return ordered.mapInArrow(run, "id long, tag long, own_id long, own_tag long, start int, end int, own_start int, own_end int, anchors binary")


def slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, tag, start, end, begin, words: hashes (32-bit) of words begin.. of each asked range and REACH words around it."""
    asked = wanted.distinct().groupBy("id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column("text"), lower=True):
                hashes = (words.hashes() >> np.uint64(32)).astype("<u4")
                rows, out = [], []
                for row, ranges in enumerate(batch.column("ranges").slice(i, j - i).to_pylist()):
                    own = hashes[words.first[row] : words.first[row + 1]]
                    for r in ranges:
                        begin = max(0, r["start"] - REACH)
                        rows.append(i + row)
                        out.append((r["start"], r["end"], begin, own[begin : r["end"] + REACH].tobytes()))
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("tag").take(take), *(pa.array([o[k] for o in out], pa.int32()) for k in range(3)), pa.array([o[3] for o in out], pa.binary())],
                    names=["id", "tag", "start", "end", "begin", "words"],
                )

    joined = docs.join(asked.hint("shuffle_hash"), ["id", "tag"]).select("id", "tag", "text", "ranges")
    return joined.mapInArrow(run, "id long, tag long, start int, end int, begin int, words binary")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a.tolist():
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return int(row[-1])


#: Words to leave out on either side to meet two equal ones again, shortest first.
_SKIPS = sorted(((i, j) for i in range(SKIP + 1) for j in range(SKIP + 1) if i or j), key=lambda s: (max(s), sum(s)))


def extend(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """How far both run on alike from their beginnings, over edits too, and the equal words; for each of EDIT_COSTS."""
    x = y = matched = edits = 0
    best, top = [(0, 0, 0)] * len(EDIT_COSTS), [0] * len(EDIT_COSTS)
    while True:
        run = 0
        for p, q in zip(a[x:], b[y:], strict=False):
            if p != q:
                break
            run += 1
        x, y, matched = x + run, y + run, matched + run
        for k, cost in enumerate(EDIT_COSTS):
            if matched - cost * edits > top[k]:
                best[k], top[k] = (x, y, matched), matched - cost * edits
        for i, j in _SKIPS:
            if a[x + i : x + i + 2] == b[y + j : y + j + 2] and x + i + 2 <= len(a) and y + j + 2 <= len(b):
                break
        else:
            return best
        kept = sum(p == q for p, q in zip(a[x : x + i], b[y : y + j], strict=True)) if i == j else common(np.array(a[x : x + i]), np.array(b[y : y + j])) if i and j else 0
        x, y, matched, edits = x + i, y + j, matched + kept, edits + max(i, j) - kept
        if matched - EDIT_COSTS[0] * edits < top[0] - DROP:
            return best


def best_run(matched: list[int], edits: list[int], cost: int) -> tuple[int, int]:
    """The anchors (first, last) of a chain whose words, less cost times the edits in gaps, are most; gap k is before anchor k."""
    best, top, score, first = (0, 0), -1, 0, 0
    for k in range(0, len(matched), 2):  # anchors at even places, gaps between
        through = score + matched[k - 1] - cost * edits[k - 1] if k else -1
        score, first = (through, first) if through > 0 else (0, k)
        score += matched[k]
        if score > top:
            best, top = (first, k), score
    return best[0] // 2, best[1] // 2


def align(a: np.ndarray, b: np.ndarray, points: np.ndarray) -> list[tuple[int, int, int, int, int, bool]]:
    """Passages along a chain's anchors (start, own start, words): (start, end, own start, own end, equal words, True); where a part has none, its widest range and False."""
    spans, matched, edits = [], [], []
    x, y = points[0, :2].tolist()
    for p, q, size in points.tolist():
        skip = max(0, x - p, y - q)  # what an earlier anchor holds already
        p, q, size = p + skip, q + skip, size - skip
        if size <= 0:
            continue
        if spans:
            both = common(a[x:p], b[y:q]) if p > x and q > y else 0
            matched.append(both)
            edits.append(max(p - x, q - y) - both)
        spans.append((p, q, size))
        matched.append(size)
        edits.append(0)
        x, y = p + size, q + size
    out, parts, before, after = [], [(0, len(spans) - 1)], {}, {}
    while parts:
        lo, hi = parts.pop()
        widest = None
        for k, cost in enumerate(EDIT_COSTS):
            i, j = (lo + e for e in best_run(matched[2 * lo : 2 * hi + 1], edits[2 * lo : 2 * hi + 1], cost))
            (p, q, _), (u, v, size) = spans[i], spans[j]
            if i not in before:
                before[i] = extend(a[:p][::-1].tolist(), b[:q][::-1].tolist())
            if j not in after:
                after[j] = extend(a[u + size :].tolist(), b[v + size :].tolist())
            (c, d, m), (e, f, n) = before[i][k], after[j][k]
            s, t, o, w, got = p - c, u + size + e, q - d, v + size + f, sum(matched[2 * i : 2 * j + 1]) + m + n
            widest = widest or (s, t, o, w, got, False)
            if min(t - s, w - o) >= MIN_WORDS and got >= SIMILARITY * max(t - s, w - o):
                out.append((s, t, o, w, got, True))
                parts += [(x, y) for x, y in ((lo, i - 1), (j + 1, hi)) if x <= y]
                break
        else:
            out.append(widest)
    return out


_CHAIN = ["id", "tag", "chain_start", "chain_end", "own_id", "own_tag", "own_chain_start", "own_chain_end"]


def aligned(docs: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The passages along each chain of matches (good), or else its aligned range; the words around chains; paths of tables."""
    found, found_path = write_table(chained(matches), "chains")
    wanted = found.select("id", "tag", "start", "end").unionByName(found.select(F.col("own_id").alias("id"), F.col("own_tag").alias("tag"), F.col("own_start").alias("start"), F.col("own_end").alias("end")))
    words, words_path = write_table(slices(docs, wanted), "slices")
    own = words.select(*[F.col(c).alias(f"own_{c}") for c in words.columns])
    both = found.join(words, ["id", "tag", "start", "end"]).join(own, ["own_id", "own_tag", "own_start", "own_end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row, (begin, own_begin, points, a, b) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("begin", "own_begin", "anchors", "words", "own_words")), strict=True)):
                points = np.frombuffer(points, dtype="<i4").reshape(-1, 3) - np.array([begin, own_begin, 0])
                for s, e, o, p, matched, good in align(np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4"), points):
                    rows.append(row)
                    out.append((s + begin, e + begin, o + own_begin, p + own_begin, matched, good))
            take = pa.array(rows, pa.int64())
            chain = [batch.column(n).take(take) for n in ("id", "tag", "start", "end", "own_id", "own_tag", "own_start", "own_end")]
            cut = [pa.array([int(x[k]) for x in out], pa.int32()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*chain, *cut, pa.array([bool(x[5]) for x in out])], names=[*_CHAIN, "start", "end", "own_start", "own_end", "matched", "good"])

    kinds = "id long, tag long, chain_start int, chain_end int, own_id long, own_tag long, own_chain_start int, own_chain_end int"
    rows, path = write_table(both.mapInArrow(run, f"{kinds}, start int, end int, own_start int, own_end int, matched int, good boolean"), "aligned")
    return rows, words, [found_path, words_path, path]


def fragments(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Matches, as of seed_matches, of equal runs of MIN_WORDS words where chains add up to so many words and aren't passages themselves."""
    by_start = Window.partitionBy("id", "tag").orderBy("start", "end", *_CHAIN[2:])
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    island = Window.partitionBy("id", "tag", "island")
    marked = rows.withColumn("new", F.coalesce((F.col("start") > reached + 2 * K).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(by_start))
    length = F.max("end").over(island) - F.min("start").over(island)
    longest = F.coalesce(F.max(F.when(F.col("good"), F.col("end") - F.col("start"))).over(island), F.lit(0))
    open_ = marked.withColumn("length", length).withColumn("longest", longest).withColumn("failed", F.max((~F.col("good")).cast("int")).over(island)).filter(f"failed = 1 AND length >= {MIN_WORDS} AND length > longest")
    side = lambda p: open_.select(F.col(f"{p}id").alias("id"), F.col(f"{p}tag").alias("tag"), F.col(f"{p}chain_start").alias("start"), F.col(f"{p}chain_end").alias("end"))
    asked = side("").unionByName(side("own_")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = windows(np.frombuffer(batch.column("words")[row].as_py(), dtype="<u4").astype(np.uint64), MIN_WORDS)
                take = pa.array(np.full(len(found), row))
                at = batch.column("begin")[row].as_py() + np.arange(len(found), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column("id").take(take), batch.column("tag").take(take), pa.array(at.astype(np.int32))], names=["window", "id", "tag", "at"])

    slices_asked = words.join(asked, ["id", "tag", "start", "end"]).select("id", "tag", "begin", "words").distinct()
    before = F.lag("at").over(Window.partitionBy("window", "id", "tag").orderBy("at"))
    places = slices_asked.mapInArrow(run, "window long, id long, tag long, at int").distinct().withColumn("before", before)
    # a text that repeats itself every few words has each window once, and again only beyond its end
    found, _ = write_table(places.filter(f"before IS NULL OR at - before >= {MIN_WORDS}").drop("before"), "windows")
    owners, _ = write_table(found.groupBy("window").agg(F.count("*").alias("n"), F.min(F.struct("id", "tag", "at")).alias("own")).filter("n > 1").select("window", "own"), "owners")
    joined = found.join(owners.hint("shuffle_hash"), "window").filter("id != own.id OR tag != own.tag")
    steps = F.explode(F.array(*[F.lit(i) for i in range(0, MIN_WORDS - K + 1, (MIN_WORDS - K) // 3)]))  # as seeds near enough to chain
    spread = joined.withColumn("step", steps)
    return spread.select("id", "tag", (F.col("at") + F.col("step")).alias("at"), F.col("own.id").alias("own_id"), F.col("own.tag").alias("own_tag"), (F.col("own.at") + F.col("step")).alias("own_at")).distinct()


def passages(docs: DataFrame) -> DataFrame:
    """id, tag, start, end (words), own_id, own_start, own_end, matched: repeats in docs (id, tag, text) of owners' passages."""
    matches, matches_path = write_table(seed_matches(seeds(docs)), "matches")
    rows, words, paths = aligned(docs, matches)
    more, more_path = write_table(fragments(rows, words), "matches")
    drop_tables(docs.sparkSession, matches_path, *paths[:2])
    found = rows
    if not more.isEmpty():
        again, _, used = aligned(docs, more)
        found = rows.unionByName(again)
        drop_tables(docs.sparkSession, *used[:2])
    drop_tables(docs.sparkSession, more_path)
    columns = ["id", "tag", "start", "end", "own_id", "own_start", "own_end", "matched"]
    return found.filter("good").select(*columns).distinct()


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs' columns with id and tag."""
    return docs.select(_id().alias("id"), _tag().alias("tag"), F.coalesce("text", F.lit("")).alias("text"), *columns)


def _tag() -> Column:
    return F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1))


def _id() -> Column:
    """doc_id; rows without one are spread over NO_ID and above by their text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.xxhash64("text", F.lit(1)).bitwiseAND(F.lit((1 << 60) - 1)))


def drop_passages(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage cut out of text, the owner's left; rows left without words go."""
    found, _ = write_table(passages(keyed(docs)).groupBy("id", "tag").agg(F.collect_set(F.struct("start", "end")).alias("ranges")), "passages")
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # Arrow tasks look names with dots up as fields
    at = {n: f"c{k}" for k, n in enumerate(names)}
    whole = plain.withColumn("doc_id", F.col(at["doc_id"])).withColumn("text", F.col(at["text"])).withColumn("id", _id()).withColumn("tag", _tag())
    joined = whole.join(found.hint("shuffle_hash"), ["id", "tag"], "left").select(*plain.columns, "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column(names.index("text")), lower=False):
                part = batch.slice(i, j - i)
                texts, keep = part.column(names.index("text")).to_pylist(), []
                for row, ranges in enumerate(part.column(len(names)).to_pylist()):
                    first, end = words.first[row], words.first[row + 1]
                    if ranges:
                        gone = np.zeros(end - first, dtype=bool)
                        for r in ranges:
                            gone[r["start"] : r["end"]] = True
                        base, data = words.offsets[row], texts[row].encode()
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                        out, done = [], 0
                        for a, b in edges.reshape(-1, 2).tolist():
                            out.append(data[done : words.starts[first + a] - base])
                            done = words.starts[first + b] - base if first + b < end else len(data)
                        texts[row] = (b"".join(out) + data[done:]).decode()
                        end -= gone.sum()
                    if end > first or not ranges:
                        keep.append(row)
                columns = list(part.columns[: len(names)])
                columns[names.index("text")] = pa.array(texts, part.column(names.index("text")).type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    n = [len(t) if r else old for t, r, old in zip(texts, part.column(len(names)).to_pylist(), columns[k].to_pylist(), strict=True)]
                    columns[k] = pa.array(n, columns[k].type)
                yield pa.RecordBatch.from_arrays(columns, names=list(at.values())).take(pa.array(keep, pa.int64()))

    return joined.mapInArrow(run, plain.schema).toDF(*names)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that repeat one of an earlier document."""
    found = passages(keyed(documents(spark, sf_dir)))
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return found.select(
        known("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), known("own_id").alias("of_doc_id"), F.col("own_start").alias("of_start_word"), F.col("own_end").alias("of_end_word"),
        (F.col("matched") / F.greatest(F.col("end") - F.col("start"), F.col("own_end") - F.col("own_start"))).alias("similarity"),
    )
