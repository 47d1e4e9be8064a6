"""Full-text postings in shards, each term's list cut into blocks with their greatest contribution.

A shard holds up to SHARD chunks of one task's input, those with most terms
first, so building moves no text.  Its rows are one list per term: which chunks
have it and where (1 in the body, 2 in the title, 3 in both), and for each block
of BLOCK chunks that has the term the greatest such number.  One more row, with
an empty term, names the chunks.  Chunks without a key are left out.

A question's score in a chunk is bounded by the greatest numbers of the chunk's
block, so blocks are opened from the best bound on and no further than to the
k-th score found: a block below it can hold no better chunk.  A shard gives at
most k rows a question, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioforge.functions.text import MOST_COUNTED, unique_terms

SHARD, BLOCK = 4096, 8
FIRST_OPENED = 16  # blocks; as many again with every further look
PUSHED_TERMS = 1000
BODY, TITLE = 1, 2
BODY_SHARE, TITLE_SHARE = 0.8, 0.2


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values and the row of each."""
    return column.flatten(), np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))


def _shard(number: int, rows: pa.Table, kind: pa.DataType) -> pa.RecordBatch:
    """The rows of one shard, from (key, body, title) lists of terms."""
    sizes = pc.list_value_length(rows.column("body")).fill_null(0).to_numpy()
    rows = rows.take(pa.array(np.argsort(-sizes, kind="stable")))
    parts = [_lists(rows.column(c).combine_chunks()) for c in ("body", "title")]
    coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    sorted_terms, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    at = rank[coded.indices.to_numpy()] * SHARD + np.concatenate([p[1] for p in parts])
    place, inverse = np.unique(at, return_inverse=True)
    code = np.bincount(inverse, weights=np.repeat([BODY, TITLE], [len(p[1]) for p in parts]), minlength=len(place)).astype(np.int8)
    term, doc = place // SHARD, place % SHARD
    begins = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, dtype=np.int64)
    cut = np.append(begins, len(term))
    # greatest number of each block: body and title apart, as they may come from different chunks
    block = term * (SHARD // BLOCK) + doc // BLOCK
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, dtype=np.int64)
    most = np.bitwise_or.reduceat(code, first) if len(first) else code
    block_cut = np.searchsorted(first, cut)
    listed = lambda values, ends, of: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, of))
    n = len(begins)
    names = pa.array([rows.column("key").to_pylist()], pa.list_(kind))
    columns = [
        pa.array([number] * (n + 1), pa.int64()), pa.concat_arrays([pa.array([""]), sorted_terms.take(pa.array(term[begins])).cast(pa.string())]),
        *(pa.concat_arrays([pa.array([[]], pa.list_(of)), listed(values, ends, of)]) for values, ends, of in (
            (doc.astype(np.int32), cut, pa.int32()), (code, cut, pa.int8()), ((doc // BLOCK)[first].astype(np.int32), block_cut, pa.int32()), (most, block_cut, pa.int8()))),
        pa.concat_arrays([names, pa.nulls(n, pa.list_(kind))]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "docs", "codes", "blocks", "most", "names"])


def index_rows(chunks: DataFrame, key: str, text: str, title: str | None = None, shard: int = SHARD) -> DataFrame:
    """The postings of chunks (key, text, title)."""
    kind = to_arrow_type(chunks.schema[key].dataType)
    named = unique_terms(F.coalesce(F.col(title), F.lit(""))) if title else F.array().cast("array<string>")
    listed = chunks.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), unique_terms(F.coalesce(F.col(text), F.lit(""))).alias("body"), named.alias("title"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            while batch.num_rows:
                room = shard - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == shard:
                    yield _shard(number, pa.Table.from_batches(held), kind)
                    number, held = number + 1, []
        if held:
            yield _shard(number, pa.Table.from_batches(held), kind)

    key_kind = dict(chunks.dtypes)[key]
    return listed.mapInArrow(run, f"shard long, term string, docs array<int>, codes array<tinyint>, blocks array<int>, most array<tinyint>, names array<{key_kind}>")


def _score(code_sums: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    share = [np.minimum(x, MOST_COUNTED) / min(n, MOST_COUNTED) for x in code_sums]
    return np.minimum(1.0, share[0] * BODY_SHARE + share[1] * TITLE_SHARE)


def best_in_shard(lists: dict[str, tuple[np.ndarray, ...]], n_docs: int, terms: list[str], k: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best chunks of a shard (ties to the smaller name), and how many chunks were scored."""
    own, n = [lists[t] for t in terms if t in lists], len(terms)
    if not own:
        return np.zeros(0, dtype=np.int64), np.zeros(0), 0
    docs, codes, blocks, most = (np.concatenate([x[c] for x in own]) for c in range(4))
    n_blocks, flags = -(-n_docs // BLOCK), (BODY, TITLE)
    bound = _score(tuple(np.bincount(blocks, weights=(most & f) > 0, minlength=n_blocks) for f in flags), n)
    order = np.argsort(-bound, kind="stable")
    order = order[: int((bound > 0).sum())]
    scores, seen, opened, step, floor = np.zeros(n_docs), 0, 0, FIRST_OPENED, 0.0
    at = docs // BLOCK
    while seen < len(order) and bound[order[seen]] >= floor:
        now = np.zeros(n_blocks, dtype=bool)
        now[order[seen : seen + step]] = True
        take = now[at]
        part = _score(tuple(np.bincount(docs[take], weights=(codes[take] & f) > 0, minlength=n_docs) for f in flags), n)
        of = np.flatnonzero(np.repeat(now, BLOCK)[:n_docs])
        scores[of] = part[of]
        seen, opened, step = seen + step, opened + len(of), 2 * step
        floor = np.partition(scores, -k)[-k] if n_docs >= k else 0.0
    found = np.flatnonzero(scores > 0)
    top = found[np.lexsort((names[found], -scores[found]))][:k]
    return top, scores[top], opened


def ranked_rows(index: DataFrame, asked: dict, k: int, question: str, question_kind: str, key: str, counted: bool = False) -> DataFrame:
    """question, key, text_score: the k best of each shard; asked has the terms of each question.  `counted`: instead the chunks scored (question, scored)."""
    terms = sorted({t for own in asked.values() for t in own})
    kind = dict(index.dtypes)["names"][6:-1]
    if len(terms) <= PUSHED_TERMS:
        wanted = index.filter(F.col("term").isin("", *terms))
    else:
        wanted = index.join(F.broadcast(index.sparkSession.createDataFrame([("",), *((t,) for t in terms)], "term string")), "term", "left_semi")

    def score(table: pa.Table) -> pa.Table:
        lists, names = {}, None
        for row in table.to_batches():
            columns = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (row.column(n) for n in ("docs", "codes", "blocks", "most"))]
            for i, term in enumerate(row.column("term").to_pylist()):
                if term == "":
                    names = np.asarray(row.column("names")[i].as_py())
                else:
                    lists[term] = tuple(values[ends[i] : ends[i + 1]] for ends, values in columns)
        out = ([], [], [])
        for name, own in asked.items():
            top, scores, opened = best_in_shard(lists, len(names), own, k, names)
            if counted:
                out[0].append(name), out[1].append(opened)
            else:
                out[0].extend([name] * len(top)), out[1].extend(names[top].tolist()), out[2].extend(scores.tolist())
        return pa.table({question: pa.array(out[0], wire[0]), "scored": pa.array(out[1], pa.int64())} if counted else {question: pa.array(out[0], wire[0]), key: pa.array(out[1], wire[1]), "text_score": pa.array(out[2], pa.float64())})

    schema = f"{question} {question_kind}, scored long" if counted else f"{question} {question_kind}, {key} {kind}, text_score double"
    empty = index.sparkSession.createDataFrame([], f"q {question_kind}, k {kind}").schema
    wire = [to_arrow_type(f.dataType) for f in empty]
    return wanted.select("shard", "term", "docs", "codes", "blocks", "most", "names").repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").groupBy("shard").applyInArrow(score, schema)
