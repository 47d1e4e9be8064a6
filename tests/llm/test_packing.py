import zlib

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioforge.llm import packing as p

PATH = public.path("byte_bpe_50k.json")
RANKS = public.path("byte_bpe_50k.tiktoken")
TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'\x1c\x85 aeionstTHE.,!#0129é語😀ß"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_ids_are_those_of_the_tokenizers_file(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    got = p.rank_encoder(RANKS, public.PATTERN).batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_fit_fills_bins_without_gaps(sizes):
    sizes = np.asarray(sizes, dtype=np.int64)
    bins, offsets = p.best_fit(sizes, 20)
    for b in set(bins.tolist()):
        inside = sorted(zip(offsets[bins == b], sizes[bins == b], strict=True))
        at = 0
        for o, s in inside:
            assert o == at
            at += s
        assert at <= 20
    if len(sizes):
        assert len(set(bins.tolist())) <= 11 / 9 * -(-sizes.sum() // 20) * 1.5 + 1


def test_piece_lengths():
    assert p.piece_lengths(5, 4) == [1, 4] and p.piece_lengths(8, 4) == [4, 4] and p.piece_lengths(1, 4) == [1]


def checked(rows, texts):
    """Asserts that rows hold every id of texts in place; returns the number of sequences and the least possible."""
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    ids = [np.asarray([*e.ids, 0], dtype="<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    for r in rows:
        own = ids[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes()) and r.length <= p.CAPACITY
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= p.CAPACITY
    return len(by), -(-sum(map(len, ids)) // p.CAPACITY)


def test_pack_documents(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [None, "", "x", "word " * 9000, "same", "same"] + [" ".join(f"w{v}" for v in rng.integers(0, 500, rng.integers(1, 900))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, bin string").repartition(7)
    monkeypatch.setattr(p, "LOCAL_PIECES", 40)
    monkeypatch.setattr(p, "NODE_BINS", 10)
    n, least = checked(p.pack_documents(docs, RANKS, public.PATTERN).collect(), texts)
    assert n <= least * 1.1 + 1
    assert p.pack_documents(docs.limit(0), RANKS, public.PATTERN).count() == 0


def test_large_items_end_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(p, "NODE_BINS", 10)
    bins = spark.range(100).select(p.F.col("id").alias("bin"), p.F.lit(1100).cast("long").alias("used"))
    assert p.merged_bins(bins).filter("bin != new_bin").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    n, least = checked(p.op4_best_fit_packing(spark, f"/root/testdata/{sf}").collect(), [texts[i] for i in range(len(texts))])
    assert n <= least * 1.02 + 1


LITERALS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext| >", " <|endoftext|>it's\n", "plain", ""]


def test_added_tokens_are_those_of_the_tokenizers_file_as_it_is():
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(LITERALS, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in p.token_ids(LITERALS, RANKS, public.PATTERN)] == want and want[0] == [64, 220, 50256, 275]


def test_pieces_hold_added_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(LITERALS)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(PATH)
    for r in p.tokenized_pieces(docs, RANKS, public.PATTERN).collect():
        ids = np.asarray([*tokenizer.encode(LITERALS[r.doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())
