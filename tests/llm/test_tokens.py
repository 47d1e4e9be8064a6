import base64
import hashlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import tokens as t

PATH = public.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
SPLIT = tiktoken.Encoding("split", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WHOLE = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=RANKS, special_tokens={})

TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'\x1c\x85 aeionstTHE.,!#0129é語😀ß"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_equals_tiktoken(texts):
    got = t.prefix_encoder(PATH, public.PATTERN).batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [SPLIT.encode_ordinary(x) for x in texts]
    assert [t.decode(t.vocabulary(PATH), x) for x in got] == [x.encode() for x in texts]


@settings(max_examples=100, deadline=None)
@given(TEXT, TEXT, TEXT, st.data())
def test_appends_and_edits_are_exact(a, b, new, data):
    e = t.PrefixEncoder(t.vocabulary(PATH), a.encode())
    e.append(b.encode())
    assert e.ids() == WHOLE.encode_ordinary(a + b)
    assert e.ids(len(a.encode())) == WHOLE.encode_ordinary(a)
    i = data.draw(st.integers(0, len(a + b)))
    j = data.draw(st.integers(i, len(a + b)))
    byte = lambda k: len((a + b)[:k].encode())
    e.replace(byte(i), byte(j), new.encode())
    assert e.ids() == WHOLE.encode_ordinary((a + b)[:i] + new + (a + b)[j:])


def test_edit_is_local():
    text = ("the quick brown fox jumps over the lazy dog " * 400).encode()
    e = t.PrefixEncoder(t.vocabulary(PATH), text)
    assert e.replace(5000, 5003, b"zebra") < 1000
    assert e.ids() == WHOLE.encode_ordinary((text[:5000] + b"zebra" + text[5003:]).decode())


@pytest.mark.parametrize("text", ["", " ", "  ", "a" * 20_000, "ab " * 20_000, " \n \n x", "x  y", "\n" * 500])
def test_long_and_odd_texts(text):
    assert np.frombuffer(t.prefix_encoder(PATH, public.PATTERN).batch([text])[0], "<u4").tolist() == SPLIT.encode_ordinary(text)


def test_query_rows(spark):
    rows = [(1, "a b", 1), (1, "a b", 2), (None, None, 3), (2, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = t.digests(docs, PATH, public.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (1, 2), (1, 2), (2, 0)]
    assert all((r.ids_sha256 == empty) == (r.n_tokens == 0) for r in got)
    assert t.digests(docs.limit(0), PATH, public.PATTERN).count() == 0
    whole = t.encode_documents(docs, PATH, public.PATTERN).filter("doc_id = 1").first()
    assert bytes(whole.decoded) == b"a b" and len(whole.ids) == 8


def test_query_equals_tiktoken_on_all_documents(spark):
    got = {r.doc_id: r for r in t.op8_bpe(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        text, r = row.text or "", got[row.doc_id]
        ids = np.asarray(SPLIT.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_pair_table_equals_plain_merging():
    vocab, (_, unmerged) = t.vocabulary(PATH), t.tables(PATH)
    right = np.arange(0, 50_000, 7)
    left = (right * 7919) % 50_001 - 1
    assert unmerged(left, right).tolist() == [vocab.pair(int(a), int(b)) for a, b in zip(left, right, strict=True)]
