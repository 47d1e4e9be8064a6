import itertools

import numpy as np
import public_tokenizers as public
import pytest

from folioforge.llm import language_id as lid

PATH = public.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    vocab = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "aba": 5}
    hashes = np.array([lid._hashed(lid._points([p]))[0, -1] for p in vocab], dtype=np.uint64)
    order = np.argsort(hashes)
    table = hashes[order], np.arange(6)[order], 6, 3
    probs = np.concatenate([np.random.default_rng(1).random((7, 2)), np.zeros((1, 2))])
    words = ["▁ababz", "▁zzaba", "▁bbbab"]
    edges = lid.Lattice(words, table)
    last = lid.forward(edges, lambda piece: probs[piece])[-1]
    for k, word in enumerate(words):
        total, n = np.zeros(2), len(word)
        for cuts in itertools.product([0, 1], repeat=n - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[at:i])
                    at = i
            parts.append(word[at:])
            if all(p in vocab or p == "z" for p in parts):
                total += np.prod([probs[vocab.get(p, 6)] for p in parts], axis=0)
        assert np.allclose(last[k], total)
    lengths = np.array([1, 1, 1, 2, 2, 3, 1, 0])
    met, often = lid.expected(edges, lambda piece: probs[piece, 0], np.array([1.0, 2.0, 0.5]))
    assert np.isclose((often * lengths[met]).sum(), 6 * 3.5)  # every character lies in one piece


def plain(word, own, probs, n):
    """The forward sum of a word, one prefix after the other, and expected counts by differences of its logarithm."""
    alpha = [np.longdouble(1)] + [np.longdouble(0)] * len(word)
    for i in range(len(word)):
        for size in range(1, min(16, len(word) - i) + 1):
            piece = own.get(word[i : i + size], n if size == 1 else None)
            if piece is not None:
                alpha[i + size] += alpha[i] * np.longdouble(probs[piece])
    return float(np.log(alpha[-1]))


def test_long_words_are_summed_over_whole():
    own, table = lid.pieces(PATH), lid.piece_table(PATH)
    rng = np.random.default_rng(2)
    probs = np.concatenate([rng.random((table[2], 3)) / 1000, np.full((1, 3), lid.UNKNOWN), np.zeros((1, 3))])
    words = ["donaudampfschifffahrtsgesellschaftskapitaensmuetze", "a", "incomprehensibilities", "understandingthewholethingonly", "漢字" * 20, "x" * 300, "internationalisationsstrategien", "thequickbrownfox" * 5, "unfortunatelyhowevers1234"]
    got = lid.log_likelihoods([w.encode() for w in words], table, probs)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, [plain("▁" + w, own, probs[:, k], table[2]) for k in range(3)], rtol=1e-9)
    for w in words:  # linear and logarithmic sums, padded or not
        lattice, one = lid.Lattice(["▁" + w], table), np.array([2.0])
        wide, length = lid.Lattice([("▁" + w).ljust(len(w) + 9, "\0")], table), np.array([len(w) + 1])
        often = []
        for log, edges in ((False, lattice), (False, wide), (True, lattice), (True, wide)):
            weight = (lambda piece: np.log(np.maximum(probs[piece, 0], 1e-300))) if log else (lambda piece: probs[piece, 0])
            if log or len(w) < 60:
                often.append(np.bincount(*(lambda m, o: (m, o))(*lid.expected(edges, weight, one, length, log)), minlength=table[2] + 2))
        assert all(np.allclose(o, often[0], atol=1e-9) for o in often)


def test_odd_rows(spark):
    rows = [(0, "the cat sat on the mat", "en", 1), (1, "der hund und die katze", "de", 2), (2, None, "en", 3), (3, "12 34 !!", None, 4), (4, "the mat", None, 5), (4, "und die", None, 5), (None, "", None, 6), (7, "x" * 5000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    model = lid.learn(docs, PATH)
    got = [(r.doc_id, r.lang_pred) for r in lid.predict(docs, model, PATH).collect()]
    assert len(got) == 8 and {(0, "en"), (1, "de"), (2, "und"), (3, "und"), (4, "en"), (4, "de"), (None, "und")} <= set(got)
    none = lid.learn(docs.limit(0), PATH)
    assert {r.lang_pred for r in lid.predict(docs, none, PATH).collect()} == {"und"}
    assert lid.predict(docs.limit(0), model, PATH).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, sf):
    got = lid.op6_language_id(spark, f"/root/testdata/{sf}")
    truth = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.filter("held_out").join(truth, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
