"""Language identification by segmentation-marginalised unigrams (operator 6).

Each language has probabilities over the pieces of a fixed public vocabulary.  A
word's likelihood sums over all its segmentations into pieces by the forward
algorithm; a text's is the product over its words.  The probabilities come from
expectation maximisation on the training words' counts per language: Spark
counts the words, tasks compute expected piece counts by forward-backward, and
only the sums per (language, piece), bounded by languages x vocabulary, reach
the driver.

Characters outside the vocabulary cost a fixed probability.  The languages
learnt are the non-null values of lang in the training rows.  Words of any length
are summed over whole: words of one length are one array; those over `LONG_WORD`
characters share arrays with others somewhat longer, and over `LOG_WORD` the sums
are kept as logarithms, as they would vanish otherwise.

Defined results: null text or one without a letter gives `und` with score 0, as
does a corpus that teaches no language; a null id is not held out; repeated rows
are scored one by one and counted twice when learning; ties go to the language
first in order; texts of any length are scored whole; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.shared import documents, write_table
from folioforge.llm.textops import mix64, word_chunks

ROUNDS = 2
SMOOTH = 0.1
UNKNOWN = 1e-7
LONG_WORD = 24
LOG_WORD = 40
CACHE_SCORES = 2_000_000  # words x languages
TRAIN_WORDS = 100_000  # handled at once
CELLS = 8_000_000  # words x characters x languages or pieces in arrays at once


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """Piece -> id of a sentencepiece vocabulary, those made of text only."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


def _hashed(points: np.ndarray) -> np.ndarray:
    """Prefix hashes (W, n + 1) of rows of code points."""
    sums = np.zeros((points.shape[0], points.shape[1] + 1), dtype=np.uint64)
    for j in range(points.shape[1]):
        sums[:, j + 1] = sums[:, j] * _STEP + points[:, j] + np.uint64(1)
    return sums


_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def piece_table(path: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sorted hashes of all pieces, their ids, the number of ids and the longest piece; id n: an unknown character, n + 1: no piece."""
    own = pieces(path)
    hashes = np.array([_hashed(_points([p]))[0, -1] for p in own], dtype=np.uint64) if own else np.zeros(0, dtype=np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.fromiter(own.values(), dtype=np.int64, count=len(own))[order], max(own.values(), default=0) + 1, max(map(len, own), default=1)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


class Lattice:
    """For words of one (padded) length: [start][characters - 1] -> the piece of each word there."""

    def __init__(self, words: list[str], table: tuple[np.ndarray, np.ndarray, int, int]):
        self.keys, self.ids, self.n, self.longest = table
        self.sums, self.length = _hashed(_points(words)), len(words[0])
        self.steps = np.multiply.accumulate(np.array([1] + [int(_STEP)] * self.longest, dtype=np.uint64))

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, i: int) -> list[np.ndarray]:
        out = []
        for size in range(1, min(self.longest, self.length - i) + 1):
            h = self.sums[:, i + size] - self.sums[:, i] * self.steps[size]
            spot = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
            found = self.keys[spot] == h if len(self.keys) else np.zeros(len(h), dtype=bool)
            out.append(np.where(found, self.ids[spot] if len(self.keys) else 0, self.n if size == 1 else self.n + 1))
        return out


def forward(edges, weight, log: bool = False) -> list[np.ndarray]:
    """Likelihood of each prefix of each word; weight maps pieces to probabilities, per word or per word and language; all as logarithms if log."""
    n = len(edges)
    alpha: list = [0.0] + [-np.inf] * n if log else [1.0] + [0.0] * n
    for i in range(n):
        for size, piece in enumerate(edges[i], 1):
            through, to = weight(piece), alpha[i + size]
            alpha[i + size] = np.logaddexp(to, alpha[i] + through) if log else to + alpha[i] * through
    return alpha


def expected(edges, weight, counts: np.ndarray, lengths: np.ndarray | None = None, log: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and their expected counts in words that occur `counts` times, by forward-backward; lengths: the words' own, where some are padded."""
    alpha, n = forward(edges, weight, log), len(edges)
    lengths = np.full(len(counts), n) if lengths is None else lengths
    zero = -np.inf if log else 0.0
    beta: list = [zero] * (n + 1)
    for end in np.unique(lengths).tolist():
        own = np.log(counts) - alpha[end] if log else counts / np.maximum(alpha[end], 1e-300)
        beta[end] = np.where(lengths == end, own, zero)
    met, often = [], []
    for i in range(n - 1, -1, -1):
        for size, piece in enumerate(edges[i], 1):
            through = weight(piece)
            share = through + beta[i + size] if log else through * beta[i + size]
            beta[i] = np.logaddexp(beta[i], share) if log else beta[i] + share
            met.append(piece)
            often.append(np.exp(alpha[i] + share) if log else alpha[i] * share)
    return np.concatenate(met), np.concatenate(often)


def by_length(words: list[str], languages: int, longest: int) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Places, words and their lengths, in groups of one length; longer words are padded to that of the longest in theirs."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    group = np.where(sizes <= LONG_WORD, sizes, LONG_WORD + np.ceil(np.log(np.maximum(sizes, 1) / LONG_WORD) / np.log(1.25)).astype(np.int64))
    group = np.where(sizes > LOG_WORD, group + 1, group)  # no group on both sides of LOG_WORD
    order = np.lexsort((sizes, group))
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(words) else []:
        width = int(sizes[part[-1]])
        most = max(1, CELLS // (width * max(languages, longest)))
        for at in range(0, len(part), most):
            own = part[at : at + most]
            yield own, [words[k].ljust(width, "\0") for k in own.tolist()], sizes[own]


def log_likelihoods(words: list[bytes], table: tuple[np.ndarray, np.ndarray, int, int], probs: np.ndarray) -> np.ndarray:
    """(words x languages); probs is pieces x languages with rows for an unknown character and for no piece."""
    out, logs = np.zeros((len(words), probs.shape[1])), None
    for places, own, lengths in by_length([marked(w) for w in words], probs.shape[1], table[3]):
        log = lengths[0] > LOG_WORD
        if log and logs is None:
            logs = np.log(np.maximum(probs, 1e-300))
        alpha = forward(Lattice(own, table), (lambda piece: logs[piece]) if log else lambda piece: probs[piece], log)
        for end in np.unique(lengths).tolist():
            at = lengths == end
            out[places[at]] = alpha[end][at] if log else np.log(np.maximum(alpha[end][at], 1e-300))
    return out


def marked(word: bytes) -> str:
    """A word as the vocabulary's string: the word mark, then the characters."""
    return "▁" + word.decode("utf-8", "replace")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, lang, n over the words of docs with a language; words are summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, words in word_chunks(batch.column(0), lower=True):
                if not len(words):
                    continue
                lang = codes[i:j][words.owner()]
                _, at, n = np.unique(mix64(words.hashes() + mix64(lang.astype(np.uint64))), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([words.text(k) for k in at.tolist()], pa.binary()), langs.dictionary.take(pa.array(lang[at])), pa.array(n, pa.int64())], names=["word", "lang", "n"])

    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(run, "word binary, lang string, n long")
    return rows.groupBy("word", "lang").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and piece probabilities (pieces + 2 x languages) from docs' text and lang."""
    spark = docs.sparkSession
    counts, _ = write_table(word_counts(docs), "words")
    found = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # the model has a row of probabilities for each
    langs = sorted(found)
    size = piece_table(path)[2]

    def settled(sums: np.ndarray) -> np.ndarray:
        """Sums per piece and language as probabilities, with the rows for an unknown character and for no piece."""
        return np.concatenate([sums / sums.sum(axis=0), np.full((1, len(langs)), UNKNOWN), np.zeros((1, len(langs)))])

    probs = settled(np.ones((size, len(langs))))
    at = {lang: k for k, lang in enumerate(langs)}

    for _ in range(rounds if langs else 0):
        sent = spark.sparkContext.broadcast(probs)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table, probs = piece_table(path), sent.value.ravel()
            total = np.zeros(len(probs))
            words, owner_lang, n = [], [], []

            def add() -> None:
                own_lang, often_seen = np.array(owner_lang, dtype=np.int64), np.array(n)
                for places, own, lengths in by_length(words, 1, table[3]):
                    k, log = own_lang[places], lengths[0] > LOG_WORD
                    weight = (lambda piece, k=k: np.log(np.maximum(probs[piece * len(langs) + k], 1e-300))) if log else (lambda piece, k=k: probs[piece * len(langs) + k])
                    lattice = Lattice(own, table)
                    met, often = expected(lattice if log else [lattice[i] for i in range(len(lattice))], weight, often_seen[places], lengths, log)
                    total[:] += np.bincount(met * len(langs) + np.tile(k, len(met) // len(k)), weights=often, minlength=len(total))
                for held in (words, owner_lang, n):
                    held.clear()

            for batch in batches:
                for word, lang, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    words.append(marked(word))
                    owner_lang.append(at[lang])
                    n.append(float(count))
                if len(words) >= TRAIN_WORDS:
                    add()
            add()
            sums = total.reshape(-1, len(langs))[:size]
            rows, cols = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols), pa.array(sums[rows, cols])], names=["piece", "k", "n"])

        summed = counts.mapInArrow(run, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        sums = np.full((size, len(langs)), SMOOTH)
        sums[summed["piece"].to_numpy(), summed["k"].to_numpy()] += summed["n"].to_numpy()
        probs = settled(sums)
        sent.unpersist()
    prior = np.log(np.array([found[x] for x in langs], dtype=float)) if langs else np.zeros(0)
    return langs, prior - np.logaddexp.reduce(prior) if langs else prior, probs


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], path: str, key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score (posterior of lang_pred) of each row of docs."""
    langs = model[0]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, prior, probs = sent.value
        table = piece_table(path)
        known_hash, known_score = np.zeros(0, dtype=np.uint64), np.zeros((0, len(langs)))
        for batch in batches:
            keys, column = batch.column(0), batch.column(1).cast(pa.large_string()).fill_null("")
            letter = pa.compute.match_substring_regex(column, r"\p{L}")
            for i, j, words in word_chunks(column, lower=True):
                unique, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
                spot = np.searchsorted(known_hash, unique)
                spot[spot == len(known_hash)] = 0
                have = known_hash[spot] == unique if len(known_hash) else np.zeros(len(unique), dtype=bool)
                scores = np.empty((len(unique), len(langs)))
                scores[have] = known_score[spot[have]]
                scores[~have] = log_likelihoods([words.text(u) for u in first[~have].tolist()], table, probs)
                if not have.all():
                    if len(known_hash) * len(langs) > CACHE_SCORES:
                        known_hash, known_score = unique, scores
                    else:
                        merged = np.concatenate([known_hash, unique[~have]])
                        order = np.argsort(merged)
                        known_hash, known_score = merged[order], np.concatenate([known_score, scores[~have]])[order]
                total = np.stack([np.bincount(words.owner(), weights=scores[back, k], minlength=j - i) for k in range(len(langs))], axis=1) + prior if langs else np.zeros((j - i, 0))
                best = total.argmax(axis=1) if langs else np.zeros(j - i, dtype=int)
                score = np.exp(total[np.arange(j - i), best] - np.logaddexp.reduce(total, axis=1)) if langs else np.zeros(j - i)
                known = np.asarray(letter.slice(i, j - i)) & bool(langs)
                names = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array(names, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], names=[key, "lang_pred", "score"])

    source = docs.select(key, "text")
    return source.mapInArrow(run, f"{key} {source.dtypes[0][1]}, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose remainder isn't 2."""
    import public_tokenizers as public

    docs, path = documents(spark, sf_dir), public.path("piece_bpe_32k.model")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs.filter(~held_out), path)
    return predict(docs, model, path).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
