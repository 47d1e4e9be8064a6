"""Languages of texts, by their script and by ranked character n-grams learnt from labelled texts.

A text whose letters are for over a third of one of `SOLE` scripts has that
script's language.  Any other has the language whose profile it agrees with most:
a profile holds the `TOP` most frequent trigrams of a language's texts (spaces
count as letters), the first with the weight TOP, the last with 1, and a text has the sum
of the weights of all its trigrams.  Weights are whole numbers, so sums do not depend
on the turn of rows.

A regular expression makes a text a row of letters and single spaces.  Its trigrams
are counted, or looked up, in arrays inside tasks, `PART` letters at a time, and only
sums leave a task: in learning one row for each language and trigram of some `HELD`
distinct ones, in detection one row for each text and language.  Profiles are TOP rows a
language and are sent to all tasks up to `BROADCAST_ROWS` of them; more are joined.

Defined results: null texts, and texts in which no profile's trigram occurs, have no
language (null); ties go to the first language in order; rows of one key are one text;
texts of any length are read whole; without any profile only scripts decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 300
BROADCAST_ROWS = 300_000  # of profiles, each under 60 bytes: 18 MB
PART = 1 << 20  # letters that a task looks at together
HELD = 1 << 20  # distinct trigrams that a task counts before it sends them on
DENSE = 1 << 22  # entries of a table of all trigrams of an alphabet
CODE = 21  # bits of a code point

# Scripts that one language alone is written in, and its code.
SOLE = (("Greek", "el"), ("Hangul", "ko"), ("Hiragana", "ja"), ("Katakana", "ja"), ("Thai", "th"), ("Hebrew", "he"), ("Armenian", "hy"), ("Georgian", "ka"))
_CODES = sorted({code for _, code in SOLE})


def _class(code: str | None = None) -> str:
    return "".join(f"\\p{{Is{script}}}" for script, own in SOLE if code in (None, own))


def script_language(text: Column) -> Column:
    """The language of the sole script that over a third of the letters belong to, or null; the greatest share, then the first code."""
    sole = F.regexp_replace(text, f"[^{_class()}]+", "")
    letters = F.char_length(F.regexp_replace(text, r"\P{L}+", ""))
    share = [F.struct((-F.char_length(F.regexp_replace(sole, f"[^{_class(c)}]+", ""))).alias("less"), F.lit(c).alias("code")) for c in _CODES]
    best = F.array_min(F.array(*share))
    return F.when(text.rlike(f"[{_class()}]"), F.when(-3 * best["less"] > letters, best["code"]))  # most texts have none, so that the rest costs nothing


def plain(text: Column) -> Column:
    """The text's lower-cased words, each with a space at both ends."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"\P{L}+", " ")


def grams(text: Column) -> Column:
    """All trigrams of the text's words."""
    return F.regexp_extract_all(plain(text), F.lit(r"(?s)(?=(...))"), F.lit(1))


def _letters(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of texts one after the other, about PART at a time, and the row of each; pieces of a text overlap by two, so every trigram is in one."""
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(ends, ends[at] - sizes[at] + PART, side="right")) - at)
        own = column.slice(at, n)
        texts = "".join(t for t in own.to_pylist() if t is not None) if n > 1 else own[0].as_py() or ""
        rows = np.arange(at, at + n)
        for begin in range(0, max(len(texts) - 2, 0), PART) if n == 1 else (0,):
            part = texts[begin : begin + PART + 2] if n == 1 else texts
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            yield points, np.full(len(points), at) if n == 1 else np.repeat(rows, sizes[at : at + n])
        at += n


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values (small numbers), sorted, and which of them each is."""
    seen = np.zeros(int(values.max()) + 1 if len(values) else 0, dtype=bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[values]


def _gram_text(code: int) -> str:
    mask = (1 << CODE) - 1
    return chr(code >> 2 * CODE) + chr(code >> CODE & mask) + chr(code & mask)


def _gram_code(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 2 * CODE | b << CODE | c


def _counted(points: np.ndarray, rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, code and count of each distinct trigram of the groups (-1: none) that rows are of."""
    used, letter = _ranked(points)
    inside = (rows[2:] == rows[:-2]) & (group[rows[2:]] >= 0)
    n = len(used)
    at = ((letter[:-2] * n + letter[1:-1]) * n + letter[2:])[inside]
    of, own = _ranked(group[rows[2:][inside]])
    if len(of) * n**3 <= 4 * DENSE:
        sums = np.bincount(at + own * n**3, minlength=1)
        found = np.flatnonzero(sums)
        sums, own, at = sums[found], found // n**3, found % n**3
    else:
        order = np.lexsort((at, own))
        at, own = at[order], own[order]
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (own[1:] != own[:-1])))
        sums, own, at = np.diff(np.append(first, len(at))), own[first], at[first]
    return of[own], used[at // (n * n)] << 2 * CODE | used[at // n % n] << CODE | used[at % n], sums


def gram_counts(texts: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, gram and n, in sums that are still to be added up, of labelled texts (null labels are left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = limit = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                codes, sums = merged(parts)
                for i in range(0, len(codes), 100_000):
                    own = codes[i : i + 100_000].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array([_gram_text(c) for c in own], pa.string()), pa.array(sums[i : i + 100_000])], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            label = batch.column(0).dictionary_encode()
            names, group = label.dictionary.to_pylist(), label.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for points, rows in _letters(batch.column(1)):
                own, code, sums = _counted(points, rows, group)
                for at in np.unique(own).tolist():
                    held.setdefault(names[at], []).append((code[own == at], sums[own == at]))
                size += len(code)
                if size > max(HELD, 2 * limit):
                    held = {name: [merged(parts)] for name, parts in held.items()}
                    size = limit = sum(len(parts[0][0]) for parts in held.values())
                    if size > HELD:
                        yield from flush()
                        size = limit = 0
        yield from flush()

    labelled = texts.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), plain(F.col(text)).alias("words"))
    return labelled.mapInArrow(run, "lang string, gram string, n long")


def profiles(texts: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, gram and weight: the TOP trigrams of each language of labelled texts (null labels are left out), ties by the trigram."""
    counted = gram_counts(texts, lang, text).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= TOP)
    return ranked.select("lang", "gram", (TOP + 1 - F.col("rank")).cast("long").alias("weight"))


class _Profiles:
    """Weights of trigrams for all languages."""

    def __init__(self, rows: list):
        self.names = sorted({r.lang for r in rows})
        codes = np.array([_gram_code(r.gram) for r in rows], dtype=np.int64)
        self.codes, at = np.unique(codes, return_inverse=True)
        place, n = {name: i for i, name in enumerate(self.names)}, len(rows)
        order = np.argsort(at, kind="stable")
        self.lang, self.weight = np.array([place[r.lang] for r in rows])[order], np.array([r.weight for r in rows], dtype=np.int64)[order]
        self.first = np.searchsorted(at[order], np.arange(len(self.codes) + 1)) if n else np.zeros(1, dtype=np.int64)
        mask = (1 << CODE) - 1
        self.letters = np.unique(np.concatenate([self.codes >> 2 * CODE, self.codes >> CODE & mask, self.codes & mask]))
        self.dense = None
        if (size := len(self.letters) + 1) ** 3 <= DENSE:
            self.dense = np.full(size**3, -1, dtype=np.int32)
            a, b, c = (np.searchsorted(self.letters, x) for x in (self.codes >> 2 * CODE, self.codes >> CODE & mask, self.codes & mask))
            self.dense[(a * size + b) * size + c] = np.arange(len(self.codes))

    def found(self, points: np.ndarray) -> np.ndarray:
        """The place of each trigram among the known ones, -1 for others."""
        if self.dense is not None:
            size, table = len(self.letters) + 1, np.full(max(int(self.letters.max(initial=0)), int(points.max(initial=0))) + 1, len(self.letters))
            table[self.letters] = np.arange(len(self.letters))
            letter = table[points]
            return self.dense[(letter[:-2] * size + letter[1:-1]) * size + letter[2:]]
        point = points.astype(np.int64)
        code = point[:-2] << 2 * CODE | point[1:-1] << CODE | point[2:]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, at, -1)

    def sums(self, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, language and sum of weights, where a row shares a trigram with the language."""
        at = self.found(points)
        good = np.flatnonzero((at >= 0) & (rows[2:] == rows[:-2]))
        at, row = at[good], rows[2:][good]
        if not len(at):
            return row, row, row
        base, n = int(row[0]), len(self.names)
        size = self.first[at + 1] - self.first[at]
        each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[at], size)
        cell = np.repeat(row - base, size) * n + self.lang[each]
        names, inverse = np.unique(cell, return_inverse=True) if (int(row[-1]) - base + 1) * n > DENSE else (None, cell)
        total = np.bincount(inverse, weights=self.weight[each]).astype(np.int64)  # exact below 2^53
        some = np.flatnonzero(total)
        cell = some if names is None else names[some]
        return cell // n + base, cell % n, total[some]


def scores(texts: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang and score of each text and each language that it shares a trigram with."""
    rows = known.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        found = texts.select(F.col(key), F.explode(grams(F.col(text))).alias("gram"))
        return found.join(known, "gram").groupBy(key, "lang").agg(F.sum("weight").alias("score"))
    sent = texts.sparkSession.sparkContext.broadcast(_Profiles(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for points, at in _letters(batch.column(1)) if len(own.codes) else ():
                row, lang, total = own.sums(points, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(own.names, pa.string()).take(pa.array(lang)), pa.array(total)], names=[key, "lang", "score"])

    source = texts.select(key, plain(F.col(text)).alias("words"))
    return source.mapInArrow(run, f"`{key}` {source.dtypes[0][1]}, lang string, score long").groupBy(key, "lang").agg(F.sum("score").alias("score"))


def detect(texts: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and language of each row of texts; known: profiles()."""
    best = scores(texts, known, key, text).groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("less"), "lang")).alias("best"))
    return texts.select(F.col(key), script_language(F.col(text)).alias("sole")).join(best, key, "left").select(key, F.coalesce("sole", F.col("best.lang")).alias("language"))


def detect_sql(source: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> str:
    """The same for a table with labels, learnt from all its rows."""
    share = lambda code: "".join(f"\\p{{{s}}}" for s, own in SOLE if code in (None, own))
    counts = ", ".join(f"{{'less': -length(regexp_replace(sole, '[^{share(c)}]', '', 'g')), 'code': '{c}'}}" for c in _CODES)
    return f"""
WITH t AS (SELECT {key}, {lang} AS lang, regexp_replace(' ' || lower({text}) || ' ', '\\P{{L}}+', ' ', 'g') AS w,
  regexp_replace({text}, '[^{share(None)}]', '', 'g') AS sole, length(regexp_replace({text}, '\\P{{L}}', '', 'g')) AS letters FROM {source}),
g AS (SELECT {key}, lang, unnest([substring(w, i, 3) FOR i IN range(1, length(w) - 1)]) AS gram FROM t),
n AS (SELECT lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY ALL),
p AS (SELECT lang, gram, {TOP + 1} - row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS weight FROM n QUALIFY weight > 0),
s AS (SELECT g.{key}, p.lang, sum(weight) AS score FROM g JOIN p USING (gram) GROUP BY ALL),
b AS (SELECT {key}, min({{'less': -score, 'lang': lang}}) AS best FROM s GROUP BY 1),
o AS (SELECT {key}, letters, sole, list_min([{counts}]) AS sole_best FROM t)
SELECT {key}, CASE WHEN sole <> '' AND -3 * sole_best.less > letters THEN sole_best.code ELSE best.lang END AS language FROM o LEFT JOIN b USING ({key})
"""
