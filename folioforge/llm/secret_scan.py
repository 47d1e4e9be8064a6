"""Secret scans through a trigram inverted index (operator 9), in DataFrame functions only.

Each rule is a regular expression, from which a Boolean query over trigrams is
derived: a list of clauses, each a set of trigrams that a match needs.  The index
holds, per trigram that any rule asks for and per block of texts, the list of
texts with it (lower-cased).  Clauses intersect postings, clauses of a rule
unite, and the rule's expression is run on the candidates only.  A rule without
mandatory trigrams, such as a run of hexadecimal digits, scans every text.  The
candidates, a few of a hundred texts, are sent to the texts while they are at most
`BROADCAST_KEYS`; beyond that both are dealt out by key.

Blocks hold about `BLOCK_ROWS` texts, so no posting list grows with the input.

Defined results: null text is an empty text without spans; repeated rows are
scanned one by one; null ids are ordinary; an empty table gives no rows; texts of any
length are scanned whole, in time linear in their matches; extra columns are kept by
`redact_documents` whatever their names; positions are code points; spans that begin
at one place stand in the order of the rules.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.shared import documents, write_table

BLOCK_ROWS = 4096
CHUNK = 256
BROADCAST_KEYS = 2_000_000  # candidates, of some 40 bytes, up to which they are sent to the texts
MASK = "[secret]"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # read alike by Python and Java
    group: int = 0
    least: int = 1  # characters that the group must have, or the match is dropped
    base: bool = False


# The patterns of the rules.
RULES = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
)

ANYTHING = [frozenset()]
MOST_STRINGS = 64


def _simplest(clauses: list[frozenset]) -> list[frozenset]:
    """Clauses without those that another one implies."""
    unique = sorted(set(clauses), key=lambda c: (len(c), sorted(c)))
    return [c for i, c in enumerate(unique) if not any(d <= c for d in unique[:i])]


def _of_strings(strings: set[str]) -> list[frozenset]:
    return _simplest([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    joined = _simplest([x | y for x, y in product(a, b)])
    return joined if len(joined) <= MOST_STRINGS else min(a, b, key=len)


def trigram_query(pattern: str) -> list[frozenset]:
    """Clauses of lower-case trigrams: every match's text has all of some clause's.  An empty clause: any text."""

    def visit(parsed) -> tuple[set[str] | None, list[frozenset]]:
        """All strings that match, if few, and else None; the query."""
        run, query = {""}, ANYTHING
        exact = True
        for op, value in parsed:
            strings, own = one(op, value)
            if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
                run = {a + b for a, b in product(run, strings)}
                continue
            query = _both(_both(query, _of_strings(run)), own if strings is None else _of_strings(strings))
            run, exact = {""}, False
        return (run, _of_strings(run)) if exact else (None, _both(query, _of_strings(run)))

    def one(op, value) -> tuple[set[str] | None, list[frozenset]]:
        if op is sre.LITERAL:
            return {chr(value).lower()}, ANYTHING
        if op is sre.IN:
            chars = set()
            for kind, x in value:
                if kind is not sre.LITERAL:
                    return None, ANYTHING
                chars.add(chr(x).lower())
            return chars, ANYTHING
        if op is sre.SUBPATTERN:
            return visit(value[-1])
        if op is sre.BRANCH:
            parts = [visit(p) for p in value[1]]
            if all(s is not None for s, _ in parts):
                return set().union(*(s for s, _ in parts)), ANYTHING
            return None, _simplest([c for _, q in parts for c in q])
        if op is sre.MAX_REPEAT:
            low, high, inner = value
            strings, query = visit(inner)
            if (low, high) == (0, 1) and strings is not None:
                return strings | {""}, ANYTHING
            if low == high and strings is not None and len(strings) == 1 and low <= 16:
                return {next(iter(strings)) * low}, ANYTHING
            return None, query if low else ANYTHING
        return None, ANYTHING

    strings, query = visit(parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches, leftmost and non-overlapping, failing ones dropped."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    size = lambda a: F.transform(a, F.char_length)
    rows = F.arrays_zip(size(found).alias("own"), F.slice(size(between), F.lit(1), F.size(found)).alias("gap"), size(held).alias("held"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, row: Column) -> Column:
        begin = state["at"] + row["gap"]
        end = begin + row["own"]
        kept = F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(row["held"] >= rule.least, kept).otherwise(state["out"]).alias("out"))

    def chunk(state: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("out")), step)  # what is done isn't carried through its steps, as each copies its state
        return once(own, lambda s: F.struct(s["at"].alias("at"), F.concat(state["done"], F.array(s["out"])).alias("done")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("done"))
    return once(rows, lambda r: F.aggregate(chunks(r), start, chunk, lambda s: F.flatten(s["done"])))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once though use has it inside other functions."""
    return F.transform(F.array(value), use)[0]


def chunks(rows: Column) -> Column:
    """An array cut into arrays of CHUNK, so that what grows element by element stays short."""
    last = F.greatest(F.ceil(F.size(rows) / CHUNK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(rows, c * CHUNK + 1, F.lit(CHUNK)))


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, kinds: the rules with mandatory trigrams whose query a text (key, text) meets."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANYTHING}
    grams = sorted({g for q in queries.values() for c in q for g in c})
    blocks = max(1, -(-texts.count() // block_rows))
    lowered = texts.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    postings = lowered.select("key", F.explode(held).alias("gram"))
    index = postings.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "gram").agg(F.collect_set("key").alias("keys"))
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("of"))

    def clause(grams: frozenset) -> Column:
        none = F.array().cast("array<bigint>")
        first, *rest = [F.coalesce(F.col("of")[g], none) for g in sorted(grams)]
        for other in rest:
            first = F.array_intersect(first, other)
        return first

    met = F.array(*[F.struct(F.lit(kind).alias("kind"), F.flatten(F.array(*[clause(c) for c in q])).alias("keys")) for kind, q in queries.items()])
    pairs = lists.select(F.explode(met).alias("met")).select(F.col("met.kind").alias("kind"), F.explode("met.keys").alias("key"))
    return pairs.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _placed(place: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end"))


def scanned(docs: DataFrame, column: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with `column`, array<struct<start, kind (its place in rules), end>> of all spans in order."""
    key, kinds = f"{column}_key", f"{column}_kinds"
    keyed = docs.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c in ("doc_id", "text")]))
    text = F.coalesce("text", F.lit(""))
    found = candidates(keyed.select(F.col(key).alias("key"), text.alias("text")), rules).select(F.col("key").alias(key), F.col("kinds").alias(kinds))
    found, _ = write_table(found, "candidates")
    few = found.count() <= BROADCAST_KEYS  # texts stay where they are; the same rows either way
    joined = keyed.join(F.broadcast(found) if few else found.hint("shuffle_hash"), key, "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for place, rule in enumerate(rules):
        own = F.transform(spans(text, rule), _placed(place))
        scan = text.rlike(rule.pattern) if trigram_query(rule.pattern) == ANYTHING else F.array_contains(kinds, rule.kind)
        parts.append(F.when(scan, own).otherwise(none))
    return joined.withColumn(column, F.array_sort(F.concat(*parts))).drop(key, kinds)


def redacted(text: Column, found: Column) -> Column:
    """text with every span, overlapping ones as one, replaced by MASK."""

    def step(state: Column, s: Column) -> Column:
        gap = s["start"] - state["at"]
        piece = F.concat(F.substring(state["near"], state["at"] - state["base"] + 1, gap), F.lit(MASK))
        out = F.when(gap >= 0, F.concat(state["out"], F.array(piece))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["base"].alias("base"), state["near"].alias("near"), out.alias("out"))

    def chunk(state: Column, part: Column) -> Column:
        near = F.substring(text, state["at"] + 1, F.array_max(F.transform(part, lambda s: s["end"])) - state["at"])  # cut once, as finding a place costs its distance
        begin = F.struct(state["at"].alias("at"), state["at"].alias("base"), near.alias("near"), F.array().cast("array<string>").alias("out"))
        return once(F.aggregate(part, begin, step), lambda s: F.struct(s["at"].alias("at"), F.concat(state["done"], F.array(F.array_join(s["out"], ""))).alias("done")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("done"))
    rest = lambda s: F.concat(F.array_join(s["done"], ""), F.substring(text, s["at"] + 1, F.char_length(text)))
    return F.when(F.size(found) > 0, once(found, lambda f: F.aggregate(chunks(f), start, chunk, rest))).otherwise(text)


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, every secret in text masked; n_chars, where docs has it, follows the text."""
    column = "secret_spans"
    while any(c.lower().startswith(column) for c in docs.columns):
        column += "_"
    hit = scanned(docs, column, rules).withColumn("text", redacted(F.col("text"), F.col(column)))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.when(F.size(column) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return hit.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and spans."""
    rows = scanned(documents(spark, sf_dir).select("doc_id", "text"), "found")
    names = F.array(*[F.lit(r.kind) for r in RULES])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    of = lambda keep: F.filter("found", keep)
    count = lambda k: F.size(of(lambda s: s["kind"] == k)).cast("long")
    base = len([r for r in RULES if r.base])
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(RULES) if r.base],
        F.sha2(joined(of(lambda s: s["kind"] < base)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )
