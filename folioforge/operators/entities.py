"""Typed entities from text: explicit fields, suffix words and cue words, as array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.names import entity_id, normalize_name
from folioforge.functions.text import clean_name, once, words

MOST_WORDS = 5

# Labels, suffix words and cue words of the entity types.
LABELS = {
    "person": "PERSON", "organization": "ORGANIZATION", "organisation": "ORGANIZATION", "place": "LOCATION", "location": "LOCATION", "event": "EVENT", "concept": "CONCEPT", "product": "PRODUCT",
}
SUFFIXES = {
    "ORGANIZATION": ("agency", "bank", "company", "corp", "corporation", "foundation", "inc", "incorporated", "institute", "laboratory", "labs", "limited", "llc", "ltd", "media", "university"),
    "LOCATION": ("city", "country", "county", "island", "lake", "mount", "province", "river", "state", "valley"),
    "EVENT": ("agreement", "conference", "election", "festival", "games", "olympics", "summit", "treaty", "war"),
}
CUES = {
    "PERSON": ("dr", "mr", "mrs", "ms", "prof", "president"),
    "LOCATION": ("at", "from", "in", "near", "outside"),
    "CONCEPT": ("algorithm", "approach", "concept", "field", "method", "principle", "theory"),
    "PRODUCT": ("app", "application", "browser", "framework", "library", "model", "platform", "product", "software"),
}
MENTION = "array<struct<kind:string,surface:string,canonical:string>>"
_EDGE = r"[^\p{IsAlphabetic}\p{N}'_-]+"


def _token(raw: Column) -> Column:
    """struct<value, lower, name_like, boundary> of a word with a letter, digit, ', - or _."""

    def built(value: Column) -> Column:
        # the first letter is upper-case; no letters at all count as upper-case
        name_like = value.rlike(r"^\P{IsAlphabetic}*+(?:\p{IsUppercase}|$)|[0-9]")
        return F.struct(value.alias("value"), F.lower(value).alias("lower"), name_like.alias("name_like"), raw.rlike(r"[;|.:]$").alias("boundary"))

    return once(F.regexp_replace(raw, f"^{_EDGE}|{_EDGE}$", ""), built)


def surroundings(text: Column) -> Column:
    """array<struct<at, own>>: for each suffix or cue word its place in `own`, the tokens from four before it to five after it.

    Only these are made tokens of; a mark is any word that may be one in lower case.
    """
    every, around = sorted({w for table in (SUFFIXES, CUES) for own in table.values() for w in own}), _EDGE[:-1] + "*"
    mark = lambda t: F.lower(t).isin(*every) | (t.rlike(_EDGE[:-1]) & t.rlike(rf"(?iu)^{around}(?:{'|'.join(every)}){around}$"))  # noqa: E731  few words get to the last
    whole = F.filter(words(text), lambda t: t.rlike(r"[\p{IsAlphabetic}\p{N}'_-]"))

    def windows(raw: Column) -> Column:
        marks = F.filter(F.transform(raw, lambda t, i: F.when(mark(t), i)), lambda i: i.isNotNull())
        before = lambda i: F.least(i, F.lit(MOST_WORDS - 1))
        return F.transform(marks, lambda i: F.struct(before(i).alias("at"), F.transform(F.slice(raw, i - before(i) + 1, before(i) + 1 + MOST_WORDS), _token).alias("own")))

    return once(whole, windows)


def _kind(word: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kind, own in table.items() for w in own for x in (w, kind)]), word)


def _mention(kind: Column, surface: Column, canonical: Column | None = None) -> Column:
    return F.struct(kind.alias("kind"), surface.alias("surface"), (F.lit(None).cast("string") if canonical is None else canonical).alias("canonical"))


def _joined(own: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.slice(own, start + 1, n), lambda t: t["value"]), " ")


def _marked(found: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The surroundings of words of the table."""
    every = [w for words_ in table.values() for w in words_]
    return F.filter(found, lambda f: F.get(f["own"], f["at"])["lower"].isin(*every))


def _leading(flags: Column) -> Column:
    """How many flags are true from the first on."""
    return once(flags, lambda f: once(F.array_position(f, F.lit(False)), lambda at: F.when(at == 0, F.size(f)).otherwise(at.cast("int") - 1)))


def _mentioned(found: Column, table: dict[str, tuple[str, ...]], start: Callable[[Column], Column], n: Callable[[Column], Column], more: int) -> Column:
    """Mentions of n + more tokens from start on, where n is not 0."""
    sized = F.transform(_marked(found, table), lambda f: F.struct(f["at"].alias("at"), f["own"].alias("own"), n(f).alias("n")))
    return F.transform(F.filter(sized, lambda f: f["n"] > 0), lambda f: _mention(_kind(F.get(f["own"], f["at"])["lower"], table), _joined(f["own"], start(f), f["n"] + more)))


def suffix_mentions(found: Column) -> Column:
    """A suffix word with up to four name-like tokens before it, at least one; found: surroundings()."""

    def before(f: Column) -> Column:
        return _leading(F.transform(F.reverse(F.slice(f["own"], F.lit(1), f["at"])), lambda t: t["name_like"]))

    return _mentioned(found, SUFFIXES, lambda f: f["at"] - f["n"], before, 1)


def cue_mentions(found: Column) -> Column:
    """Up to five name-like tokens after a cue word; a token that ends a clause is the last; found: surroundings()."""

    def after(f: Column) -> Column:
        product = F.get(f["own"], f["at"])["lower"].isin(*CUES["PRODUCT"])
        near = F.slice(f["own"], f["at"] + 2, F.lit(MOST_WORDS))
        follows = lambda n: lambda t, k: F.when(k == 0, t["name_like"] | product).otherwise(t["name_like"] & ~F.coalesce(F.get(n, k - 1)["boundary"], F.lit(True)))
        return once(near, lambda n: _leading(F.transform(n, follows(n))))

    return _mentioned(found, CUES, lambda f: f["at"] + 1, after, 0)


def explicit_mentions(text: Column, lowered: Column | None = None) -> Column:
    """Fields such as `person: X (Y)`: the name, and its alias with the name as canonical."""
    parts, lowered = [], F.lower(text) if lowered is None else lowered
    for label, kind in LABELS.items():
        pattern = rf"(?i)(?<![\p{{IsAlphabetic}}\p{{N}}_]){label}(?U:\s*)[:=]([^;|\n.]*)"
        held = F.when(F.contains(lowered, F.lit(label)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
        values = F.filter(F.transform(held, lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", "")), lambda v: v != "")

        def named(v: Column) -> Column:
            known = F.regexp_extract(v, r"(?is)^(.*?)(?:also known as )(.*)$", 0) != ""
            marker = F.when(known, F.lit("also known as ")).when(F.contains(F.lower(v), F.lit("aka ")), F.lit("aka "))
            at = F.instr(F.lower(v), F.coalesce(marker, F.lit("\x00")))
            inside = F.regexp_replace(F.regexp_extract(v, r"(?s)^[^(]*\(([^)]*)\)", 1), f"^{_EDGE}|{_EDGE}$", "")
            inside = F.regexp_replace(inside, r"(?i)^(?:also known as |aka )", "")
            name = F.when(marker.isNotNull(), F.substring(v, F.lit(1), at - 1)).when(inside != "", F.regexp_extract(v, r"(?s)^([^(]*)\(", 1)).otherwise(v)
            alias = F.when(marker.isNotNull(), F.substring(v, at + F.char_length(marker), F.char_length(v))).when(inside != "", inside)
            return F.struct(clean_name(name).alias("name"), clean_name(alias).alias("alias"))

        pairs = F.filter(F.transform(values, named), lambda p: p["name"].isNotNull())
        own, other = F.lit(kind), F.filter(pairs, lambda p: p["alias"].isNotNull())
        parts += [F.transform(pairs, _named(own)), F.transform(other, _alias(own))]
    return F.concat(*[p.cast(MENTION) for p in parts])


def _named(kind: Column):
    return lambda p: _mention(kind, p["name"])


def _alias(kind: Column):
    return lambda p: _mention(kind, p["alias"], p["name"])


def mentions(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, kind, surface, canonical of every mention."""
    own = chunks.select(key, text, surroundings(F.col(text)).alias("found"))
    field = F.col(text).rlike(rf"(?i)(?:{'|'.join(LABELS)})(?U:\s*)[:=]")  # one look for all labels; few texts have a field
    typed = F.when(field, explicit_mentions(F.col(text)).cast(MENTION)).otherwise(F.array().cast(MENTION))
    return own.select(key, F.inline(F.concat(typed, suffix_mentions(F.col("found")).cast(MENTION), cue_mentions(F.col("found")).cast(MENTION))))


def entities(found: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, entity_id, kind, name, normalized, aliases: all mentions resolved per key, one row for each (kind, normalized)."""
    rows = found.withColumn("normalized", normalize_name(F.coalesce("canonical", "surface"))).filter("normalized IS NOT NULL")
    grouped = rows.groupBy(key, "kind", "normalized").agg(
        F.min(F.coalesce("canonical", "surface")).alias("name"), F.array_sort(F.collect_set(F.when(F.col("canonical").isNotNull(), F.col("surface")))).alias("aliases")
    )
    return grouped.select(
        key, entity_id(F.col("kind"), F.col("normalized")).alias("entity_id"), "kind", "name", "normalized", F.array_remove("aliases", F.col("name")).alias("aliases")
    )


def graph(resolved: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Vertices (one per entity, properties of the greatest (key, name)) and edges (key, entity_id)."""
    vertices = resolved.groupBy("entity_id").agg(F.max(F.struct(key, "kind", "name", "normalized", "aliases")).alias("v")).select("entity_id", "v.kind", "v.name", "v.normalized", "v.aliases")
    return vertices, resolved.select(key, "entity_id").distinct()
