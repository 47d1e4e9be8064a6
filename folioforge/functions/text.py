"""Text expressions: trimming, sanitizing, terms, scores and names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_WORDS = 20

# Frequent words that tell four languages apart.
STOP_WORDS = {
    "deu": ("der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "eng": ("the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "his", "they", "at", "be", "this", "from"),
    "fra": ("le", "de", "un", "et", "être", "il", "en", "avoir", "que", "pour", "dans", "ce", "une", "sur", "avec", "des", "les", "la", "du", "est"),
    "spa": ("el", "la", "de", "que", "y", "a", "en", "un", "ser", "se", "no", "haber", "por", "con", "su", "para", "los", "las", "del", "una"),
}


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sanitize(text: Column) -> Column:
    """Lines trimmed, those with an inline data address dropped, runs of blank lines made one.

    A dropped line ends a run of blank lines, so blanks on both its sides stay.
    """
    lines = F.transform(F.split(text, "\n"), trim)
    data = lambda x: F.contains(F.lower(x), F.lit("data:"))
    kept = F.filter(lines, lambda x, i: ~data(x) & ~((x == "") & (i > 0) & (F.get(lines, i - 1) == "")))
    return trim(F.array_join(kept, "\n"))


def language(text: Column) -> Column:
    """The language whose frequent words occur most often, ties to the first in order; null without any."""
    own = F.transform(words(F.lower(text)), lambda w: F.rtrim(w, F.lit(".,;:!?")))
    score = lambda own, code: F.size(F.filter(own, lambda w: w.isin(*STOP_WORDS[code])))
    best = once(own, lambda o: F.array_min(F.array(*[F.struct((-score(o, c)).alias("less"), F.lit(c).alias("code")) for c in sorted(STOP_WORDS)])))
    return once(best, lambda b: F.when(b["less"] < 0, b["code"]))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once where use has it several times or inside other functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unique_terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits of more than one character."""
    parts = F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: F.char_length(t) > 1)
    return F.array_distinct(F.transform(parts, F.lower))


MOST_COUNTED = 65535


def capped(n: Column) -> Column:
    return F.least(n, F.lit(MOST_COUNTED))


def full_text_score(question_terms: Column, body_terms: Column, title_terms: Column) -> Column:
    """0.8 of the share of question terms in the body plus 0.2 of that in the title."""
    n = capped(F.size(question_terms))
    share = lambda terms: capped(F.size(F.array_intersect(question_terms, terms))) / n
    return F.when(n > 0, F.least(F.lit(1.0), 0.8 * share(body_terms) + 0.2 * share(title_terms))).otherwise(0.0)


def clean_name(name: Column) -> Column:
    """Ends freed of all but letters, digits, ', - and _; spaces squeezed; null if nothing stays."""
    inner = F.regexp_replace(name, r"^[^\p{IsAlphabetic}\p{N}'_-]+|[^\p{IsAlphabetic}\p{N}'_-]+$", "")
    squeezed = F.regexp_replace(inner, r"(?U)\s+", " ")
    return F.when(squeezed != "", squeezed)


def escape_markup(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def memory_bytes(text: Column) -> Column:
    """Bytes of sizes such as 12.3MiB; null where the unit isn't known."""
    units = {"B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30}
    number = F.regexp_extract(trim(text), r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)$", 1)
    unit = F.upper(F.regexp_extract(trim(text), r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)$", 2))
    factor = F.element_at(F.create_map(*[F.lit(x) for u, n in units.items() for x in (u, n)]), unit)
    return F.when(number != "", (number.try_cast("double") * factor).cast("long"))
