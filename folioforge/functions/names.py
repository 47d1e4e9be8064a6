"""Names beyond the built-in functions: compatibility forms and string similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Other spellings of entity types.
TYPE_ALIASES = {"PLACE": "LOCATION", "ORGANISATION": "ORGANIZATION"}


def plain_name(name: str | None) -> str | None:
    """NFKD without marks, lower-cased, all but letters and digits as single spaces; None if nothing stays."""
    folded = "".join(c.lower() for c in unicodedata.normalize("NFKD", name or "") if unicodedata.category(c)[0] != "M")
    return " ".join("".join(c if c.isalnum() else " " for c in folded).split()) or None


@F.pandas_udf(T.StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    known = {n: plain_name(n) for n in names.unique()}
    return names.map(known)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def name_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else jaro_winkler(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def entity_type(kind: Column) -> Column:
    upper = F.upper(kind)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair]), upper), upper)


def entity_id(kind: Column, normalized: Column) -> Column:
    return F.concat(F.lit("entity-"), F.sha2(F.concat(kind, F.lit(":"), normalized), 256))
