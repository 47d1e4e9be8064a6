"""Vector expressions: hash embeddings, cosine and score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 384
WEIGHTS = (0.70, 0.20, 0.10)  # vector, full text, graph


def hash_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """Component i: the first two bytes of sha256(text, i as 8 bytes), little-endian, scaled to [-1, 1]."""
    data = F.encode(text, "UTF-8")

    def component(i: Column) -> Column:
        low, high = F.lpad(F.hex(i % 256), 2, "0"), F.lpad(F.hex(F.floor(i / 256)), 2, "0")
        digest = F.sha2(F.concat(data, F.unhex(F.concat(low, high, F.lit("0" * 12)))), 256)
        value = F.conv(F.concat(F.substring(digest, 3, 2), F.substring(digest, 1, 2)), 16, 10).cast("double")
        return value / 65535 * 2 - 1

    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), component)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def unit(score: Column) -> Column:
    """A cosine as a score from 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score + 1) / 2))


def fuse(vector: Column, text: Column, graph: Column) -> Column:
    v, t, g = WEIGHTS
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v * vector + t * text + g * graph))


def normalized(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)


def blend(left: Column, right: Column, weight: float) -> Column:
    """left + weight * right, scaled to length 1."""
    return normalized(F.zip_with(left, right, lambda x, y: x + weight * y))


def digest_vector(seed: Column, dimension: int = DIMENSION) -> Column:
    """A unit vector from seeded hash bytes, each (byte - 127.5) / 127.5."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(-(-dimension // 32) - 1)), lambda i: F.sha2(F.concat_ws(":", seed, i), 256))
    digits = F.array_join(blocks, "")
    byte = lambda i: (F.conv(F.substring(digits, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("double") - 127.5) / 127.5
    return normalized(F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), byte))
