"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, zero: float | None = None) -> Column:
    """Cosine; ``zero`` (null unless given) if either vector has no length."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(zero).cast("double"))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine(a, b)


def unit(a: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def mock_embedding(text: Column, dim: int = 16) -> Column:
    """A deterministic unit vector from the text's SHA-256, tiled to ``dim``."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0)
    return unit(raw)
