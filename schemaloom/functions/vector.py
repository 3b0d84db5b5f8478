"""Vector expressions that stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; NULL if a vector is NULL, lengths differ or one is all zero."""
    x, y = ((F.col(v) if isinstance(v, str) else v).cast("array<double>") for v in (a, b))
    norm = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (norm > 0), _dot(x, y) / norm)


def cosine_to(a: Column | str, query: list[float]) -> Column:
    """Cosine similarity to one fixed vector, whose norm is computed once."""
    length = math.sqrt(sum(q * q for q in query))
    if length == 0:
        return F.lit(None).cast("double")
    x = (F.col(a) if isinstance(a, str) else a).cast("array<double>")
    norm = F.sqrt(_dot(x, x))
    return F.when((F.size(x) == len(query)) & (norm > 0), _dot(x, F.array(*[F.lit(float(q)) for q in query])) / norm / F.lit(length))


def unit_score(similarity: Column) -> Column:
    """The scale of index scores: (1 + cosine) / 2."""
    return (F.lit(1.0) + similarity) / 2
