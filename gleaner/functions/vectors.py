"""Vector expressions over array columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def l2_normalized(vec: Column) -> Column:
    """``vec`` scaled to unit length (double); a zero vector stays zero."""
    norm = F.sqrt(dot(vec, vec))
    return F.transform(
        as_doubles(vec), lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))
    )


def sign_bits(vec: Column) -> Column:
    """1 for every positive dimension, 0 for the others."""
    return F.transform(vec, lambda x: F.when(x > 0, 1).otherwise(0))


def vector_text(vec: Column) -> Column:
    """Bracketed, comma-separated text form of a vector."""
    return F.concat(F.lit("["), F.concat_ws(",", F.transform(vec, lambda x: x.cast("string"))), F.lit("]"))


def parsed_vector(text: Column) -> Column:
    """Inverse of :func:`vector_text`."""
    return F.from_json(text, "array<float>")


def pooled(token_vectors: Column, method: str) -> Column:
    """One vector per row from an array of token vectors: ``cls``, ``mean`` or ``max``.

    The fold runs inside the row, so no shuffle and no explode is needed.
    """
    vecs = token_vectors.cast("array<array<double>>")
    first = F.get(vecs, 0)
    rest = F.slice(vecs, 2, F.greatest(F.size(vecs) - 1, F.lit(0)))
    if method == "cls":
        return first
    if method == "mean":
        total = F.aggregate(rest, first, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
        return F.transform(total, lambda x: x / F.size(vecs))
    if method == "max":
        return F.aggregate(
            rest, first, lambda acc, v: F.zip_with(acc, v, lambda x, y: F.greatest(x, y))
        )
    raise ValueError(f"unknown pooling method {method!r}; use cls, mean or max")
