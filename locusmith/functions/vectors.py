"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast(DOUBLES), b.cast(DOUBLES), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast(DOUBLES), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; an error where their sizes differ, they are empty, or one has norm zero; null for null."""
    fault = (
        F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in size")).cast("double"))
        .when(F.size(a) == 0, F.raise_error(F.lit("empty vector")).cast("double"))
        .when((norm(a) == 0) | (norm(b) == 0), F.raise_error(F.lit("vector of norm zero")).cast("double"))
    )
    return F.coalesce(fault, dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column) -> Column:
    """The vector divided by its norm; one of norm zero stays."""
    length = norm(a)
    return F.transform(a.cast(DOUBLES), lambda x: x / F.when(length == 0, 1.0).otherwise(length))


def faults(a: Column, dimensions: int) -> Column:
    """What is wrong with a vector: missing, dimensions, not finite, zero; null if nothing is."""
    finite = F.forall(a.cast(DOUBLES), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        F.when(a.isNull(), "missing")
        .when(F.size(a) != dimensions, "dimensions")
        .when(~finite, "not finite")
        .when(~F.exists(a.cast(DOUBLES), lambda x: x != 0), "zero")
    )


def pooled(states: Column, mask: Column, how: str) -> Column:
    """A sentence vector from token states (array of arrays) and a 0/1 mask: mean, cls or lasttoken, then of unit length.

    Without a token under the mask, mean and lasttoken give null.
    """
    seen = F.filter(F.zip_with(states, mask, lambda s, m: F.struct(s.cast(DOUBLES).alias("s"), m.alias("m"))), lambda p: p["m"] == 1)
    if how == "cls":
        chosen = F.get(states, F.lit(0)).cast(DOUBLES)
    elif how == "lasttoken":
        chosen = F.get(seen, F.size(seen) - 1)["s"]
    elif how == "mean":
        first = F.get(seen, F.lit(0))["s"]
        zero = F.transform(first, lambda _: F.lit(0.0))
        total = F.aggregate(seen, zero, lambda s, p: F.zip_with(s, p["s"], lambda x, y: x + y))
        chosen = F.transform(total, lambda x: x / F.size(seen))
    else:
        raise ValueError(f"unknown pooling {how}")
    return unit(chosen)


def literal(a: Column) -> Column:
    """A vector as text, [x,y,...], that vector_of reads back to the same numbers; null for null."""
    return F.when(a.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(a.cast(DOUBLES), lambda x: x.cast("string")), ","), F.lit("]")))


def vector_of(text: Column) -> Column:
    """The vector a literal stands for; null where the text is none."""
    return F.when(text.rlike(r"^\[.*\]$"), F.transform(F.split(F.regexp_replace(text, r"^\[|\]$", ""), ","), lambda x: x.try_cast("double")))
