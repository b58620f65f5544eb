"""Vector arithmetic over ``array<float>`` or ``array<double>`` columns, in doubles."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size > 0, F.transform(as_double(v), lambda x: x / size)).otherwise(as_double(v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


#: name -> (score, whether larger is better)
DISTANCES: dict[str, tuple[Callable[[Column, Column], Column], bool]] = {
    "COSINE": (cosine, True),
    "DOT": (dot, True),
    "EUCLID": (euclid, False),
    "MANHATTAN": (manhattan, False),
}


def distance(name: str) -> tuple[Callable[[Column, Column], Column], bool]:
    """The score of a configured distance, by name in any case."""
    try:
        return DISTANCES[name.upper()]
    except KeyError:
        raise ValueError(f"unknown distance {name!r}; known: {', '.join(DISTANCES)}") from None


def unrolled(name: str, a: list[Column], b: list[Column], norm_a: Column, norm_b: Column) -> Column:
    """The distance of that name over single components, which Spark compiles; the terms are added in the order of :func:`total`."""

    def added(terms: Iterable[Column]) -> Column:
        return reduce(lambda x, y: x + y, terms, F.lit(0.0))

    pairs = list(zip(a, b, strict=True))
    if name.upper() == "MANHATTAN":
        return added(F.abs(x - y) for x, y in pairs)
    if name.upper() == "EUCLID":
        return F.sqrt(added((x - y) * (x - y) for x, y in pairs))
    product = added(x * y for x, y in pairs)
    return product if name.upper() == "DOT" else F.coalesce(F.try_divide(product, norm_a * norm_b), F.lit(0.0))
