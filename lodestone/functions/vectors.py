"""Vector expressions over ARRAY<FLOAT> columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is the zero vector."""
    pair = F.struct(a.alias("a"), b.alias("b"))
    return let(pair, lambda p: F.coalesce(F.try_divide(dot(p["a"], p["b"]), norm(p["a"]) * norm(p["b"])), F.lit(0.0)))


def unit(a: Column) -> Column:
    sized = lambda v: F.struct(v.alias("v"), norm(v).alias("n"))
    return let(a, lambda v: let(sized(v), lambda p: F.transform(p["v"], lambda x: F.coalesce(F.try_divide(x.cast("double"), p["n"]), F.lit(0.0)))))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def similarity_of_distance(squared: Column) -> Column:
    """Cosine of unit vectors at a squared distance, clipped to [0, 1]."""
    return F.least(F.greatest(1 - squared / 2, F.lit(0.0)), F.lit(1.0))


def is_valid(a: Column, dimension: int) -> Column:
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dimension) & finite, F.lit(False))


def hashed_embedding(words: Column, dimension: int = 64) -> Column:
    """Unit vector of word counts by hash bucket: the stand-in where no model's vectors are given."""
    bucket = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dimension)
    return unit(let(bucket, lambda bs: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(bs, lambda b: b == i)).cast("double"))))
