"""Vectors as arrays of doubles, in built-in expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def normalise(a: Column, guard: float = 1e-8) -> Column:
    return F.transform(F.arrays_zip(a.alias("v"), F.array_repeat(norm(a), F.size(a)).alias("n")), lambda z: z["v"] / (z["n"] + guard))


def cosine(a: Column, b: Column, guard: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + guard)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
