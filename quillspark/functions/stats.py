"""Rates, intervals and vector arithmetic as Column functions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95 % normal quantile as both interval functions round it.
Z95 = 1.959964


def z_for(confidence: float) -> float:
    return Z95 if confidence == 0.95 else NormalDist().inv_cdf((1 + confidence) / 2)


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a rate, within [0, 1]; (0, 1) if n is 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes / m
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    low = F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0))
    return low, F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(1.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def exclusive_p95(values: Column) -> Column:
    """Of a sorted array, by the exclusive method with 20 parts: position 0.95 (n + 1), within the
    array's two last values; the only value if there is one."""
    n = F.size(values)
    place = F.greatest(F.lit(1), F.least(n - 1, F.floor(19 * (n + 1) / 20).cast("int")))
    part = 19 * (n + 1) / 20 - place
    return F.when(n == 1, F.get(values, F.lit(0))).otherwise(F.get(values, place - 1) * (1 - part) + F.get(values, place) * part)


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial tail; 1 without trials. Terms are scaled by 2^-n in logarithms, so
    large counts neither overflow nor vanish."""
    n, k = wins + losses, F.least(wins, losses)
    first = -n * F.log(F.lit(2.0))
    step = lambda i: F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
    tail = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("term"), F.exp(first).alias("sum")),
        lambda s, i: F.struct((s["term"] + step(i)).alias("term"), (s["sum"] + F.exp(s["term"] + step(i))).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))
