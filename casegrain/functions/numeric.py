"""Arithmetic the engine's operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 1.0) -> Column:
    """a / b, and ``empty`` where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def ramp(step: Column, total: int, start: float, end: float, fraction: float) -> Column:
    """A line from start to end over the first fraction of the steps, then flat."""
    return F.lit(start) + F.lit(end - start) * F.least(F.lit(1.0), step / F.lit(max(1.0, total * fraction)))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, not below 0; 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0)))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost at prices for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1e6)


def hash64(c: Column) -> Column:
    """The first eight bytes of SHA-1 as an unsigned number."""
    return F.conv(F.substring(F.sha1(c), 1, 16), 16, 10).cast("decimal(20,0)")


def pearson(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; 0 for fewer than two rows or no variance."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count("*") < 2, 0.0).otherwise(F.coalesce(r, F.lit(0.0)))


def kappa(x: str, y: str) -> Column:
    """Cohen's kappa of two 0/1 columns as an aggregate; 0 without rows, 1 where chance explains all."""
    n = F.count("*").cast("double")
    agree = F.try_divide(F.count_if(F.col(x) == F.col(y)).cast("double"), n)
    p, q = F.avg(F.col(x).cast("double")), F.avg(F.col(y).cast("double"))
    chance = p * q + (1 - p) * (1 - q)
    return F.when(n == 0, 0.0).when(chance >= 1.0, 1.0).otherwise(F.try_divide(agree - chance, 1 - chance))


def pad_left(ids: Column, length: int, pad: int) -> Column:
    """ids with ``pad`` in front up to a length, cut from the front beyond it."""
    n = F.size(ids)
    return F.when(n >= length, F.slice(ids, n - length + 1, length)).otherwise(F.concat(F.array_repeat(F.lit(pad), F.lit(length) - n), ids))
