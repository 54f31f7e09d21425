"""Missing values, guarded division, deterministic pseudo-random order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def clean(c: Column) -> Column:
    """NaN and infinities to NULL, so that aggregates skip them."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def safe_divide(a: Column, b: Column, eps: float = EPS) -> Column:
    return a / (b + F.lit(eps))


def seeded_order(*keys: Column, seed: int | str = 42) -> Column:
    """md5 of the keys and a seed: an order that reruns, other engines and any partitioning agree on."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row: inside a lambda, an outer expression is computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def median_of(a: Column) -> Column:
    """Median of an array with linear interpolation; NULL if empty."""
    n = F.size(a)
    return F.when(n > 0, let(F.sort_array(a), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2))


def half_even(c: Column) -> Column:
    return F.rint(c)
