"""Numbers: C-style rounding, combinatorics, differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c_round(value: Column, places: int = 2) -> Column:
    """The double that sprintf("%.<places>f") prints: rounds the exact binary value, half to even."""
    pattern = "0." + "0" * places if places else "0"
    return F.call_function("format_number", value, F.lit(pattern)).cast("double")


def combination(n: Column, k: Column) -> Column:
    """n over k by the multiplicative formula in doubles; k > n/2 is reflected, k <= 0 gives 1."""
    k = F.when(k > n / 2, n - k).otherwise(k).cast("int")
    steps = F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)


def hypergeometric(hits: Column, totals: Column, drawn: Column, population: Column) -> Column:
    """Multivariate: product of C(totals_i, hits_i) and C(the rest), over C(population, drawn). hits, totals: arrays."""
    add = lambda a, x: a + x
    hits, totals = hits.cast("array<bigint>"), totals.cast("array<bigint>")
    zero = F.lit(0).cast("bigint")
    chosen = F.aggregate(F.zip_with(totals, hits, combination), F.lit(1.0), lambda a, x: a * x)
    rest = combination(population - F.aggregate(totals, zero, add), drawn - F.aggregate(hits, zero, add))
    return chosen * rest / combination(population, drawn)


def absolute_difference(a: Column, b: Column, places: int = 2) -> Column:
    return F.round(F.greatest(a, b) - F.least(a, b), places)


def ratio_difference(a: Column, b: Column, places: int = 2) -> Column:
    """(higher - lower) / lower, -1 where lower is 0 and higher isn't, 0 where both are 0."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(high == low, 0.0).when(low == 0, -1.0).otherwise(F.round(F.try_divide(high - low, low), places))


def fake_zero(value: Column) -> Column:
    """Values below 0.01 as 0.001, for logarithmic plots."""
    return F.when(value < 0.01, 0.001).otherwise(value)
