"""Number, array and bit expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log1p_exp(x: Column) -> Column:
    """ln(1 + e^x) that does not overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_sum_exp(values: str | Column) -> Column:
    """ln of the sum of e^v over an array, shifted by its maximum."""
    m = F.array_max(values)
    return m + F.ln(F.aggregate(F.transform(values, lambda v: F.exp(v - m)), F.lit(0.0), lambda s, v: s + v))


def natural_log(x: Column) -> Column:
    """ln with -Infinity at 0 and NaN below, as array libraries have it."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def flip_bit(x: Column, bit: int) -> Column:
    return x.bitwiseXOR(F.lit(1 << bit))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def grid(start: float, stop: float, n: int) -> list[float]:
    """n even points from start to stop."""
    return [start + (stop - start) * i / (n - 1) for i in range(n)] if n > 1 else [start]


def log_grid(start: float, stop: float, n: int) -> list[float]:
    return [10.0**x for x in grid(start, stop, n)]


def normal_density_2d(x: Column, y: Column, sx: float, sy: float, mx: float, my: float, sxy: float = 0.0) -> Column:
    """Density of a bivariate normal; ``sxy`` is the covariance."""
    rho = sxy / (sx * sy)
    zx, zy = (x - mx) / sx, (y - my) / sy
    z = zx * zx + zy * zy - 2 * rho * zx * zy
    return F.exp(-z / (2 * (1 - rho * rho))) / (2 * 3.141592653589793 * sx * sy * (1 - rho * rho) ** 0.5)


def unit(values: str | Column) -> Column:
    """An array over its Euclidean length; null for length 0."""
    n = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(values, lambda v: v / F.nullif(n, F.lit(0.0)))
