"""Column expressions: normalisation, thresholds, distances, kernels, penalties."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def minmax(v, lo, hi, a: float = 0.0, b: float = 1.0, eps: float = EPS) -> Column:
    return (_c(v) - _c(lo)) / (_c(hi) - _c(lo) + F.lit(eps)) * F.lit(b - a) + F.lit(a)


def zscore(v, mean, std, eps: float = EPS) -> Column:
    return (_c(v) - _c(mean)) / (_c(std) + F.lit(eps))


def maxabs(v, most, eps: float = EPS) -> Column:
    return _c(v) / (_c(most) + F.lit(eps))


def normalise(method: str, v, **stats) -> Column:
    if method == "minmax":
        return minmax(v, stats["lo"], stats["hi"])
    if method == "zscore":
        return zscore(v, stats["mean"], stats["std"])
    if method == "maxabs":
        return maxabs(v, stats["most"])
    raise ValueError(f"unknown normalisation: {method}")


def denormalise(method: str, v, **stats) -> Column:
    """The inverse, without the small constant that keeps the forward form from dividing by zero."""
    if method == "minmax":
        return _c(v) * (_c(stats["hi"]) - _c(stats["lo"])) + _c(stats["lo"])
    if method == "zscore":
        return _c(v) * _c(stats["std"]) + _c(stats["mean"])
    if method == "maxabs":
        return _c(v) * _c(stats["most"])
    raise ValueError(f"unknown normalisation: {method}")


def soft_threshold(z, k) -> Column:
    return F.signum(_c(z)) * F.greatest(F.abs(_c(z)) - _c(k), F.lit(0.0))


def zero_suppress(v, threshold: float = 1e-4, decimals: int | None = 3) -> Column:
    """Small values to 0, then rounding half to even."""
    kept = F.when(F.abs(_c(v)) < threshold, 0.0).otherwise(_c(v))
    return kept if decimals is None else F.bround(kept, decimals)


def distance(left: list, right: list, metric: str = "l2") -> Column:
    gaps = [F.abs(_c(a).cast("double") - _c(b).cast("double")) for a, b in zip(left, right)]
    if metric in ("l1", "manhattan"):
        return reduce(lambda a, b: a + b, gaps)
    if metric in ("l2", "euclidean"):
        return F.sqrt(reduce(lambda a, b: a + b, [g * g for g in gaps]))
    if metric in ("linf", "chebyshev"):
        return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    raise ValueError(f"unknown metric: {metric}")


def gaussian_kernel(d, sigma: float) -> Column:
    s = max(float(sigma), 1e-6)
    return F.exp(-(_c(d) * _c(d)) / F.lit(2.0 * s * s))


def proximity_penalty(d, min_distance: float) -> Column:
    """1 at a sensor, falling with the distance to the nearest; 0 where there is none."""
    return F.coalesce(F.exp(-_c(d) / F.lit(min_distance + 1e-10)), F.lit(0.0))


def confidence(mean, std, n, level: float = 0.95) -> tuple[Column, Column]:
    """Normal interval; levels other than 0.90, 0.95 and 0.99 count as 0.95. Not a number where there is no deviation (one value)."""
    z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}.get(round(level, 2), 1.96)
    half = F.lit(z) * F.coalesce(_c(std), F.lit(float("nan"))) / F.sqrt(_c(n).cast("double"))
    return _c(mean) - half, _c(mean) + half


def step_number(name) -> Column:
    """The first number after an underscore, 0 without one."""
    found = F.regexp_extract(_c(name), r"_(\d+)", 1)
    return F.coalesce(F.when(found != "", found).cast("int"), F.lit(0))


def step_of(name: str) -> int:
    m = re.search(r"_(\d+)", name)
    return int(m[1]) if m else 0


def row_major(indices: list, shape: list[int]) -> Column:
    """The flat cell id of indices, last axis fastest."""
    out = F.lit(0).cast("long")
    for i, n in zip(indices, shape):
        out = out * F.lit(n) + _c(i).cast("long")
    return out


def unravel(cell, shape: list[int]) -> list[Column]:
    out, rest = [], _c(cell)
    for n in reversed(shape):
        out.append(F.pmod(rest, F.lit(n)).cast("int"))
        rest = F.floor(rest / F.lit(n))
    return out[::-1]


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def display_range(v, lo, hi) -> Column:
    """To [0, 1] for display; a constant becomes 0."""
    return F.when(_c(hi) > _c(lo), F.least(F.greatest((_c(v) - _c(lo)) / (_c(hi) - _c(lo)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
