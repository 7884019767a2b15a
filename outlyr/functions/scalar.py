"""Scalar expressions: clipping, wrapping, bins, level grids, exponential scale, names and keyed maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x held between two bounds; null stays null."""
    out = x if low is None else F.when(x < low, F.lit(low)).otherwise(x)
    return out if high is None else F.when(out > high, F.lit(high)).otherwise(out)


def wrap(x: Column, n: Column | int) -> Column:
    """x modulo n, never negative."""
    return F.pmod(x, n if isinstance(n, Column) else F.lit(n))


def exp_scale(y: Column, s: Column | float, r: Column) -> Column:
    """y * exp(s * r)."""
    return y * F.exp((s if isinstance(s, Column) else F.lit(s)) * r)


def digitize(x: Column, edges: Sequence[float]) -> Column:
    """The number of edges (ascending) that x reaches: 0 below the first, len(edges) from the last on."""
    return sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))


def linspace(low: float, high: float, count: int) -> list[float]:
    return [low + i * (high - low) / (count - 1) for i in range(count)] if count > 1 else [low]


def score_levels(x: Column, low: float, high: float) -> Column:
    """0 below ``low``, 0.5 below ``high``, else 1."""
    return F.when(x < low, 0.0).when(x < high, 0.5).otherwise(1.0)


def contour_level(x: Column, levels: Sequence[tuple[float, int]]) -> Column:
    """The label of the first level (from high to low) that x reaches; 0 below all."""
    out = F.lit(0)
    for threshold, label in sorted(levels):
        out = F.when(x >= threshold, F.lit(label)).otherwise(out)
    return out


def fraction_label(b: Column) -> Column:
    """How a corrected map names its fraction: 1 - b, half-even to two places, without trailing zeros."""
    return F.regexp_replace(F.bround(F.lit(1.0) - b, 2).cast("string"), r"(\.\d*?)0+$", "$1")


def log_count(n: Column) -> Column:
    """The natural logarithm of a count; null for none."""
    return F.ln(F.when(n > 0, n))


def merged(first: Column, second: Column) -> Column:
    """Two maps in one; for a common key the second's value stands."""
    keys = F.map_keys(second)
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(keys, k)), second)


def arg_extreme(values: Column, largest: bool = True) -> Column:
    """The 0-based place of the first largest (least) element of an array."""
    return F.array_position(values, F.array_max(values) if largest else F.array_min(values)).cast("int") - 1
