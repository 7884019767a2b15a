"""Maps from amplitudes and amplitudes from maps: a three-dimensional Fourier transform, one axis at a time.

Each axis is transformed line by line: a line (all points that differ in this axis alone) is one row with arrays no longer than the
axis, many lines are transformed together in a task, and an exchange brings the points into the lines of the next axis. No task holds a
map, and maps of many datasets are transformed at once. ``keys`` say whose map a row belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDICES, PLACES = ("h", "k", "l"), ("u", "v", "w")


def grid_shape(lengths: Sequence[float], spacing: float = 0.4999) -> tuple[int, ...]:
    """For each axis the least number of points, of factors 2, 3 and 5 alone, that are no farther apart than ``spacing``."""

    def smooth(n: int) -> bool:
        for p in (2, 3, 5):
            while n % p == 0:
                n //= p
        return n == 1

    out = []
    for a in lengths:
        n = max(int(np.ceil(a / spacing)), 1)
        while not smooth(n):
            n += 1
        out.append(n)
    return tuple(out)


def friedel(amplitudes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``amplitudes`` (keys, h, k, l, f, phi in degrees) with the mate -h, -k, -l of each, of equal f and opposite phi, unless it is there itself."""
    own = amplitudes.select(*keys, *INDICES, "f", "phi")
    mates = own.select(*keys, *[(-F.col(c)).alias(c) for c in INDICES], "f", (-F.col("phi")).alias("phi"))
    return own.unionByName(mates.join(own.select(*keys, *INDICES), [*keys, *INDICES], "left_anti"))


def _axis(points: DataFrame, keys: Sequence[str], axes: Sequence[str], old: str, new: str, n: int, inverse: bool) -> DataFrame:
    """``points`` (keys, axes, re, im) with axis ``old`` transformed into ``new``, of n points; what is missing counts as 0.

    The sign of the exponent is that of a map from amplitudes, or of amplitudes from a map (``inverse``); nothing is divided.
    """
    rest = [*keys, *(a for a in axes if a != old)]
    at = F.pmod(F.col(old).cast("int"), F.lit(n))
    sums = points.groupBy(*rest, at.alias("_at")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))  # indices that fall together
    lines = sums.groupBy(*rest).agg(F.collect_list("_at").alias("_at"), F.collect_list("re").alias("re"), F.collect_list("im").alias("im"))
    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            line = np.zeros((len(b), n), complex)
            row = np.repeat(np.arange(len(b)), b["_at"].map(len))
            flat = lambda c, b=b: np.concatenate(b[c].to_numpy()) if len(b) else np.zeros(0)
            line[row, flat("_at").astype(int)] = flat("re") + 1j * flat("im")
            out = np.fft.ifft(line, axis=1) * n if inverse else np.fft.fft(line, axis=1)
            yield b[rest].assign(re=list(out.real), im=list(out.imag))

    done = lines.mapInPandas(run, f"{kinds}{', ' if rest else ''}re array<double>, im array<double>")
    both = done.select(*rest, F.posexplode(F.arrays_zip("re", "im")).alias(new, "_p"))
    return both.select(*rest, new, "_p.re", "_p.im")


def grid_from_amplitudes(amplitudes: DataFrame, keys: Sequence[str], shape: Sequence[int], volume: float = 1.0) -> DataFrame:
    """(keys, u, v, w, value): the map of amplitudes (keys, h, k, l, f, phi in degrees) on a grid of ``shape`` in a cell of ``volume``.

    One of each pair of mates suffices; the other is added first. A null f or phi takes no part.
    """
    known = amplitudes.where(F.col("f").isNotNull() & F.col("phi").isNotNull())
    a = friedel(known, keys).select(*keys, *INDICES, (F.col("f") * F.cos(F.radians("phi"))).alias("re"), (F.col("f") * F.sin(F.radians("phi"))).alias("im"))
    axes = list(INDICES)
    for i, n in enumerate(shape):
        a = _axis(a, keys, axes, INDICES[i], PLACES[i], n, False)
        axes[i] = PLACES[i]
    return a.select(*keys, *PLACES, (F.col("re") / F.lit(float(volume))).alias("value"))


def inverse_square_distance(cell: Sequence[float]) -> Column:
    """1 / d^2 of a reflection in a cell (a, b, c, alpha, beta, gamma)."""
    from outlyr.operators.geometry import orthogonalisation

    m = np.linalg.inv(orthogonalisation(*cell))
    g = m @ m.T  # the reciprocal metric
    return sum((F.lit(float(g[i, j])) * F.col(INDICES[i]) * F.col(INDICES[j]) for i in range(3) for j in range(3)), F.lit(0.0))


def amplitudes_from_grid(grid: DataFrame, keys: Sequence[str], shape: Sequence[int], volume: float = 1.0, cell: Sequence[float] | None = None, dmin: float = 0.0) -> DataFrame:
    """(keys, h, k, l, f, phi): the amplitudes of maps (keys, u, v, w, value), one of each pair of mates.

    Indices run from -n / 2, exclusive, to n / 2. With a ``cell``, reflections of spacing below ``dmin`` are left out. A grid point that is
    missing or null counts as 0.
    """
    a = grid.select(*keys, *PLACES, F.coalesce("value", F.lit(0.0)).cast("double").alias("re"), F.lit(0.0).alias("im"))
    axes = list(PLACES)
    for i, n in enumerate(shape):
        a = _axis(a, keys, axes, PLACES[i], INDICES[i], n, True)
        axes[i] = INDICES[i]
    signed = [F.when(2 * F.col(c) > n, F.col(c) - n).otherwise(F.col(c)).alias(c) for c, n in zip(INDICES, shape, strict=True)]
    scale = F.lit(float(volume) / float(np.prod(shape)))
    a = a.select(*keys, *signed, (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))
    # an index of n / 2 is its own opposite, so it decides nothing
    side = lambda c, n: F.when(2 * F.col(c) == n, F.lit(0)).otherwise(F.signum(F.col(c).cast("double")))
    h, k, l = (side(c, n) for c, n in zip(INDICES, shape, strict=True))  # noqa: E741
    a = a.where((l > 0) | ((l == 0) & ((k > 0) | ((k == 0) & (h >= 0)))))
    if cell is not None and dmin > 0:
        a = a.where(inverse_square_distance(cell) <= F.lit(1.0 / dmin**2))
    return a.select(*keys, *INDICES, F.hypot("re", "im").alias("f"), F.degrees(F.atan2("im", "re")).alias("phi"))
