"""Superposition, transforms, grids and interpolation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kabsch(moving: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and both centroids that lay ``moving`` on ``reference`` with least squares."""
    cm, cr = moving.mean(axis=0), reference.mean(axis=0)
    u, _, vt = np.linalg.svd((moving - cm).T @ (reference - cr))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    return vt.T @ flip @ u.T, cm, cr


def superpose(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, mat, com_mov, com_ref, rmsd) from matched positions mx, my, mz and rx, ry, rz."""
    fields = ", ".join([*(f"{g} {pairs.schema[g].dataType.simpleString()}" for g in group), "mat array<double>, com_mov array<double>, com_ref array<double>, rmsd double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, r = pdf[["mx", "my", "mz"]].to_numpy(float), pdf[["rx", "ry", "rz"]].to_numpy(float)
        rot, cm, cr = kabsch(m, r)
        rmsd = float(np.sqrt(((((m - cm) @ rot.T + cr) - r) ** 2).sum(axis=1).mean()))
        out = pdf[list(group)].iloc[:1].copy()
        return out.assign(mat=[rot.ravel().tolist()], com_mov=[cm.tolist()], com_ref=[cr.tolist()], rmsd=rmsd)

    return pairs.groupBy(*group).applyInPandas(run, fields)


def local_alignments(moving: DataFrame, reference: DataFrame, radius: float = 10.0) -> DataFrame:
    """(dtag, residue, mat, ...): each residue laid on the reference by the matched atoms within ``radius``.

    ``moving``: dtag, residue, x, y, z (one atom a residue); ``reference``: residue, x, y, z.
    """
    from outlyr.operators.spatial import range_join

    a = reference.select(F.col("residue"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = reference.select(F.col("residue").alias("other"), *[F.col(c).alias(f"r{c}") for c in "xyz"])
    near = range_join(a, b, radius, ("ax", "ay", "az"), ("rx", "ry", "rz")).select("residue", "other", "rx", "ry", "rz")
    own = moving.select("dtag", F.col("residue").alias("other"), *[F.col(c).alias(f"m{c}") for c in "xyz"])
    return superpose(own.join(near, "other"), ["dtag", "residue"])


def moved(xyz: Sequence[str], mat: str, origin: str, target: str, inverse: bool = False) -> list[Column]:
    """Three columns: positions under a transform, or back under its inverse."""
    o, t = (target, origin) if inverse else (origin, target)
    d = [F.col(c) - F.get(o, F.lit(i)) for i, c in enumerate(xyz)]
    at = lambda i, j: F.get(mat, F.lit(3 * (j if inverse else i) + (i if inverse else j)))
    return [sum((at(i, j) * d[j] for j in range(3)), F.get(t, F.lit(i))) for i in range(3)]


def linear(xyz: Sequence[str], matrix: Sequence[Sequence[float]]) -> list[Column]:
    """Three columns: positions times a 3 x 3 matrix (fractional to orthogonal or back)."""
    return [sum((F.lit(float(m)) * F.col(c) for m, c in zip(row, xyz, strict=True)), F.lit(0.0)) for row in matrix]


def orthogonalisation(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> np.ndarray:
    """The matrix from fractional to Cartesian positions of a unit cell."""
    ca, cb, cg, sg = np.cos(np.radians(alpha)), np.cos(np.radians(beta)), np.cos(np.radians(gamma)), np.sin(np.radians(gamma))
    v = np.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)
    return np.array([[a, b * cg, c * cb], [0, b * sg, c * (ca - cb * cg) / sg], [0, 0, c * v / sg]])


def longest_diagonal(matrix: np.ndarray, shape: Sequence[int]) -> float:
    """The longest diagonal of one grid step, which scales the clustering radius."""
    steps = matrix / np.asarray(shape, float)
    return max(float(np.linalg.norm(steps @ np.array(s))) for s in ((1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1)))


def grid_points_near(positions: DataFrame, radius: float, spacing: float, xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Distinct grid points (u, v, w) within ``radius`` of any position."""
    r = int(np.ceil(radius / spacing))
    a = positions
    for c, g in zip(xyz, "uvw", strict=True):
        a = a.withColumn(g, F.explode(F.sequence(F.floor(F.col(c) / spacing) - r, F.ceil(F.col(c) / spacing) + r)))
    d = sum(((F.col(g) * spacing - F.col(c)) ** 2 for c, g in zip(xyz, "uvw", strict=True)), F.lit(0.0))
    return a.where(d < radius * radius).select("u", "v", "w").distinct()


def box_samples(centres: DataFrame, n: int, spacing: float) -> DataFrame:
    """The n^3 sample positions of a box around each centre (columns kept; i, j, k and sx, sy, sz added)."""
    a = centres
    for c, g in zip("xyz", "ijk", strict=True):
        a = a.withColumn(g, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        a = a.withColumn(f"s{c}", F.col(c) + (F.col(g) - F.lit((n - 1) / 2)) * F.lit(spacing))
    return a


def trilinear(samples: DataFrame, grid: DataFrame, sample: Sequence[str], at: Sequence[str], shape: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """(sample, value): values between grid points; ``at`` are positions in grid units, wrapped round ``shape``.

    ``grid``: u, v, w, value and ``keys``, which say whose grid it is and are columns of ``samples`` too. Eight corners are joined by
    their indices and weighed; where a corner of any weight is missing, the value is null.
    """
    a = samples
    for c, g in zip(at, "uvw", strict=True):
        a = a.withColumn(f"_o{g}", F.explode(F.sequence(F.lit(0), F.lit(1))))
    weight = F.lit(1.0)
    for c, g, n in zip(at, "uvw", shape, strict=True):
        f = F.col(c) - F.floor(c)
        weight = weight * F.when(F.col(f"_o{g}") == 1, f).otherwise(F.lit(1.0) - f)
        a = a.withColumn(g, F.pmod(F.floor(c) + F.col(f"_o{g}"), F.lit(n)).cast("int"))
    a = a.withColumn("_w", weight).where("_w > 0")
    corners = a.join(grid.select(*keys, *[F.col(g).cast("int") for g in "uvw"], F.col("value").alias("_value")), [*keys, "u", "v", "w"], "left")
    read = corners.groupBy(*sample).agg(F.sum(F.col("_w") * F.col("_value")).alias("_sum"), F.count_if(F.col("_value").isNull()).alias("_gaps"))
    return read.select(*sample, F.when(F.col("_gaps") == 0, F.col("_sum")).alias("value"))


def translated(xyz: Sequence[str], shift: Sequence[float]) -> list[Column]:
    """Three columns: positions moved into a cell whose origin is elsewhere."""
    return [F.col(c) + F.lit(float(s)) for c, s in zip(xyz, shift, strict=True)]


def partition_cells(cells: DataFrame, residues: DataFrame, item: str, residue: str, radius: float = 10.0, images: DataFrame | None = None, clear: float = 1.0) -> DataFrame:
    """(item, residue, distance): each grid cell with its nearest residue within ``radius``; cells at ``clear`` or nearer to a symmetry image (ix, iy, iz) are left out.

    ``cells``: item, x, y, z; ``residues``: residue, rx, ry, rz.
    """
    from outlyr.operators.spatial import nearest, range_join

    best = nearest(cells.select(item, "x", "y", "z"), residues, item, residue, radius, right_xyz=("rx", "ry", "rz"))
    if images is None:
        return best
    close = range_join(cells.select(item, "x", "y", "z"), images.select("ix", "iy", "iz"), clear, right_xyz=("ix", "iy", "iz"), strict=False)
    return best.join(close.select(item).distinct(), item, "left_anti")


def aligned_maps(samples: DataFrame, grid: DataFrame, transforms: DataFrame, keys: Sequence[str], cell: str, residue: str, spacing: float, shape: Sequence[int]) -> DataFrame:
    """(keys, cell, value): each dataset's own map read at each cell's place under its residue's transform, between grid points.

    ``samples``: keys, cell, residue, x, y, z; ``transforms``: keys, residue, mat, com_mov, com_ref (moving to reference); ``grid``: those
    of ``keys`` that it has (none: one map for all), u, v, w, value.
    """
    at = samples.join(transforms.select(*keys, residue, "mat", "com_mov", "com_ref"), [*keys, residue])
    back = moved(("x", "y", "z"), "mat", "com_mov", "com_ref", inverse=True)
    placed = at.select(*keys, cell, *[(c / F.lit(float(spacing))).alias(f"_g{n}") for c, n in zip(back, "xyz", strict=True)])
    return trilinear(placed, grid, [*keys, cell], ("_gx", "_gy", "_gz"), shape, [k for k in keys if k in grid.columns])


def dense(mask: DataFrame, sparse: DataFrame, key: str = "cell", value: str = "value") -> DataFrame:
    """All cells of a mask with a sparse map's values, 0 where it has none."""
    return mask.select(key).join(sparse.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def grid_masks(positions: DataFrame, spacing: float, outer: float = 6.0, inner: float = 2.0, atomic: float = 0.5, xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(u, v, w, inner, atomic): grid points within ``outer`` of any position, and whether they are within the smaller radii."""
    r = int(np.ceil(outer / spacing))
    a = positions
    for c, g in zip(xyz, "uvw", strict=True):
        a = a.withColumn(g, F.explode(F.sequence(F.floor(F.col(c) / spacing) - r, F.ceil(F.col(c) / spacing) + r)))
    d = sum(((F.col(g) * spacing - F.col(c)) ** 2 for c, g in zip(xyz, "uvw", strict=True)), F.lit(0.0))
    near = a.where(d < outer * outer).groupBy("u", "v", "w").agg(F.min(d).alias("_d"))
    return near.select("u", "v", "w", (F.col("_d") < inner * inner).alias("inner"), (F.col("_d") < atomic * atomic).alias("atomic"))


def plane_samples(atoms: DataFrame, group: Sequence[str], n: int, spacing: float) -> DataFrame:
    """(group, i, j, sx, sy, sz): an n x n grid through the plane of the two main axes of each group's atoms, round their centre.

    Axes point so that their largest part is positive. Groups are molecules: a few hundred atoms at most.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y", "z"]].to_numpy()
        axes = np.linalg.svd(p - p.mean(axis=0), full_matrices=True)[2][:2]
        axes = np.array([v * np.sign(v[np.abs(v).argmax()]) for v in axes])
        i, j = (k.ravel() for k in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
        at = p.mean(axis=0) + spacing * ((i - (n - 1) / 2)[:, None] * axes[0] + (j - (n - 1) / 2)[:, None] * axes[1])
        out = pd.DataFrame({"i": i, "j": j, "sx": at[:, 0], "sy": at[:, 1], "sz": at[:, 2]})
        for g in reversed(group):
            out.insert(0, g, pdf[g].iloc[0])
        return out

    fields = ", ".join([*(f"{g} {atoms.schema[g].dataType.simpleString()}" for g in group), "i int, j int, sx double, sy double, sz double"])
    return atoms.select(*group, "x", "y", "z").groupBy(*group).applyInPandas(run, fields)
