"""Joins and aggregates over atoms: matching residues, crops, masks, contacts, closest hits and deviations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlyr.operators.spatial import XYZ, distance, nearest, range_join

RESIDUE = ("model", "chain", "seq_id")


def first_atoms(atoms: DataFrame, keys: Sequence[str] = ("dtag", *RESIDUE), order: str = "atom_no") -> DataFrame:
    """The first atom of each residue, by position in the file."""
    own = F.struct(order, *[c for c in atoms.columns if c not in (*keys, order)])
    return atoms.groupBy(*keys).agg(F.min_by(own, F.col(order)).alias("_a")).select(*keys, "_a.*")


def matched_residues(moving: DataFrame, reference: DataFrame, keys: Sequence[str] = RESIDUE) -> DataFrame:
    """Pairs of positions (mx.., rx..) of residues that both structures have."""
    m = moving.select(*[c for c in ("dtag",) if c in moving.columns], *keys, *[F.col(c).alias(f"m{c}") for c in XYZ])
    return m.join(reference.select(*keys, *[F.col(c).alias(f"r{c}") for c in XYZ]), list(keys))


def _other(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"_o{c}") for c in XYZ])


_OTHER = tuple(f"_o{c}" for c in XYZ)


def within(points: DataFrame, of: DataFrame, item: str, radius: float) -> DataFrame:
    """Points nearer than ``radius`` to any of a set (a painted mask)."""
    hit = range_join(points.select(item, *XYZ), _other(of), radius, right_xyz=_OTHER).select(item).distinct()
    return points.join(hit, item, "left_semi")


def without(points: DataFrame, of: DataFrame, item: str, radius: float) -> DataFrame:
    """Points not nearer than ``radius`` to any of a set (a crop)."""
    hit = range_join(points.select(item, *XYZ), _other(of), radius, right_xyz=_OTHER).select(item).distinct()
    return points.join(hit, item, "left_anti")


def masked(cells: DataFrame, atoms: DataFrame, item: str = "cell", value: str = "value", radius: float = 1.5) -> DataFrame:
    """Cells with the values near known atoms set to 0."""
    hit = range_join(cells.select(item, *XYZ), _other(atoms), radius, right_xyz=_OTHER).select(item).distinct().withColumn("_hit", F.lit(True))
    return cells.join(hit, item, "left").withColumn(value, F.when(F.col("_hit"), F.lit(0.0)).otherwise(F.col(value))).drop("_hit")


def in_box(xyz: Sequence[str], low: Sequence[float], high: Sequence[float], margin: float = 6.0) -> Column:
    """Whether a position lies in a box with a margin: a cheap test before distances."""
    out = F.lit(True)
    for c, a, b in zip(xyz, low, high, strict=True):
        out = out & F.col(c).between(a - margin, b + margin)
    return out


def probe_points(atoms: DataFrame, item: str, corner: float = 1.5, clear: float = 1.4) -> DataFrame:
    """(item, px, py, pz): the corners of a cube around each atom that keep clear of all atoms."""
    a = atoms.select(item, *XYZ)
    for c in XYZ:
        a = a.withColumn(f"p{c}", F.explode(F.array(F.col(c) - F.lit(corner), F.col(c) + F.lit(corner))))
    a = a.drop(*XYZ).withColumn("_k", F.monotonically_increasing_id())
    near = range_join(a, _other(atoms), clear, ("px", "py", "pz"), _OTHER).select("_k").distinct()
    return a.join(near, "_k", "left_anti").drop("_k")


def hit_distances(known: DataFrame, events: DataFrame, hit: str, event: str, on: Sequence[str], radius: float) -> DataFrame:
    """Each known hit with its closest event of the same dataset; null where none is within ``radius``."""
    e = events.select(*on, event, *[F.col(c).alias(f"_o{c}") for c in XYZ])
    best = nearest(known.select(*on, hit, *XYZ), e, hit, event, radius, right_xyz=_OTHER, on=on)
    return known.select(*on, hit).join(best, [*on, hit], "left")


def matched_deviation(a: DataFrame, b: DataFrame, group: Sequence[str], atom: str) -> DataFrame:
    """(group, rmsd): root mean square distance of atoms of the same name."""
    pairs = a.select(*group, atom, *XYZ).join(b.select(*group, atom, *[F.col(c).alias(f"_o{c}") for c in XYZ]), [*group, atom])
    d = distance(XYZ, _OTHER)
    return pairs.withColumn("_d", d).groupBy(*group).agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmsd"))


def closest_deviation(a: DataFrame, b: DataFrame, group: Sequence[str], atom: str) -> DataFrame:
    """(group, rmsd): root mean square, over a's atoms, of the distance to b's closest atom of the group."""
    pairs = a.select(*group, atom, *XYZ).join(b.select(*group, *[F.col(c).alias(f"_o{c}") for c in XYZ]), list(group))
    least = pairs.withColumn("_d", distance(XYZ, _OTHER)).groupBy(*group, atom).agg(F.min("_d").alias("_d"))
    return least.groupBy(*group).agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmsd"))


def concatenated(tables: dict[str, DataFrame], column: str = "system") -> DataFrame:
    """Tables of several systems in one, with the system's name."""
    from functools import reduce

    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [t.withColumn(column, F.lit(k)) for k, t in tables.items()])


def merged_structures(atoms: DataFrame, ligands: DataFrame, dataset: str = "dtag", order: str = "atom_no") -> DataFrame:
    """``atoms`` with each dataset's chosen ligand added to the first chain of its first model, as residue max + 100.

    First is by ``order``. Both tables have dataset, seq_id and the atoms' other columns; a ligand's own
    model, chain and seq_id are replaced. Ligands of datasets without atoms go nowhere.
    """
    chains = atoms.groupBy(dataset, "model", "chain").agg(F.min(order).alias("_o"), (F.max("seq_id") + 100).alias("seq_id"))
    first = chains.groupBy(dataset).agg(F.min_by(F.struct("model", "chain", "seq_id"), "_o").alias("_f"))
    placed = ligands.drop("model", "chain", "seq_id").join(first, dataset).select("*", "_f.model", "_f.chain", "_f.seq_id").drop("_f")
    return atoms.unionByName(placed, allowMissingColumns=True)


def symmetric_deviation(a: DataFrame, b: DataFrame, matches: DataFrame, group: Sequence[str], atom: str) -> DataFrame:
    """(group, match, rmsd): the least deviation over the symmetry matches of a molecule.

    ``matches`` has match, ``atom`` and to: one row for each atom of a's that a match sends to an atom of b's;
    it is as long as a molecule has atoms and matches. Equal deviations count for the least match.
    """
    other = b.select(*group, F.col(atom).alias("to"), *[F.col(c).alias(f"_o{c}") for c in XYZ])
    pairs = a.select(*group, atom, *XYZ).join(matches.select("match", atom, "to", *[g for g in group if g in matches.columns]), [atom, *[g for g in group if g in matches.columns]]).join(other, [*group, "to"])
    d = distance(XYZ, _OTHER)
    each = pairs.groupBy(*group, "match").agg(F.sqrt(F.avg(d * d)).alias("rmsd"))
    best = F.min(F.struct("rmsd", "match")).alias("_b")
    return each.groupBy(*group).agg(best).select(*group, "_b.match", "_b.rmsd")


def calibrated(records: DataFrame, build: Sequence[str], tie: Sequence[str], deviation: str = "rmsd") -> DataFrame:
    """Of each build's ``records`` (one for each ligand and known hit) the one of least deviation; builds without any have none."""
    rest = [c for c in records.columns if c not in build]
    order = F.struct(F.col(deviation), *[F.col(c) for c in tie])
    best = records.where(F.col(deviation).isNotNull()).groupBy(*build).agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return best.select(*build, "_b.*")
