"""Molecular graphs: colour refinement and all matches of two graphs, extended atom by atom.

A molecule is one row, so that no step but the first two shuffles. It holds atoms in ascending order, their kinds and
its bonds in one order, so that equal graphs are equal rows. Distinct graphs alone are matched, by a flat matrix of bond
orders: its size is the square of a molecule's atoms, a hundred or so, and not of the table's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyr.operators.spatial import ensure_checkpoints

#: Atoms that are matched between two cuts of the lineage.
STEPS = 8
#: Up to so many maps of distinct graphs are broadcast to their molecules; more are joined by shuffle.
FEW_MAPS = 100_000


def _below(n: Column) -> Column:
    """The numbers from 0 to n - 1; none where n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def packed(atoms: DataFrame, bonds: DataFrame, key: Sequence[str], atom: str = "atom", kind: str = "element") -> DataFrame:
    """(key, atoms, kinds, bonds): one row a molecule; a bond is its cell x in the upper half of the matrix and its order o.

    ``bonds`` has key, a, b and order, in either direction; a bond of an atom with itself or to a missing atom is left
    out, and of several between the same atoms the highest order counts. Atoms have distinct names within a
    molecule. A null kind is one of its own.
    """
    listed = atoms.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(atom).alias("atom"), F.col(kind).cast("string").alias("kind")))).alias("_l"))
    listed = listed.select(*key, F.col("_l.atom").alias("atoms"), F.col("_l.kind").alias("kinds"))
    drawn = bonds.where("a <> b").groupBy(*key).agg(F.collect_list(F.struct("a", "b", F.col("order").cast("int").alias("order"))).alias("ends"))
    return packed_rows(listed.join(drawn, list(key), "left"), key)


def packed_rows(molecules: DataFrame, key: Sequence[str]) -> DataFrame:
    """``packed`` of rows that hold a molecule already: key, atoms in ascending order, their kinds, and ends, an array of bonds (a, b, order) or null."""
    n = F.size("atoms")
    place = lambda c: (F.array_position("atoms", c) - 1).cast("int")
    ends = F.transform("ends", lambda e: F.struct(place(e["a"]).alias("i"), place(e["b"]).alias("j"), e["order"].alias("o")))
    known = F.filter(ends, lambda e: (e["i"] >= 0) & (e["j"] >= 0) & (e["i"] != e["j"]) & (e["o"] != 0))
    cells = F.transform(known, lambda e: F.struct(F.when(e["i"] < e["j"], e["i"] * n + e["j"]).otherwise(e["j"] * n + e["i"]).alias("x"), e["o"].alias("o")))
    # cells are made and sorted once a molecule, as the element of an array; the first of a place has its highest order
    first = lambda s: F.filter(s, lambda c, k: (k == 0) | (c["x"] != F.get(s, k - 1)["x"]))
    once = F.get(F.transform(F.array(F.sort_array(cells, asc=False)), first), F.lit(0))
    return molecules.select(*key, "atoms", "kinds", F.coalesce(once, F.expr("CAST(array() AS array<struct<x: int, o: int>>)")).alias("bonds"))


def _matrix(kinds: str, bonds: str) -> Column:
    """The flat matrix of bond orders, 0 where there is none."""
    n, cells = F.size(kinds), F.col(bonds)

    def order(x: Column) -> Column:
        i, j = F.floor(x / n).cast("int"), x % n
        at = F.array_position(cells["x"], F.least(i, j) * n + F.greatest(i, j))
        return F.coalesce(F.get(cells["o"], (at - 1).cast("int")), F.lit(0))

    return F.transform(_below(n * n), order)


def colours() -> Column:
    """An atom's colour for each atom of kinds and the flat matrix of bonds: atoms that a match can exchange have the same one.

    An atom's next colour is made of its own and those of its neighbours by bond order; as many rounds as atoms let every difference
    reach every atom.
    """
    n = F.size("kinds")

    def around(c: Column, i: Column) -> Column:
        bond = lambda j: F.get(F.col("bonds"), i * n + j)
        seen = F.transform(F.filter(_below(n), lambda j: bond(j) != 0), lambda j: F.xxhash64(bond(j), F.get(c, j)))
        return F.xxhash64(F.get(c, i), F.array_sort(seen))

    first = F.transform("kinds", lambda k: F.xxhash64(k, k.isNull()))
    return F.aggregate(_below(n), first, lambda c, _: F.transform(_below(n), lambda i: around(c, i)))


def _walk() -> Column:
    """Places of all atoms in an order in which each is bonded to an earlier one wherever the graph allows it."""
    n = F.size("kinds")

    def further(done: Column, _: Column) -> Column:
        rest = F.filter(_below(n), lambda i: ~F.array_contains(done, i))
        bonded = F.filter(rest, lambda i: F.exists(done, lambda d: F.get(F.col("bonds"), i * n + d) != 0))
        return F.concat(done, F.slice(F.when(F.size(bonded) > 0, bonded).otherwise(rest), 1, 1))

    return F.aggregate(_below(n), F.array().cast("array<int>"), further)


def _free(k: int) -> Column:
    """Places of b's that the k-th atom of the walk can take: of its colour, not taken, with the same bonds to those before."""
    n, here = F.col("_n"), F.get("_walk", F.lit(k))

    def fits(t: Column) -> Column:
        alike = F.zip_with(F.slice("_walk", 1, k), "_map", lambda o, m: F.get("bonds", here * n + o) == F.get("_bonds", t * n + m))
        return (F.get("_cb", t) == F.get("_ca", here)) & ~F.array_contains("_map", t) & F.forall(alike, lambda x: x)

    return F.filter(_below(n), fits)


def matches(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, match, atom, to): every one-to-one map of a's atoms to b's that keeps kinds and bond orders, numbered from 1.

    The rows of ``maps``, one an atom, which ``structures.symmetric_deviation`` takes.
    """
    pairs = F.zip_with("atoms", "to", lambda x, y: F.struct(x.alias("atom"), y.alias("to")))
    return maps(a, b, key).select(*key, "match", F.explode(pairs).alias("_p")).select(*key, "match", "_p.atom", "_p.to")


def maps(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, match, atoms, to): every one-to-one map of a's atoms to b's that keeps kinds and bond orders, numbered from 1, as images along a's atoms.

    ``a`` and ``b`` are ``packed`` molecules, joined by ``key``; the same table twice gives a molecule's symmetries. Maps are rows,
    extended by one atom a step to the atoms of the same colour that keep all bonds to the atoms before; steps are
    as many as the largest molecule has atoms. Molecules of equal kinds and bonds have the same maps of places, which are
    found once for all of them. Maps are numbered in the order of their images along a's atoms. Molecules that do not match
    have no rows. There are as many rows as maps: k equal atoms without bonds have k! of them.
    """
    ensure_checkpoints(a.sparkSession)
    own = a.select(*key, "atoms", "kinds", "bonds")
    if a is b:
        graph, both = ["kinds", "bonds"], own.withColumn("_to", F.col("atoms"))
    else:
        graph = ["kinds", "bonds", "_kinds", "_bonds"]
        both = own.join(b.select(*key, F.col("atoms").alias("_to"), F.col("kinds").alias("_kinds"), F.col("bonds").alias("_bonds")), list(key))
        both = both.where(F.size("kinds") == F.size("_kinds"))
    # cut here, or the filter by colours is moved below distinct(), to all molecules
    rows = both.where(F.size("kinds") > 0).select(*graph).distinct().checkpoint()
    side = lambda df, kinds, bonds: df.withColumns({"kinds": F.col(kinds), "bonds": _matrix(kinds, bonds)})
    rows = side(rows.select(F.struct(*graph).alias("_graph"), *graph), "kinds", "bonds").checkpoint()
    rows = rows.withColumn("_n", F.size("kinds")).withColumn("_walk", _walk()).withColumn("_ca", colours()).withColumnRenamed("bonds", "_own").checkpoint()
    if a is b:
        rows = rows.withColumns({"bonds": F.col("_own"), "_cb": F.col("_ca")})
    else:
        rows = side(rows, "_kinds", "_bonds").checkpoint().withColumn("_cb", colours()).checkpoint()
        rows = rows.where(F.array_sort("_ca") == F.array_sort("_cb"))
    rows = rows.select("_graph", "_n", "_walk", "_ca", "_cb", F.col("_own").alias("bonds"), F.col("bonds").alias("_bonds"), F.array().cast("array<int>").alias("_map"))
    most = rows.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("n")).first().n
    n = F.col("_n")
    for k in range(most):
        rows = rows.withColumn("_map", F.explode(F.when(n > k, F.transform(_free(k), lambda t: F.concat("_map", F.array(t)))).otherwise(F.array("_map"))))
        if k % STEPS == STEPS - 1:
            rows = rows.checkpoint()
    along = F.transform(_below(n), lambda i: F.get("_map", (F.array_position("_walk", i) - 1).cast("int")))
    found = rows.select("_graph", along.alias("_map")).withColumn("match", F.row_number().over(Window.partitionBy("_graph").orderBy("_map"))).select("_graph.*", "_map", "match").checkpoint()
    few = F.broadcast(found) if found.count() <= FEW_MAPS else found
    return both.join(few, graph).select(*key, "match", "atoms", F.transform("_map", lambda t: F.get("_to", t)).alias("to"))
