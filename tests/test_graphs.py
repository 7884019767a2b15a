"""Matches of molecular graphs against a permutation search, and known numbers of symmetries."""

import math
from itertools import permutations

from outlyr.operators import graphs, structures

ATOMS, BONDS = "mol string, atom int, element string, extra int", "mol string, a int, b int, order int"


def pack(spark, mols, shift=0):
    atoms = [(m, i + shift, e, 0) for m, (kinds, _) in mols.items() for i, e in enumerate(kinds)]
    bonds = [(m, a + shift, b + shift, o) for m, (_, bs) in mols.items() for a, b, o in bs]
    return graphs.packed(spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS), ["mol"])


def brute(kinds, bonds):
    order = {frozenset((a, b)): o for a, b, o in bonds}
    n = len(kinds)
    keep = lambda p: all(order.get(frozenset((i, j))) == order.get(frozenset((p[i], p[j]))) for i in range(n) for j in range(i))
    return {p for p in permutations(range(n)) if all(kinds[i] == kinds[p[i]] for i in range(n)) and keep(p)}


MOLS = {
    "ring": ("CCCCCC", [(i, (i + 1) % 6, 1) for i in range(6)]),
    "alternating": ("CCCCCC", [(i, (i + 1) % 6, 1 + i % 2) for i in range(6)]),
    "star": ("CHHHH", [(0, i, 1) for i in range(1, 5)]),
    "chain": ("CCON", [(0, 1, 1), (1, 2, 2), (2, 3, 1)]),
    "apart": ("CCCC", [(0, 1, 1), (2, 3, 1)]),
    "unlike": ([None, "C", None], [(0, 1, 1), (1, 2, 1)]),
    "one": ("C", []),
    "triangles": ("CCCCCC", [(0, 1, 1), (1, 2, 1), (2, 0, 1), (3, 4, 1), (4, 5, 1), (5, 3, 1)]),
}


def maps(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.mol, r.match), {})[r.atom] = r.to
    return out


def test_symmetries(spark):
    m = pack(spark, MOLS)
    got = maps(graphs.matches(m, m, ["mol"]))
    for name, (kinds, bonds) in MOLS.items():
        own = [tuple(v[i] for i in range(len(kinds))) for (k, _), v in sorted(got.items()) if k == name]
        assert own == sorted(brute(kinds, bonds))
    assert sum(k == "ring" for k, _ in got) == 12 and sum(k == "star" for k, _ in got) == 24 and sum(k == "chain" for k, _ in got) == 1


def test_other_graphs_and_defects(spark):
    """Renumbered atoms match; equal colours alone do not; doubled, turned and dangling bonds do no harm; an empty table gives none."""
    a = pack(spark, {"x": MOLS["chain"], "y": MOLS["ring"], "z": MOLS["chain"]})
    b = pack(spark, {"x": ("NOCC", [(0, 1, 1), (2, 1, 2), (1, 2, 1), (2, 3, 1), (3, 3, 1), (3, 9, 1)]), "y": MOLS["triangles"], "z": ("CCOO", MOLS["chain"][1])}, 10)
    assert maps(graphs.matches(a, b, ["mol"])) == {("x", 1): {0: 13, 1: 12, 2: 11, 3: 10}}
    assert graphs.matches(a.limit(0), b, ["mol"]).count() == 0


def test_longest_walk_and_least_deviation(spark):
    """A ring of 40 atoms has 80 symmetries, of which the deviation takes the one that was planted."""
    n = 40
    ring = {"r": ("C" * n, [(i, (i + 1) % n, 1) for i in range(n)])}
    m = pack(spark, ring)
    found = graphs.matches(m, m, ["mol"])
    assert found.count() == 80 * n
    at = lambda i: (math.cos(2 * math.pi * i / n) * (1 + i / n), math.sin(2 * math.pi * i / n), 0.1 * i)
    a = spark.createDataFrame([("r", i, *at(i)) for i in range(n)], "mol string, atom int, x double, y double, z double")
    b = spark.createDataFrame([("r", (7 - i) % n, *at(i)) for i in range(n)], "mol string, atom int, x double, y double, z double")
    best = structures.symmetric_deviation(a, b, found, ["mol"], "atom").first()
    assert best.rmsd < 1e-9
    assert {r.atom: r.to for r in found.where(found.match == best.match).collect()} == {i: (7 - i) % n for i in range(n)}
