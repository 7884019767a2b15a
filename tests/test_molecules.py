"""Molecules from restraint files and SMILES: known graphs, quotes and comments, and texts that are neither."""

from pyspark.sql import functions as F

from outlyr.operators import graphs
from outlyr.sources import molecules

CIF = """data_comp_list
loop_
_chem_comp.id
_chem_comp.name
LIG 'it''s a name'
data_comp_LIG
#
loop_
_chem_comp_atom.comp_id
_chem_comp_atom.atom_id
_chem_comp_atom.type_symbol
_chem_comp_atom.charge
LIG S1 S 0   # sulphur
LIG "O1'" O 0
LIG O2 O .
LIG 'O 3' O -1
LIG CL1 CL 0
LIG C1 C 0.6
loop_
_chem_comp_bond.comp_id
_chem_comp_bond.atom_id_1
_chem_comp_bond.atom_id_2
_chem_comp_bond.type
_chem_comp_bond.aromatic
LIG S1 "O1'" single n
LIG O2 S1 SINGLE n
LIG S1 'O 3' single n
LIG S1 C1 deloc n
LIG C1 CL1 single y
_tail.value 3
LIG C1 O2 odd n
"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_restraints(spark):
    other = CIF.replace("comp_LIG", "comp_XXX").replace("O2 S1 SINGLE", "O2 S1 triple")
    texts = [("x", CIF), ("y", other), ("none", "data_comp_ABC\nloop_\n_chem_comp_atom.atom_id\nC1\n"), ("null", None), ("empty", ""), ("cut", "data_comp_LIG\nloop_\n_chem_comp_atom.atom_id\n")]
    df = spark.createDataFrame(texts, "mol string, text string")
    atoms, bonds = molecules.restraint_graphs(df, ["mol"])
    own = [(0, "S1", "S", 0), (1, "O1'", "O", 0), (2, "O2", "O", 0), (3, "O 3", "O", -1), (4, "CL1", "Cl", 0), (5, "C1", "C", 1)]
    assert rows(atoms) == [("x", *a) for a in own] + [("y", *a) for a in own]
    same = [("S1", "O 3", 1), ("S1", "C1", 1), ("C1", "CL1", 4)]
    want = [("x", *b) for b in [*same, ("S1", "O1'", 2), ("O2", "S1", 2)]] + [("y", *b) for b in [*same, ("S1", "O1'", 1), ("O2", "S1", 3)]]
    assert rows(bonds) == sorted(want)
    fields = molecules.loop_rows(df.where("mol = 'x'"), ["mol"]).where("block = 'comp_list'").first()
    assert (fields.loop, fields.row, fields.fields["_chem_comp.name"]) == (0, 0, "it''s a name")


SMILES = {
    "benzene": ("c1ccccc1", "CCCCCC", {4: 6}, 12),
    "cyclohexane": ("C1CCCCC%01 ring", "CCCCCC", {1: 6}, 12),
    "acid": ("CC(=O)[O-]", "CCOO", {1: 2, 2: 1}, 1),
    "biphenyl": ("c1ccccc1-c1ccccc1", "C" * 12, {4: 12, 1: 1}, 8),
    "salt": ("[Na+].[Cl-]", ["Na", "Cl"], {}, 1),
    "nitrile": ("N#CC(Br)(Cl)F", ["N", "C", "C", "Br", "Cl", "F"], {3: 1, 1: 4}, 1),
    "ring": ("C=1CC=1", "CCC", {2: 1, 1: 2}, 2),
    "chiral": ("N[C@@H](C)C(=O)O", "NCCCOO", {1: 4, 2: 1}, 1),
}
FAULTS = {"open": "C1CC", "branch": "C(C", "close": "CC)", "sign": "CC=", "letters": "CXq", "self": "C11", "twice": "C12CC12C1", "clash": "C=1CC#1", "first": "=C"}


def test_smiles(spark):
    texts = [(k, v[0]) for k, v in SMILES.items()] + list(FAULTS.items()) + [("null", None), ("blank", "  ")]
    atoms, bonds, faults = molecules.smiles_graphs(spark.createDataFrame(texts, "mol string, text string"), ["mol"])
    atoms, bonds = atoms.cache(), bonds.cache()
    got = {}
    for r in atoms.orderBy("mol", "atom").collect():
        got.setdefault(r.mol, []).append(r.element)
    assert got == {k: list(v[1]) for k, v in SMILES.items()}
    orders = {k: {} for k in SMILES}
    for r in bonds.collect():
        orders[r.mol][r.order] = orders[r.mol].get(r.order, 0) + 1
    assert orders == {k: v[2] for k, v in SMILES.items()}
    assert {(r.mol, r.charge) for r in atoms.where("charge <> 0").collect()} == {("acid", -1), ("salt", 1), ("salt", -1)}
    assert {r.mol for r in faults.collect()} == set(FAULTS)
    m = graphs.packed(atoms, bonds, ["mol"])
    found = {r.mol: r.n for r in graphs.matches(m, m, ["mol"]).groupBy("mol").agg(F.countDistinct("match").alias("n")).collect()}
    assert found == {k: v[3] for k, v in SMILES.items()}
