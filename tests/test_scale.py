"""Steps whose work must not grow faster than their input, against brute force."""

from __future__ import annotations

import random

import numpy as np

from outlyr.operators import filters, graphs, linkage, sites, spatial
from outlyr.sources import molecules



def _sites(sets, shared):
    site = {e: e for e, r in sets.items() if len(r) > shared}
    while True:
        new = {a: min(site[b] for b in site if len(sets[a] & sets[b]) > shared) for a in site}
        if new == site:
            return site
        site = new


def _environment(spark, sets):
    return spark.createDataFrame([(e, r) for e, rs in sets.items() for r in rs], "event long, residue long")


def test_overlap_sites_by_blocks(spark, monkeypatch):
    """Links that no two events' neighbourhood shows are found by blocks; nothing is lost between blocks."""
    monkeypatch.setattr(sites, "BLOCK", 20)
    monkeypatch.setattr(sites, "RESIDUES", 64)
    rng = random.Random(1)
    sets = {e: set(rng.sample(range(200), rng.choice([2, 12, 14]))) for e in range(70)}
    expected = _sites(sets, 3)
    assert 1 < len(set(expected.values())) < len(expected)
    assert {r.event: r.site for r in sites.overlap_components(_environment(spark, sets), 3).collect()} == expected


def test_overlap_sites_without_pairs(spark, monkeypatch):
    """Events of two dense places become two sites without any pair being counted, and repeated rows count once."""
    monkeypatch.setattr(sites, "_block_links", None)
    rng = random.Random(2)
    sets = {e: set(rng.sample(range(e % 2 * 100, e % 2 * 100 + 40), 30)) for e in range(200)}
    env = _environment(spark, sets)
    assert {r.event: r.site for r in sites.overlap_components(env.union(env), 10).collect()} == {e: e % 2 for e in sets}


def _comparators(datasets, residues, hard, soft, buffer, least):
    out = {}
    for t, ref, group, _ in datasets:
        good = sorted((r, m) for m, r, g, f in datasets if g == group and (f or 0) < 0.4 and t in residues and m in residues and residues[t] <= residues[m])
        taken = {m for k, (r, m) in enumerate(good, 1) if r < ref or k <= hard or (k <= soft and r < ref + buffer)}
        out[t] = out.get(t, set()) | taken | {t}
    return {(t, m) for t, ms in out.items() if len(ms) >= least for m in ms}


def test_comparators_rank_members_once(spark, monkeypatch):
    """Members are ranked for space group and residue set, not for each target; groups of any size meet in blocks."""
    monkeypatch.setattr(filters, "TARGETS", 7)
    rng = random.Random(3)
    data = [(f"d{i}", rng.choice([1.0, 1.5, 1.55, 2.0, 2.3]), rng.randrange(3), rng.choice([None, 0.2, 0.5])) for i in range(60)]
    residues = {f"d{i}": set(rng.choice([(1,), (1, 2), (1, 2, 3)])) for i in range(58)}
    schema = "dtag string, resolution double, spacegroup int, rfree double"
    atoms = spark.createDataFrame([(d, r) for d, rs in residues.items() for r in rs], "dtag string, residue int")
    for rows in (data, [*data, ("d1", 2.6, data[1][2], 0.1), ("d2", 1.2, (data[2][2] + 1) % 3, 0.1)]):
        df = spark.createDataFrame(rows, schema)
        for hard, soft, least in ((2, 4, 3), (1, 2, 6), (1, 1, 1)):
            got = [tuple(r) for r in filters.comparators(df, atoms, df, hard, soft, 0.1, 0.4, least).collect()]
            assert len(got) == len(set(got))
            assert set(got) == _comparators(rows, residues, hard, soft, 0.1, least)


def test_comparators_shuffle_no_pairs(spark):
    """Only tables of datasets are shuffled: no exchange, sort or window is above the join that makes the pairs."""
    df = spark.createDataFrame([(f"d{i}", i / 10, 1, 0.1) for i in range(40)], "dtag string, resolution double, spacegroup int, rfree double")
    plan = filters.comparators(df, None, df, 4, 8, 0.1, 0.4, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Distinct" not in plan


def test_nearest_over_blocks_keeps_ties(spark, monkeypatch):
    """What is left out by the product of matrices is never among the k best, also far from the origin and with equal distances."""
    monkeypatch.setattr(spatial, "BLOCK", 9)
    r = np.random.default_rng(4)
    v = np.concatenate((r.integers(0, 3, (40, 3)) + 1e5, r.normal(size=(20, 3)) * 1e-7 + 1e5, np.full((6, 3), 1e5)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(x.item, x["rank"]): (x.neighbour, x.distance) for x in spatial.knn(df, "id", "v", 4).collect()}
    for i, x in enumerate(v):
        d = np.sqrt(((x - v) ** 2).sum(axis=1)).round(9)
        for k, j in enumerate(sorted(range(len(v)), key=lambda j: (d[j], j != i, j))[:4], 1):
            assert got[i, k] == (j, d[j])


def test_equal_graphs_are_matched_once(spark, monkeypatch):
    """Maps are found for distinct graphs alone, and molecules get them under their own names, by broadcast or by shuffle."""
    atoms = spark.createDataFrame([(m, f"{m}-{i}", "C") for m in range(30) for i in range(3)], "m int, atom string, element string")
    bonds = spark.createDataFrame([(m, f"{m}-{i}", f"{m}-{i + 1}", 1) for m in range(30) for i in range(2)], "m int, a string, b string, `order` int")
    seen = []
    walk = graphs._free
    monkeypatch.setattr(graphs, "_free", lambda k: seen.append(k) or walk(k))
    for few in (graphs.FEW_MAPS, 0):
        monkeypatch.setattr(graphs, "FEW_MAPS", few)
        p = graphs.packed(atoms, bonds, ["m"])
        found = graphs.matches(p, p, ["m"])
        got = {tuple(r) for r in found.collect()}
        assert got == {(m, k + 1, f"{m}-{i}", f"{m}-{2 - i if k else i}") for m in range(30) for k in range(2) for i in range(3)}
    assert len(seen) == 6


def test_restraint_files_are_read_once(spark):
    """No join between a file's loops: one shuffle by file, and sulphonates within the row."""
    text = "data_comp_LIG\nloop_\n_chem_comp_atom.atom_id\n_chem_comp_atom.type_symbol\nS1 S\nO1 O\nO2 O\nO3 O\nloop_\n_chem_comp_bond.atom_id_1\n_chem_comp_bond.atom_id_2\n_chem_comp_bond.type\n" + "".join(f"S1 O{i} single\n" for i in (1, 2, 3))
    files = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    atoms, bonds = molecules.restraint_graphs(files, ["id"])
    assert "Join" not in atoms._jdf.queryExecution().optimizedPlan().toString() + bonds._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.b, r.order) for r in bonds.collect()) == [("O1", 2), ("O2", 2), ("O3", 1)]
    assert [r.atom for r in atoms.orderBy("place").collect()] == ["S1", "O1", "O2", "O3"]


def test_a_cloud_without_gaps_is_cut_in_steps(spark, monkeypatch):
    """Centroid linkage of one cloud is that of a single task, though no task gets more than MOST of its points."""
    monkeypatch.setattr(linkage, "MOST", 110)
    p, sizes = np.random.default_rng(5).normal(size=(240, 3)), []
    cut = linkage._cut
    monkeypatch.setattr(linkage, "_cut", lambda apart, group, *rest: sizes.append(linkage._largest(apart, group)) or cut(apart, group, *rest))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(p.tolist())], "i long, x double, y double, z double")
    got = {r.i: r.cluster for r in spatial.linkage_clusters(df, [], "i", 1.2).collect()}
    assert [got[i] for i in range(len(p))] == linkage.flat_clusters(p, 1.2).tolist()
    assert len(sizes) > 1 and max(sizes) <= 110


def _density(rows, eps, least):
    """Density clusters of (g, id, x, y, z), by all pairs."""
    p = np.array([r[2:] for r in rows], float)
    with np.errstate(invalid="ignore"):
        d = (np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) <= eps) & (np.array([r[0] for r in rows])[:, None] == np.array([r[0] for r in rows])[None])
    core, ids = d.sum(1) >= least, [r[1] for r in rows]
    label = {i: ids[i] for i in range(len(rows)) if core[i]}
    while True:
        new = {i: min(label[j] for j in np.flatnonzero(d[i] & core)) for i in label}
        if new == label:
            break
        label = new
    near = {i: [label[j] for j in np.flatnonzero(d[i] & core)] for i in range(len(rows))}
    return {(rows[i][0], ids[i]): label.get(i, min(near[i], default=None)) for i in range(len(rows)) if near[i]}


def _found(spark, rows, eps, least):
    df = spark.createDataFrame(rows, "g int, id long, x double, y double, z double")
    out = spatial.dbscan(df, "id", eps, least, group=["g"]).collect()
    assert len({r.id for r in out}) == len(out)
    return {(r.g, r.id): r.cluster for r in out}


def test_density_clusters_without_pairs(spark, monkeypatch):
    """Rows of all steps stay near the number of points where all points are near each other, with some around them."""
    rng, seen = np.random.default_rng(5), []
    p = np.concatenate((rng.normal(0, 0.1, (400, 3)), rng.normal(0, 0.8, (60, 3))))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    kept = type(df).checkpoint

    def counted(self, *args):
        out = kept(self, *args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(type(df), "checkpoint", counted)
    got = {(0, r.id): r.cluster for r in spatial.dbscan(df, "id", 1.0, 5).collect()}
    assert got == _density([(0, i, *x) for i, x in enumerate(p)], 1.0, 5)
    assert max(seen) < 10 * len(p)  # pairs: more than 160,000


def test_density_clusters_by_cells(spark):
    """Cells, their halves and boxes give what all pairs give: blobs, points at exactly eps, copies, missing positions, several groups."""
    rng = np.random.default_rng(6)
    blobs = [(int(i % 2), int(i), *map(float, x)) for i, x in enumerate(np.concatenate([rng.normal(c, s, (40, 3)) for c, s in ((0, 0.3), (2.2, 0.4), (-3, 1.0), (9, 2.0))]))]
    grid = [(0, 1000 - i, *map(float, x)) for i, x in enumerate(rng.integers(-4, 5, (150, 3)) * 0.25)]
    odd = [(0, 2000, float("nan"), 0.0, 0.0), (0, 2001, None, 0.0, 0.0), (0, 2002, float("inf"), 0.0, 0.0), (1, 2003, 0.0, 0.0, 0.0)]
    whole = [r for r in odd if r[2] is not None]
    for rows, eps, least in ((blobs, 0.75, 1), (blobs, 0.75, 4), (grid, 0.25, 4), (grid, 0.75, 9)):
        assert _found(spark, rows + odd, eps, least) == _density(rows + whole, eps, least), (eps, least)


def test_density_clusters_of_dense_cells_that_halves_do_not_link(spark):
    """Dense cells of which only some points are near, and two dense sheets a little further apart than eps."""
    rng = np.random.default_rng(7)
    ends = [(0, 10 * k + i, 0.9 * k + 0.01 * i, 0.0, 0.0) for k in range(5) for i in range(10)]
    near = [(1, 100 + i, *x, 0.0) for i, x in enumerate(rng.uniform(0, 1.5, (150, 2)).tolist())]
    far = [(1, 300 + i, *x, 1.001) for i, x in enumerate(rng.uniform(0, 1.5, (150, 2)).tolist())]
    # of the last two cells, whose boxes are near, only one pair of points is within eps
    bent = [(2, 500 + i, 0.01 * i, 0.5 if i == 9 else 0.0, 0.0) for i in range(10)] + [(2, 600 + i, 1.05 + 0.01 * i, 0.55 if i == 0 else 0.0, 0.0) for i in range(10)]
    for more in ([], [(1, 900, 0.7, 0.7, 0.5)]):
        rows = ends + near + far + bent + more
        assert _found(spark, rows, 1.0, 5) == _density(rows, 1.0, 5)


def test_colours_are_taken_of_distinct_graphs(spark, monkeypatch):
    """Colours are not moved below the step that finds distinct graphs, to all molecules."""
    plans, base = [], type(spark.range(1))
    kept = base.checkpoint
    monkeypatch.setattr(base, "checkpoint", lambda self, *args: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or kept(self, *args))
    atoms = spark.createDataFrame([(m, i, "C") for m in range(4) for i in range(3)], "m int, atom int, element string")
    bonds = spark.createDataFrame([(m, i, i + 1, 1) for m in range(4) for i in range(2)], "m int, a int, b int, `order` int")
    p, q = graphs.packed(atoms, bonds, ["m"]), graphs.packed(atoms, bonds, ["m"])
    for other in (p, q):
        assert graphs.matches(p, other, ["m"]).count() == 4 * 2 * 3
    assert any("xxhash64" in x for x in plans) and not any("xxhash64" in x and "Aggregate" in x for x in plans)


def test_restraint_files_are_read_within_their_rows(spark):
    """Nothing is shuffled, also where a file has several blocks and loops; values are found whatever their quotes."""
    text = "data_comp_XXX\nloop_\n_chem_comp_atom.atom_id\nX\ndata_comp_LIG\nloop_\n_chem_comp_bond.atom_id_1\n_chem_comp_bond.atom_id_2\n_chem_comp_bond.type\n'A 1' \"B'\" double\nloop_\n_chem_comp_atom.type_symbol\n_chem_comp_atom.atom_id\ncl 'A 1'\nn \"B'\"\n? .\n"
    files = spark.createDataFrame([(1, text), (2, None), (3, "data_comp_LIG\nloop_\n_chem_comp_atom.atom_id\nC\n")], "id int, text string")
    atoms, bonds = molecules.restraint_graphs(files, ["id"])
    assert [tuple(r) for r in atoms.orderBy("id", "place").collect()] == [(1, 0, "A 1", "Cl", 0), (1, 1, "B'", "N", 0), (3, 0, "C", None, 0)]
    assert [tuple(r) for r in bonds.collect()] == [(1, "A 1", "B'", 2)]
    for df in (atoms, bonds):
        plan = df._jdf.queryExecution()
        assert "Exchange" not in plan.executedPlan().toString() and "Aggregate" not in plan.optimizedPlan().toString()


def test_overlap_sites_meet_in_blocks_first(spark, monkeypatch):
    """Events of one site that no neighbourhood at a residue shows are put together block by block, before all pairs of blocks are counted."""
    monkeypatch.setattr(sites, "BLOCK", 60)
    rng, left = random.Random(8), []
    sets = {e: set(rng.sample(range(300), 40)) for e in range(240)}
    expected = _sites(sets, 8)
    assert len(set(expected.values())) < 20
    block = sites._block_links
    monkeypatch.setattr(sites, "_block_links", lambda rows, shared: left.append(rows.select("site").distinct().count()) or block(rows, shared))
    assert {r.event: r.site for r in sites.overlap_components(_environment(spark, sets), 8).collect()} == expected
    assert left and left[0] < 40
