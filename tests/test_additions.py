"""Operators beyond former bounds, distributed forms against plain ones, and the files that sinks and readers share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlyr.operators import events, filters, geometry, ranking, sites, spatial
from outlyr.sources import inputs, outputs


def test_interpolation_on_more_knots_than_ten_thousand(spark):
    r = np.random.default_rng(3)
    x = np.sort(r.uniform(0, 100, 10_001))
    p = np.sort(r.uniform(0, 1, 10_001))
    table = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, p, strict=True)] + [(float(x[7]), 0.0)], "x double, p double").repartition(3)
    at = [-5.0, 0.0, float(x[0]), float(x[-1]), 200.0, None, *r.uniform(-1, 101, 300).tolist(), *x[100:110].tolist()]
    df = spark.createDataFrame(list(enumerate(at)), "id long, value double")
    for t in (table, table.limit(0)):
        got = {row.id: row.p for row in ranking.interpolate_table(df, "value", t).collect()}
        assert len(got) == len(at)
        for i, v in enumerate(at):
            if v is None or t is not table:
                assert got[i] is None
            else:
                assert got[i] == pytest.approx(np.interp(v, x, p), abs=1e-9)


def test_symmetry_operators_are_counted(spark):
    names = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)] + ["t1", "t2", "t3"]
    ops = lambda n: spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, k / n, 0.0, 0.0) for k in range(n)], ", ".join(f"{c} double" for c in names))
    one = spark.createDataFrame([(1, 0.5, 0.5, 0.5)], "id long, x double, y double, z double")
    assert spatial.images(one, ops(192)).count() == 192 * 27
    with pytest.raises(ValueError, match="no space group"):
        spatial.images(one, ops(193))


def test_every_item_contains_an_empty_reference(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "item long, key string")
    wanted = lambda df: sorted(r.item for r in filters.containing(pairs, df, "item", "key").collect())
    assert wanted(pairs.limit(0)) == [1, 2] and wanted(pairs.where("item = 1")) == [1] and wanted(pairs.where("key = 'b'")) == [1, 2]


def plain_linkage(points, t, linkage):
    """Merge the nearest two until one is left; cut below the largest height."""
    p = np.asarray(points, float)
    groups, tops = [[i] for i in range(len(p))], [0.0] * len(p)
    parts, done = {i: None for i in range(len(p))}, []
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = p[groups[i]], p[groups[j]]
                d = np.linalg.norm(a.mean(0) - b.mean(0)) if linkage == "centroid" else max(np.linalg.norm(x - y) for x in a for y in b)
                if best is None or d < best[0]:
                    best = (d, i, j)
        d, i, j = best
        top = max(d, tops[i], tops[j])
        if top > t:
            done += [g for k, g in enumerate((groups[i], groups[j])) if (tops[i], tops[j])[k] <= t and g not in done]
        groups[i], tops[i] = groups[i] + groups[j], top
        del groups[j], tops[j]
    done += [g for g, top in zip(groups, tops, strict=True) if top <= t]
    return parts and sorted(map(sorted, done))


def test_linkage_is_the_plain_one():
    r = np.random.default_rng(8)
    for linkage in ("centroid", "complete"):
        for n in (1, 2, 5, 25):
            p = r.normal(0, 1, (n, 3))
            for t in (0.0, 0.6, 1.2, 9.0):
                label = spatial.centroid_clusters(p, t, linkage)
                assert sorted(sorted(np.flatnonzero(label == c).tolist()) for c in set(label)) == plain_linkage(p, t, linkage)
    chain = np.array([[float(i), 0, 0] for i in range(3000)])  # deep trees need no recursion
    assert len(set(spatial.centroid_clusters(chain, 1e9))) == 1


def test_neighbours_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = r.normal(0, 1, (60, 5)).round(1)
    v[7] = v[9]
    df = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "id long, label int, e array<float>")
    for block in (7, 1000):
        monkeypatch.setattr(spatial, "BLOCK", block)
        got = {(x.item, x.rank): x.neighbour for x in spatial.knn(df, "id", "e", 4, ["label"]).collect()}
        for i in range(60):
            same = [j for j in range(60) if j % 2 == i % 2]
            d = {j: round(float(np.linalg.norm(v[i].astype("f4").astype(float) - v[j].astype("f4").astype(float))), 9) for j in same}
            assert [got[i, k] for k in (1, 2, 3, 4)] == sorted(same, key=lambda j: (d[j], j != i, j))[:4]


def test_comparators_without_residues(spark):
    d = spark.createDataFrame([(f"d{i}", 1.0 + i / 10, "P1" if i < 8 else "P2", 0.2 if i % 3 else None) for i in range(12)], "dtag string, resolution double, spacegroup string, rfree double")
    got = {(r.target, r.member) for r in filters.comparators(d, None, d, 3, 4, 0.15, 0.4, 3).collect()}
    assert {m for t, m in got if t == "d0"} == {"d0", "d1", "d2"} and all((t, t) in got for t, _ in got)
    res = spark.createDataFrame([(f"d{i}", k) for i in range(12) for k in range(2 if i == 1 else 3)], "dtag string, residue int")
    got = {(r.target, r.member) for r in filters.comparators(d, res, d, 3, 4, 0.15, 0.4, 1).collect()}
    assert ("d0", "d1") not in got and ("d1", "d0") in got


def test_builds_and_structures_are_read_back(spark, tmp_path):
    rows = [("d1", 1, "/b/1.pdb", "lig", 0.5, 1.0, 2.0, 3.0, 0.1), ("d2", 1, "/b/2.pdb", "lig", 0.7, 1.0, 2.0, 3.0, 0.2)]
    b = spark.createDataFrame(rows, "dtag string, event_idx int, path string, ligand_key string, score double, x double, y double, z double, bdc double")
    at = outputs.layout(f"file://{tmp_path}", "d1")["builds"].rsplit("/", 1)[0]
    outputs.write_builds(b, at)
    outputs.write_builds(b.where("dtag = 'd1'").withColumn("score", F.lit(0.9)), at)
    assert {(r.dtag, r.score) for r in inputs.read_builds(spark, at).collect()} == {("d1", 0.9), ("d2", 0.7)} and inputs.read_builds(spark, at, "d2").count() == 1
    a = spark.createDataFrame([("d1", 1, "CA", "GLY", "A", "7", "", 1.5, -2.25, 30.125), ("d1", 2, "HG11", "VAL", "A", "8", "B", 0.0, 0.0, -0.5)], "dtag string, atom_no int, atom_id string, residue_name string, chain string, seq_id string, icode string, x double, y double, z double")
    outputs.write_structures(a, f"file://{tmp_path}/structures")
    back = inputs.atoms(spark, f"file://{tmp_path}/structures/*/*.txt", "d1").orderBy("atom_id").collect()
    assert [(r.chain, r.seq_id, r.icode, r.atom_id, r.residue_name, r.x, r.y, r.z) for r in back] == [("A", "7", "", "CA", "GLY", 1.5, -2.25, 30.125), ("A", "8", "B", "HG11", "VAL", 0.0, 0.0, -0.5)]


def test_first_conformers(spark, tmp_path):
    line = "ATOM  {:5d}  {:3s}{}GLY A{:4d}    {:8.3f}{:8.3f}{:8.3f}"
    text = [line.format(1, "CA", "A", 1, 1, 0, 0), line.format(2, "CA", "B", 1, 2, 0, 0), line.format(3, "CA", "B", 2, 3, 0, 0), line.format(4, "CA", "C", 2, 4, 0, 0), line.format(5, "CA", " ", 3, 5, 0, 0)]
    (tmp_path / "m.pdb").write_text("\n".join(text))
    assert [r.x for r in inputs.atoms(spark, f"file://{tmp_path}/m.pdb", "d").orderBy("seq_id").collect()] == [1.0, 3.0, 5.0]


def test_maps_are_read_through_transforms(spark):
    """A linear map, read at places moved back by a known transform, has the moved places' values."""
    side = lambda c: spark.range(12).select(F.col("id").alias(c))
    grid = side("u").crossJoin(side("v")).crossJoin(side("w")).withColumn("value", (F.col("u") + 2 * F.col("v") + 4 * F.col("w")).cast("double"))
    cells = [("d", i, i % 2, 2.0 + 0.3 * i, 3.0 + 0.1 * i, 2.5) for i in range(10)]
    samples = spark.createDataFrame(cells, "dtag string, cell long, residue int, x double, y double, z double")
    turn = [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    still = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    t = spark.createDataFrame([("d", 0, still, [0.5, 0.0, 0.0], [0.0, 0.0, 0.0]), ("d", 1, turn, [3.0, 3.0, 0.0], [3.0, 3.0, 0.0])], "dtag string, residue int, mat array<double>, com_mov array<double>, com_ref array<double>")
    got = {r.cell: r.value for r in geometry.aligned_maps(samples, grid, t, ["dtag"], "cell", "residue", 0.5, (12, 12, 12)).collect()}
    for _, i, res, x, y, z in cells:
        bx, by = (x + 0.5, y) if res == 0 else (3 - (y - 3), 3 + (x - 3))
        assert got[i] == pytest.approx(2 * (bx + 2 * by + 4 * z))


def test_site_models_and_empty_events(spark):
    c = spark.createDataFrame([(i, float(i // 3) * 50, 0.0, 0.0) for i in range(9)], "event long, x double, y double, z double")
    found = {r.event: r.site for r in sites.get_sites("hierarchical", centroids=c, t=5.0).collect()}
    assert [found[i] for i in range(9)] == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    env = spark.createDataFrame([(e, k) for e in range(3) for k in range(5 if e < 2 else 1)], "event long, residue long")
    assert len({r.site for r in sites.get_sites("overlap", environment=env).where("event < 2").collect()}) == 1
    z = spark.createDataFrame([], "d long, place long, x double, y double, zz double, z double")
    assert events.process_models(z, ["d"], "place", 2.0).count() == 0
