"""Operators against direct numpy or Python forms, and the edge cases of each."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from outlyr.operators import events as ev
from outlyr.operators import filters, geometry, ranking, robust, sites, spatial
from outlyr.sources import inputs, outputs


def cloud(spark, n=120, seed=3):
    r = np.random.default_rng(seed)
    p = r.normal(0, 2, (n, 3))
    return p, spark.createDataFrame([(i, i % 3, float(x), float(y), float(z), float(s)) for i, ((x, y, z), s) in enumerate(zip(p, r.integers(0, 20, n)))], "id long, g int, x double, y double, z double, score double")


@given(st.lists(st.integers(0, 20), max_size=30), st.integers(0, 20), st.integers(0, 8), st.integers(0, 12), st.integers(0, 5))
def test_quota_is_a_prefix(res, ref, hard, soft, buffer):
    """The one-window form of the quota says what visiting rows in order says."""
    res, kept, k = sorted(res), [], 0
    for i, r in enumerate(res):
        ok = r < ref or k < hard or (k < soft and r < ref + buffer)
        if ok:
            kept.append(i)
            k += 1
    assert kept == [i for i, r in enumerate(res) if r < ref or i + 1 <= hard or (i + 1 <= soft and r < ref + buffer)]


def test_quota(spark):
    rows = [("t", float(r), f"m{i}", 2.0) for i, r in enumerate([1.0, 1.9, 2.0, 2.05, 2.1, 2.3])]
    got = filters.quota(spark.createDataFrame(rows, "t string, res double, m string, ref double"), "t", "res", "m", "ref", 3, 5, 0.1)
    assert sorted(r.m for r in got.collect()) == ["m0", "m1", "m2", "m3"]


def test_missing_rfree_passes(spark):
    df = spark.createDataFrame([(None,), (0.3,), (0.4,)], "rfree double")
    assert [r.rfree for r in df.where(filters.below("rfree", 0.4, 0.0)).collect()] == [None, 0.3]


def test_names_without_numbers(spark):
    df = spark.createDataFrame([("a-12x034",), ("none",), (None,)], "n string").select(filters.last_integer("n").alias("k"))
    assert [r.k for r in df.collect()] == [34, None, None]


def test_robust_z(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (15, 4))
    x[:, 3] = 2.0
    long = spark.createDataFrame([(i, c, float(x[i, c])) for i in range(15) for c in range(4)], "i int, cell int, value double")
    med = np.median(x, axis=0)
    spread = np.maximum(np.median(np.abs(x - med), axis=0) / 0.6745, 0.1)
    for row in robust.robust_z(long, ["cell"]).collect():
        assert row.z == pytest.approx((x[row.i, row.cell] - med[row.cell]) / spread[row.cell])
    assert all(row.z is None for row in robust.mean_z(long, ["cell"]).where("cell = 3").collect())


def test_range_join_and_nearest(spark):
    p, df = cloud(spark)
    b = df.select(F.col("id").alias("other"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    d = np.linalg.norm(p[:, None] - p[None], axis=-1)
    got = {(r.id, r.other) for r in spatial.range_join(df, b, 1.3, right_xyz=("bx", "by", "bz")).collect()}
    assert got == {(i, j) for i in range(len(p)) for j in range(len(p)) if d[i, j] < 1.3}
    near = {r.id: r.other for r in spatial.nearest(df, b.where("other % 2 = 0"), "id", "other", 3.0, right_xyz=("bx", "by", "bz")).collect()}
    for i in range(len(p)):
        j = min(range(0, len(p), 2), key=lambda k: (d[i, k], k))
        assert near.get(i) == (j if d[i, j] < 3.0 else None)


def test_suppression(spark):
    p, df = cloud(spark)
    score = {r.id: (r.score, r.g) for r in df.collect()}
    keep = set()
    for g in range(3):
        for i in sorted((i for i in score if score[i][1] == g), key=lambda i: (-score[i][0], i)):
            if all(np.linalg.norm(p[i] - p[j]) >= 1.5 for j in keep if score[j][1] == g):
                keep.add(i)
    assert {r.id for r in spatial.suppress(df, ["g"], "id", "score", 1.5).collect()} == keep
    same = spatial.suppress_asymmetric(df, ["g"], "id", "score", 1.5, ("x", "y", "z"), ("x", "y", "z"))
    assert {r.id for r in same.collect()} == keep


def test_dbscan(spark):
    p, df = cloud(spark, 150)
    d = np.linalg.norm(p[:, None] - p[None], axis=-1) <= 1.0
    core = d.sum(1) >= 6
    label = {i: i for i in range(len(p)) if core[i]}
    for _ in range(len(p)):
        label = {i: min(label[j] for j in label if d[i, j]) for i in label}
    want = {i: label[i] if core[i] else min(label[j] for j in label if d[i, j]) for i in range(len(p)) if core[i] or any(d[i, j] for j in label)}
    assert {r.id: r.cluster for r in spatial.dbscan(df, "id", 1.0, 6).collect()} == want
    assert spatial.dbscan(df.limit(0), "id", 1.0, 6).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a long, b long")
    got = {r.node: r.component for r in spatial.components(edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_linkage_holds_inversions_together():
    triangle = np.array([[0, 0, 0], [1, 0, 0], [0.5, 0.9, 0], [50, 0, 0]])
    assert spatial.centroid_clusters(triangle, 0.95).tolist() == [1, 2, 3, 4]
    assert spatial.centroid_clusters(triangle, 1.0).tolist() == [1, 1, 1, 2]
    assert spatial.centroid_clusters(triangle[:1], 1.0).tolist() == [1]
    assert spatial.centroid_clusters(triangle, 1.2, "complete").tolist() == [1, 1, 1, 2]


def test_site_merge(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "event long, cluster int")
    known = spark.createDataFrame([(2, 7), (9, 5)], "event long, site int")
    assert {r.event: r.site for r in sites.merge_sites(clusters, known).collect()} == {1: 7, 2: 7, 3: 8, 4: 9, 9: 5}
    assert {r.event: r.site for r in sites.merge_sites(clusters, known.limit(0)).collect()} == {1: 1, 2: 1, 3: 2, 4: 3}


def test_environment(spark):
    points = spark.createDataFrame([("e1", "d", 0.0, 0.0, 0.0), ("e2", "d", 30.0, 0.0, 0.0)], "event string, dtag string, x double, y double, z double")
    atoms = spark.createDataFrame([("d", 1, 4.9, 0.0, 0.0), ("d", 2, 5.0, 0.0, 0.0), ("o", 3, 0.0, 0.0, 0.0)], "dtag string, residue int, ax double, ay double, az double")
    env = sites.environments(points, atoms)
    assert [(r.event, r.residue) for r in env.collect()] == [("e1", 1)]
    c = {r.event: (r.x, r.y, r.z) for r in sites.reference_centroids(points.select("event"), env, atoms).collect()}
    assert c == {"e1": (4.9, 0.0, 0.0), "e2": (0.0, 0.0, 0.0)}


def test_kabsch_recovers_a_rotation():
    r = np.random.default_rng(5)
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    x = r.normal(size=(9, 3))
    rot, cm, cr = geometry.kabsch(x, x @ q.T + 4)
    assert np.allclose(rot, q, atol=1e-9) and np.allclose((x - cm) @ rot.T + cr, x @ q.T + 4)


def test_moved_there_and_back(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 1.0, 1.0], [2.0, 2.0, 2.0])], "x double, y double, z double, m array<double>, o array<double>, t array<double>")
    there = df.select("*", *[c.alias(n) for c, n in zip(geometry.moved(("x", "y", "z"), "m", "o", "t"), ("a", "b", "c"))])
    back = there.select("a", "b", "c", *[c.alias(n) for c, n in zip(geometry.moved(("a", "b", "c"), "m", "o", "t", inverse=True), ("p", "q", "r"))]).first()
    assert (back.a, back.b, back.c) == (1.0, 2.0, 4.0) and (back.p, back.q, back.r) == (1.0, 2.0, 3.0)


def test_trilinear(spark):
    g = spark.createDataFrame([(u, v, w, float(u + 10 * v + 100 * w)) for u in range(4) for v in range(4) for w in range(4)], "u int, v int, w int, value double")
    s = spark.createDataFrame([(0, 0.5, 1.25, 2.0), (1, 3.5, 0.0, 0.0)], "i int, a double, b double, c double")
    got = {r.i: r.value for r in geometry.trilinear(s, g, ["i"], ("a", "b", "c"), (4, 4, 4)).collect()}
    assert got == {0: pytest.approx(0.5 + 12.5 + 200), 1: pytest.approx(1.5)}  # the second wraps round


def test_grid_points(spark):
    got = geometry.grid_points_near(spark.createDataFrame([(0.2, 0.0, 0.0)], "x double, y double, z double"), 1.0, 0.5)
    want = {(u, v, w) for u in range(-4, 5) for v in range(-4, 5) for w in range(-4, 5) if (u / 2 - 0.2) ** 2 + (v / 2) ** 2 + (w / 2) ** 2 < 1}
    assert {tuple(r) for r in got.collect()} == want
    assert geometry.longest_diagonal(geometry.orthogonalisation(10, 10, 10, 90, 90, 90), (10, 10, 10)) == pytest.approx(3**0.5)


def test_interpolation_is_clamped(spark):
    k = [(0.0, 0.1), (1.0, 0.5), (2.0, 0.6)]
    xs = [-1.0, 0.0, 0.25, 1.0, 1.5, 2.0, 9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r.p for r in df.select(ranking.interpolate(F.col("x"), k).alias("p")).collect()] == pytest.approx(np.interp(xs, *zip(*k)).tolist())
    t = spark.createDataFrame(k, "x double, p double")
    assert [r.p for r in ranking.interpolate_table(df, "x", t).collect()] == pytest.approx(np.interp(xs, *zip(*k)).tolist())


def test_hit_probability_with_certainty(spark):
    df = spark.createDataFrame([(1, 3.0, 0, 0.5), (1, 2.0, 1, 1.0), (1, 1.0, 2, 0.25)], "site int, score double, id int, p double")
    got = {r.id: r.hit_in_site_probability for r in ranking.remaining_hit_probability(df, "site", "score", ["id"]).collect()}
    assert got == {0: 1.0, 1: 0.25, 2: 0.0}


def test_spread_ignores_outliers(spark):
    r = np.random.default_rng(0)
    v = np.concatenate((r.normal(0, 2, 400), [900.0, -900.0]))
    got = robust.regression_spread(spark.createDataFrame([(1, float(x)) for x in v], "i int, v double"), "i", "v").first().spread
    assert got == pytest.approx(2, rel=0.15)


def test_empty_events(spark):
    _, df = cloud(spark)
    assert ev.cluster_events(df.limit(0), ["g"], "id", 1.0).count() == 0
    merged = ev.merge_events(df.withColumn("size", F.lit(1)).withColumn("local_strength", F.lit(2)), ["g"], "id", 1.0)
    assert merged.agg(F.sum("size")).first()[0] == 120


def test_inputs(spark, tmp_path):
    for d, names in {"a": ["x.dimple.pdb", "x.dimple.mtz", "lig.cif", "lig.pdb"], "b": ["y.dimple.pdb"]}.items():
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_text("ATOM      1  CA  ALA A   1       1.000   2.000   3.000\nATOM      2  N   ALA A   1       4.000   5.000   6.000\n" if n.endswith("pdb") else "xx")
    found = inputs.files(spark, str(tmp_path)).cache()
    assert [(r.dtag, r.model[-12:]) for r in inputs.discover(found, r".*dimple\.pdb", r".*dimple\.mtz").collect()] == [("a", "x.dimple.pdb")]
    lig = inputs.ligands(found.where("name like 'lig%'")).first().ligands
    assert lig["lig"]["cif"].endswith("lig.cif") and lig["lig"]["smiles"] is None
    assert found.where(inputs.valid_text()).count() == 5
    a = inputs.atoms(spark, str(tmp_path / "a" / "x.dimple.pdb"))
    assert [(r.dtag, r.chain, r.seq_id, r.atom_id, r.x, r.z) for r in a.orderBy("x").collect()] == [("a", "A", "1", "CA", 1.0, 3.0), ("a", "A", "1", "N", 4.0, 6.0)]
    assert inputs.protein_atoms(a).count() == 2
    assert inputs.undone(spark.createDataFrame([("a",), ("b",)], "dtag string"), spark.createDataFrame([("a",)], "dtag string")).first().dtag == "b"


def test_checkpoints(spark, tmp_path):
    e = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.7)], "dtag string, event_idx int, score double")
    outputs.write_checkpoint(e, str(tmp_path / "c"))
    outputs.write_checkpoint(e.where("dtag = 'a'").withColumn("score", F.lit(0.9)), str(tmp_path / "c"))
    assert inputs.checkpoint(spark, str(tmp_path / "c"), "a", e.schema).first().score == 0.9
    assert inputs.checkpoint(spark, str(tmp_path / "c"), "b", e.schema).first().score == 0.7
    assert inputs.checkpoint(spark, str(tmp_path / "c"), "z", e.schema).count() == 0
    outputs.write_csv(e, str(tmp_path / "t"), "dtag")
    assert pd.concat(map(pd.read_csv, (tmp_path / "t").glob("*.csv")))["dtag"].tolist() == ["a", "b"]
    models = spark.createDataFrame([("a", 1, 3, 2, 1)], "dtag string, model int, n_initial int, n_size int, n_score int")
    assert '"event_idx":1' in outputs.report(models, e.select("dtag", F.lit(1).alias("model"), "event_idx", "score", F.lit(2.0).alias("size"))).first().report
    assert '"score":0.5' in outputs.manifest(e).where("dtag = 'a'").first().manifest
