"""Operators of model_catalog against direct numpy forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlyr.operators import geometry, ranking, spatial, structures


def test_principal_axes(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(200, 6)) * [9, 5, 3, 1, 0.5, 0.1] @ np.linalg.qr(r.normal(size=(6, 6)))[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    got = np.array([x.p for x in spatial.principal(df, "v", 3, "p").orderBy("id").collect()])
    axes = np.linalg.svd(v - v.mean(axis=0), full_matrices=False)[2][:3]
    assert np.abs(got) == pytest.approx(np.abs(v @ axes.T), abs=1e-8)
    assert spatial.principal(df.limit(0), "v").count() == 0


def test_mixture_finds_far_parts(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(120, 3)) * 0.1 + np.repeat([[0, 0, 0], [9, 0, 0], [0, 9, 0]], 40, axis=0)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {x.member: x.set_no for x in spatial.mixture_sets(df, "id", "v", 3, 3, 1).collect()}
    assert sorted(got) == list(range(120)) and set(got.values()) <= {1, 2, 3}
    assert all(len({got[i] for i in range(40 * k, 40 * k + 40)}) == 1 for k in range(3))


def test_plane_of_a_flat_molecule(spark):
    r = np.random.default_rng(7)
    flat = np.c_[r.normal(size=(30, 2)) * [5, 2], np.zeros(30)] @ np.linalg.qr(r.normal(size=(3, 3)))[0] + [1, 2, 3]
    df = spark.createDataFrame([("a", *map(float, p)) for p in flat], "dtag string, x double, y double, z double")
    got = geometry.plane_samples(df, ["dtag"], 5, 0.5).orderBy("i", "j").collect()
    at = np.array([[x.sx, x.sy, x.sz] for x in got])
    normal = np.linalg.svd(flat - flat.mean(axis=0))[2][2]
    assert len(got) == 25 and (at - flat.mean(axis=0)) @ normal == pytest.approx(np.zeros(25), abs=1e-9)
    assert at[12] == pytest.approx(flat.mean(axis=0)) and np.linalg.norm(at[1] - at[0]) == pytest.approx(0.5)


def test_merge_driver(spark):
    atoms = spark.createDataFrame([("d", 1, "A", 5, 1, "CA"), ("d", 1, "A", 9, 2, "N"), ("d", 1, "B", 70, 3, "N"), ("d", 2, "A", 400, 4, "N"), ("e", 1, "A", 1, 1, "N")], "dtag string, model int, chain string, seq_id int, atom_no int, atom_id string")
    builds = spark.createDataFrame([("d", "p1", 1, 0.2), ("d", "p2", 2, 0.9), ("x", "p3", 1, 0.5)], "dtag string, path string, event int, score double")
    chosen = ranking.select_merge(builds.withColumn("es", F.col("score")), "dtag", "event", "es", "score", "path", "raw")
    ligand = chosen.select("dtag", F.lit(1).alias("seq_id"), F.lit(1).alias("atom_no"), F.concat(F.lit("L"), "path").alias("atom_id"))
    got = structures.merged_structures(atoms, ligand)
    assert got.columns == atoms.columns and got.count() == 6
    assert [tuple(x) for x in got.where("atom_id like 'L%'").collect()] == [("d", 1, "A", 109, 1, "Lp2")]
