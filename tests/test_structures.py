"""Scalar functions and operators over atoms against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlyr.functions import scalar
from outlyr.operators import structures as st


def atoms(spark, n, seed, tag="d"):
    p = np.random.default_rng(seed).normal(0, 3, (n, 3))
    return p, spark.createDataFrame([(tag, i, *map(float, x)) for i, x in enumerate(p)], "dtag string, cell long, x double, y double, z double")


def test_scalars(spark):
    df = spark.createDataFrame([(-1.5,), (0.2,), (7.0,), (None,)], "x double")
    x = F.col("x")
    got = df.select(scalar.clip(x, 0.0, 3.0).alias("c"), scalar.wrap(x, 2).alias("w"), scalar.digitize(x, [0.0, 1.0, 7.0]).alias("d"), scalar.score_levels(x, 0.0, 1.0).alias("s"), scalar.contour_level(x, [(1.5, 1), (0.0, 4)]).alias("l")).collect()
    assert [r.c for r in got] == [0.0, 0.2, 3.0, None]
    assert [r.w for r in got[:3]] == pytest.approx(np.mod([-1.5, 0.2, 7.0], 2))
    assert [r.d for r in got] == [0, 1, 3, 0] and [r.s for r in got[:3]] == [0.0, 0.5, 1.0] and [r.l for r in got[:3]] == [0, 4, 1]
    assert scalar.linspace(0, 1, 3) == [0, 0.5, 1]
    one = spark.range(1).select(
        scalar.fraction_label(F.lit(0.45)).alias("f"), scalar.merged(F.expr("map('a', 1, 'b', 2)"), F.expr("map('b', 3)")).alias("m"),
        scalar.arg_extreme(F.expr("array(1, 5, 5)")).alias("hi"), scalar.arg_extreme(F.expr("array(4, 2, 5)"), False).alias("lo"), scalar.exp_scale(F.lit(2.0), 0.5, F.lit(2.0)).alias("e"),
    ).first()
    assert (one.f, one.m, one.hi, one.lo) == ("0.55", {"a": 1, "b": 3}, 1, 1) and one.e == pytest.approx(2 * np.e)


def test_masks_and_crops(spark):
    p, a = atoms(spark, 150, 1)
    q, b = atoms(spark, 20, 2)
    near = (np.linalg.norm(p[:, None] - q[None], axis=-1) < 1.2).any(1)
    assert {r.cell for r in st.within(a, b, "cell", 1.2).collect()} == set(np.flatnonzero(near))
    assert {r.cell for r in st.without(a, b, "cell", 1.2).collect()} == set(np.flatnonzero(~near))
    got = {r.cell: r.value for r in st.masked(a.withColumn("value", F.lit(5.0)), b, radius=1.2).collect()}
    assert got == {i: 0.0 if near[i] else 5.0 for i in range(len(p))}
    assert a.where(st.in_box(("x", "y", "z"), (0, 0, 0), (0, 0, 0), 3.0)).count() == (np.abs(p) <= 3).all(1).sum()


def test_probes_keep_clear(spark):
    p, a = atoms(spark, 15, 3)
    got = np.array([(r.px, r.py, r.pz) for r in st.probe_points(a, "cell").collect()])
    corners = np.array([x + 1.5 * np.array(s) for x in p for s in np.array(np.meshgrid([-1, 1], [-1, 1], [-1, 1])).T.reshape(-1, 3)])
    clear = (np.linalg.norm(corners[:, None] - p[None], axis=-1) >= 1.4).all(1)
    assert len(got) == clear.sum() and np.allclose(sorted(map(tuple, got)), sorted(map(tuple, corners[clear])))


def test_deviations_and_hits(spark):
    p, a = atoms(spark, 30, 4)
    b = a.withColumn("x", F.col("x") + 0.5)
    assert st.matched_deviation(a, b, ["dtag"], "cell").first().rmsd == pytest.approx(0.5)
    d = np.linalg.norm(p[:, None] - (p + [0.5, 0, 0])[None], axis=-1).min(1)
    assert st.closest_deviation(a, b, ["dtag"], "cell").first().rmsd == pytest.approx(np.sqrt((d**2).mean()))
    hits = spark.createDataFrame([("d", "h", *map(float, p[3] + 0.01)), ("d", "far", 99.0, 0.0, 0.0)], "dtag string, hit string, x double, y double, z double")
    got = {r.hit: r.cell for r in st.hit_distances(hits, a, "hit", "cell", ["dtag"], 2.0).collect()}
    assert got == {"h": 3, "far": None}
    assert st.concatenated({"a": a, "b": a}).groupBy("system").count().count() == 2


def test_residues(spark):
    rows = [("d", 1, "A", "1", 2, 9.0, 0.0, 0.0), ("d", 1, "A", "1", 1, 1.0, 0.0, 0.0), ("d", 1, "B", "1", 3, 2.0, 0.0, 0.0)]
    a = spark.createDataFrame(rows, "dtag string, model int, chain string, seq_id string, atom_no int, x double, y double, z double")
    first = st.first_atoms(a)
    assert {(r.chain, r.x) for r in first.collect()} == {("A", 1.0), ("B", 2.0)}
    assert st.matched_residues(first, first.where("chain = 'A'").drop("dtag")).count() == 1
