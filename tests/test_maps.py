"""Linkage at any size, set packing, Fourier transforms, maps of several datasets and binary sources, against plain forms."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlyr.operators import events, fourier, geometry, linkage, spatial
from outlyr.sources import binary


def plain(points, t, kind):
    """Merging the nearest two clusters of a list until none are within t."""
    own = [[i] for i in range(len(points))]
    while len(own) > 1:
        far = lambda a, b: np.linalg.norm(points[a].mean(0) - points[b].mean(0)) if kind == "centroid" else max(np.linalg.norm(points[i] - points[j]) for i in a for j in b)
        d, i, j = min((far(a, b), i, j) for i, a in enumerate(own) for j, b in enumerate(own) if i < j)
        if d > t:
            break
        own[i] = own[i] + own.pop(j)
    return sorted(map(sorted, own))


@pytest.mark.parametrize("kind", ["centroid", "complete"])
@pytest.mark.parametrize("few", [0, 2000])
def test_clusters_of_separated_groups(spark, monkeypatch, kind, few):
    """Two groups of clumps: boxes put together by joins or on the driver, and each group of boxes clustered alone."""
    monkeypatch.setattr(linkage, "FEW_BOXES", few)
    r = np.random.default_rng(4)
    p = np.concatenate([c + r.normal(0, 1.0, (14, 3)) for c in ((0, 0, 0), (9, 0, 0), (0, 30, 5), (40, 4, 4))])
    df = spark.createDataFrame([(i, i % 2, *map(float, x)) for i, x in enumerate(p)], "i long, g int, x double, y double, z double")
    got = spatial.linkage_clusters(df, ["g"], "i", 2.5, linkage=kind).collect()
    for g in (0, 1):
        own = [r for r in got if r.g == g]
        sets = [sorted(r.i for r in own if r.cluster == c) for c in range(1, max(r.cluster for r in own) + 1)]
        assert [min(s) for s in sets] == sorted(min(s) for s in sets)
        assert sorted(sets) == [[2 * k + g for k in s] for s in plain(p[g::2], 2.5, kind)]
    assert spatial.linkage_clusters(df.limit(0), ["g"], "i", 2.5).count() == 0


def test_linkage_of_many_points(spark):
    """100,000 events at 20,000 sites: more than one task's matrix could hold; and a chain of 3000 in one group."""
    df = spark.range(100_000).select(F.col("id").alias("event"), *[(F.floor(F.col("id") / 5) % m * 50 + F.pmod(F.xxhash64("id", F.lit(c)), F.lit(100)) / 100).alias(c) for c, m in (("x", 27), ("y", 29), ("z", 31))])
    found = spatial.linkage_clusters(df, [], "event", 10.0).groupBy("cluster").agg(F.count("*").alias("n"), F.min("event").alias("e"), F.max("event").alias("f"))
    assert found.count() == 20_000 and found.where("n <> 5 or f <> e + 4").count() == 0
    chain = np.arange(3000)[:, None] * np.array([1.0, 0.5, 0.25])
    label = linkage.flat_clusters(chain, 3.0)
    assert (np.diff(label) >= 0).all() and 300 < label.max() < 2000


def test_null_keys_are_suppressed_last(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, None, 0.1), (3, 5.0, 4.0), (4, None, 4.1), (5, None, 9.0)], "i long, key double, x double").selectExpr("*", "0.0 y", "0.0 z", "'g' g")
    assert {r.i for r in spatial.suppress(df, ["g"], "i", "key", 1.0).collect()} == {1, 3, 5}


def test_null_vectors_and_one_row(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [0.0, 2.0])], "i long, v array<double>")
    assert {(r.item, r.neighbour) for r in spatial.knn(df, "i", "v", 2).collect()} == {(1, 1), (1, 3), (3, 3), (3, 1)}
    assert spatial.principal(df.where("i = 1"), "v", 2, "p").first().p == [0.0, 1.0]
    assert spatial.principal(df.limit(0), "v", 2, "p").count() == 0


def test_claims_in_rounds_are_those_in_order(spark):
    r = np.random.default_rng(2)
    rows = []
    for g in range(3):
        for i in range(60):
            own = [i, *r.choice([x for x in range(60) if x != i], 4, replace=False).tolist()]
            rows += [(g, i, int(m), float(r.integers(0, 4)), k) for k, m in enumerate(own)]
    df = spark.createDataFrame(rows, "g int, item long, neighbour long, distance double, rank int")
    got = {(x.g, x.set_no, x.member) for x in spatial.claim_groups(df, ["g"]).collect()}
    want = set()
    for g in range(3):
        near = {i: [x for x in rows if x[0] == g and x[1] == i] for i in range(60)}
        taken, no = set(), 0
        for i in sorted(near, key=lambda i: (sum(x[3] for x in near[i]) / len(near[i]), i)):
            members = {x[2] for x in near[i]}
            if not members & taken:
                taken, no = taken | members, no + 1
                want |= {(g, no, m) for m in members}
    assert got == want
    assert spatial.claim_groups(df.limit(0), ["g"]).count() == 0


def amplitudes(spark, seed, shape):
    r = np.random.default_rng(seed)
    grid = r.normal(size=shape)
    places = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), -1).reshape(-1, 3)
    return grid, [(f"d{seed}", *map(int, p), float(grid[tuple(p)])) for p in places]


def test_transform_there_and_back(spark):
    shape, cell = (6, 5, 4), (7.0, 8.0, 9.0, 90.0, 100.0, 90.0)
    (a, rows), (b, more) = amplitudes(spark, 1, shape), amplitudes(spark, 2, shape)
    df = spark.createDataFrame(rows + more, "dtag string, u int, v int, w int, value double")
    found = fourier.amplitudes_from_grid(df, ["dtag"], shape, 50.0)
    direct = {"d1": np.fft.ifftn(a) * 50, "d2": np.fft.ifftn(b) * 50}
    got = found.collect()
    mate = lambda x: tuple(-i % n for i, n in zip((x.h, x.k, x.l), shape))
    halves = {frozenset(((x.h % 6, x.k % 5, x.l % 4), mate(x))) for x in got}
    assert halves == {frozenset((p, tuple(-i % n for i, n in zip(p, shape)))) for p in np.ndindex(*shape)}
    for x in got:
        assert x.f * np.exp(1j * np.radians(x.phi)) == pytest.approx(direct[x.dtag][x.h % 6, x.k % 5, x.l % 4], abs=1e-9)
    back = {(x.dtag, x.u, x.v, x.w): x.value for x in fourier.grid_from_amplitudes(found.where("abs(h) < 3 and abs(l) < 2"), ["dtag"], shape, 50.0).collect()}
    spectrum = np.fft.ifftn(a)
    spectrum[3], spectrum[:, :, 2] = 0, 0
    want = np.fft.fftn(spectrum).real
    assert all(back["d1", *p] == pytest.approx(want[p], abs=1e-9) for p in np.ndindex(*shape))
    far = fourier.amplitudes_from_grid(df, ["dtag"], shape, 50.0, cell, 3.0)
    m = np.linalg.inv(geometry.orthogonalisation(*cell))
    assert {(x.h, x.k, x.l) for x in far.collect()} == {(x.h, x.k, x.l) for x in got if np.linalg.norm(np.array([x.h, x.k, x.l]) @ m) <= 1 / 3.0}
    assert fourier.grid_shape((10.0, 11.1, 3.4)) == (24, 24, 8)
    assert fourier.grid_from_amplitudes(found.limit(0), ["dtag"], shape).count() == 0


def test_maps_of_two_datasets_stay_apart(spark):
    grid = spark.range(64).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("dtag"), (F.col("id") % 4).alias("u"), (F.floor(F.col("id") / 4) % 4).alias("v"), F.floor(F.col("id") / 16).alias("w"))
    grid = grid.withColumn("value", F.when(F.col("dtag") == "a", 1.0).otherwise(10.0))
    samples = spark.createDataFrame([(d, i, 0, 0.3 * i, 0.2, 0.9) for d in "ab" for i in range(5)], "dtag string, cell long, residue int, x double, y double, z double")
    still = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    t = spark.createDataFrame([(d, 0, still, [0.0] * 3, [0.0] * 3) for d in "ab"], "dtag string, residue int, mat array<double>, com_mov array<double>, com_ref array<double>")
    got = geometry.aligned_maps(samples, grid, t, ["dtag"], "cell", "residue", 0.5, (4, 4, 4)).collect()
    assert len(got) == 10 and all(r.value == pytest.approx(1.0 if r.dtag == "a" else 10.0) for r in got)
    holes = geometry.aligned_maps(samples, grid.where("not (dtag = 'a' and u = 0)"), t, ["dtag"], "cell", "residue", 0.5, (4, 4, 4)).where("value is null").collect()
    assert {(r.dtag, r.cell) for r in holes} == {("a", 0), ("a", 1)}


def test_builds_stay_in_their_dataset(spark):
    e = spark.createDataFrame([("a", 1), ("b", 1)], "dtag string, event int")
    lig = spark.createDataFrame([("a", "x"), ("b", "y")], "dtag string, ligand string")
    conf = spark.createDataFrame([("a", "x", 0), ("b", "y", 0), ("b", "y", 1)], "dtag string, ligand string, conformer int")
    assert sorted(tuple(r) for r in events.build_tasks(e, lig, conf).collect()) == [("a", "x", 1, 0), ("b", "y", 1, 0), ("b", "y", 1, 1)]


def write_map(path, data, axes=(1, 2, 3), starts=(0, 0, 0), mode=2, order="<", cell=(10.0, 11.0, 12.0, 90.0, 90.0, 90.0)):
    """``data`` by section, row and column."""
    head = bytearray(1024)
    struct.pack_into(order + "10i", head, 0, *data.shape[::-1], mode, *starts, *[data.shape[2 - axes.index(k)] for k in (1, 2, 3)])
    struct.pack_into(order + "6f", head, 40, *cell)
    struct.pack_into(order + "3i", head, 64, *axes)
    struct.pack_into(order + "i", head, 92, 80)
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(bytes(head) + b" " * 80 + data.astype(order + binary.MODES[mode]).tobytes())


def test_maps_are_read_in_parts_and_cropped(spark, tmp_path):
    binary.register(spark)
    data = np.random.default_rng(0).normal(size=(7, 5, 6)).astype("f4")
    write_map(tmp_path / "d1" / "m.ccp4", data, axes=(3, 1, 2), starts=(1, -2, 4))
    write_map(tmp_path / "d2" / "m.mrc", (data * 20).astype(int), mode=1, order=">")
    paths = f"{tmp_path}/d1/m.ccp4,file://{tmp_path}/d2/m.mrc"
    df = spark.read.format("ccp4").option("path", paths).option("rows", "60").load()
    assert df.rdd.getNumPartitions() == 8
    got = {(r.dtag, r.u, r.v, r.w): r.value for r in df.collect()}
    assert len(got) == 2 * data.size
    for s, r, c in np.ndindex(*data.shape):
        assert got["d1", r - 2, s + 4, c + 1] == data[s, r, c] and got["d2", c, r, s] == int(data[s, r, c] * 20)
    box = spark.read.format("ccp4").option("path", f"{tmp_path}/d1/m.ccp4").option("box", "-1,5,2,1,6,9").load()
    assert {(r.u, r.v, r.w) for r in box.collect()} == {(u, v, w) for _, u, v, w in got if _ == "d1" and -1 <= u <= 1 and 5 <= v <= 6 and 2 <= w <= 9}
    assert spark.read.format("ccp4").option("path", f"{tmp_path}/d1/m.ccp4").option("box", "90,90,90,91,91,91").load().count() == 0
    found = binary.volume_amplitudes(spark, f"{tmp_path}/d2/m.mrc", rows="60").collect()
    direct = np.fft.ifftn((data * 20).astype(int).transpose(2, 1, 0)) * 10 * 11 * 12
    assert all(x.f * np.exp(1j * np.radians(x.phi)) == pytest.approx(direct[x.h % 6, x.k % 5, x.l % 7], abs=1e-6) for x in found)


def test_reflections_are_read_by_column(spark, tmp_path):
    binary.register(spark)
    r = np.random.default_rng(1)
    rows = np.concatenate((r.integers(-9, 9, (50, 3)), r.normal(size=(50, 3))), axis=1).astype("<f4")
    rows[7, 4] = np.nan
    labels = ["H", "K", "L", "FREE", "FWT", "PHWT"]
    records = [f"NCOL {len(labels)} 50 0", "CELL 10 20 30 90 90 90", *(f"COLUMN {c} {k} 0 1 0" for c, k in zip(labels, "HHHIFP")), "END"]
    (tmp_path / "d").mkdir()
    body = rows.tobytes()
    (tmp_path / "d" / "x.mtz").write_bytes(b"MTZ " + struct.pack("<i", 21 + rows.size) + bytes([0x44, 0x41, 0, 0]) + bytes(68) + body + b"".join(x.ljust(80).encode() for x in records))
    df = spark.read.format("mtz").option("path", f"{tmp_path}/d/x.mtz").option("columns", "H,FWT").option("rows", "60").load()
    assert df.columns == ["dtag", "H", "FWT"] and df.rdd.getNumPartitions() == 5 and df.where("FWT is null").count() == 1
    found = binary.reflections(spark, f"{tmp_path}/d/x.mtz", (("F", "PHI"), ("FWT", "PHWT")))
    assert sorted((x.h, x.k, x.l, round(x.phi, 5)) for x in found.collect()) == sorted((*map(int, x[:3]), round(float(x[5]), 5)) for x in rows)
    with pytest.raises(ValueError, match="no known pair"):
        binary.reflections(spark, f"{tmp_path}/d/x.mtz", (("F", "PHI"),))
    assert binary.table_header(f"{tmp_path}/d/x.mtz").cell == (10.0, 20.0, 30.0, 90.0, 90.0, 90.0)
