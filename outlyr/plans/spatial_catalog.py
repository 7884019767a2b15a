"""Registered queries of the operators on atoms, grids, files, tables and models, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlyr.functions import scalar
from outlyr.operators import events as ev
from outlyr.operators import filters, geometry, ranking, robust, sites, spatial, structures
from outlyr.plans.catalog import CELLS, INTERP, KNOTS, MODEL, POINTS, cells, points, scored
from outlyr.plans.registry import ORACLE, query
from outlyr.session import table
from outlyr.sources import inputs, outputs

CENTRES = f"{POINTS}, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY label)"
TO_CENTRE = "sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)"


def centres(spark, sf_dir):
    """label, x, y, z: the mean position of each label."""
    return points(spark, sf_dir).groupBy("label").agg(*[F.avg(c).alias(c) for c in "xyz"])


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("first_atoms", f"WITH {POINTS} SELECT label, min(vec_id) AS vec_id, round(arg_min(x, vec_id), 6) AS x FROM pts GROUP BY label")
def first_atoms(spark, sf_dir):
    return structures.first_atoms(points(spark, sf_dir), ("label",), "vec_id").select("label", "vec_id", *r6("x"))


@query("matched_residues", f"WITH {POINTS}, r AS (SELECT vec_id % 100 AS seq_id, avg(x) AS rx FROM pts GROUP BY 1) SELECT label AS dtag, seq_id, round(x, 6) AS mx, round(rx, 6) AS rx FROM pts JOIN r ON seq_id = vec_id % 100")
def matched_residues(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("seq_id", F.col("vec_id") % 100).withColumnRenamed("label", "dtag")
    ref = p.groupBy("seq_id").agg(*[F.avg(c).alias(c) for c in "xyz"])
    return structures.matched_residues(p, ref, ("seq_id",)).select("dtag", "seq_id", *r6("mx", "rx"))


@query("near_mask", f"WITH {CENTRES} SELECT vec_id FROM pts WHERE EXISTS (SELECT 1 FROM c WHERE {TO_CENTRE} < 2.0)")
def near_mask(spark, sf_dir):
    return structures.within(points(spark, sf_dir), centres(spark, sf_dir), "vec_id", 2.0).select("vec_id")


@query("cropped_points", f"WITH {CENTRES} SELECT vec_id FROM pts WHERE NOT EXISTS (SELECT 1 FROM c WHERE {TO_CENTRE} < 2.0)")
def cropped_points(spark, sf_dir):
    return structures.without(points(spark, sf_dir), centres(spark, sf_dir), "vec_id", 2.0).select("vec_id")


@query("masked_cells", f"WITH {CENTRES} SELECT vec_id, CASE WHEN EXISTS (SELECT 1 FROM c WHERE {TO_CENTRE} < 1.5) THEN 0.0 ELSE label + 1.0 END::DOUBLE AS value FROM pts")
def masked_cells(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("value", F.col("label") + F.lit(1.0))
    return structures.masked(p, centres(spark, sf_dir), "vec_id", "value", 1.5).select("vec_id", "value")


@query("boxed_points", f"WITH {POINTS} SELECT vec_id FROM pts WHERE x BETWEEN -1.5 AND 1.5 AND y BETWEEN -2.5 AND 0.5 AND z BETWEEN -0.5 AND 2.5")
def boxed_points(spark, sf_dir):
    return points(spark, sf_dir).where(structures.in_box("xyz", (-1.0, -2.0, 0.0), (1.0, 0.0, 2.0), 0.5)).select("vec_id")


@query("probe_points", f"""WITH {POINTS}, p AS (SELECT vec_id, x + i * 1.5 AS px, y + j * 1.5 AS py, z + k * 1.5 AS pz FROM pts, (SELECT unnest([-1, 1]) AS i), (SELECT unnest([-1, 1]) AS j), (SELECT unnest([-1, 1]) AS k))
SELECT vec_id, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz FROM p WHERE NOT EXISTS (SELECT 1 FROM pts WHERE sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2) < 1.4)""")
def probe_points(spark, sf_dir):
    return structures.probe_points(points(spark, sf_dir), "vec_id").select("vec_id", *r6("px", "py", "pz"))


@query("closest_hits", f"""WITH {CENTRES}, d AS (SELECT label, vec_id, {TO_CENTRE} AS d FROM pts JOIN c USING (label))
SELECT label, label + 100 AS hit, arg_min(vec_id, (d, vec_id)) FILTER (d < 1.0) AS vec_id, round(min(d) FILTER (d < 1.0), 6) AS distance FROM d GROUP BY label""")
def closest_hits(spark, sf_dir):
    known = centres(spark, sf_dir).withColumn("hit", F.col("label") + 100)
    return structures.hit_distances(known, points(spark, sf_dir), "hit", "vec_id", ["label"], 1.0).select("label", "hit", "vec_id", *r6("distance"))


@query("matched_rmsd", f"WITH {POINTS} SELECT label, round(sqrt(avg((0.1 * label) ** 2 + (0.5 * y) ** 2)), 6) AS rmsd FROM pts GROUP BY label")
def matched_rmsd(spark, sf_dir):
    p = points(spark, sf_dir)
    b = p.select("label", "vec_id", (F.col("x") + F.lit(0.1) * F.col("label")).alias("x"), (F.col("y") * 1.5).alias("y"), "z")
    return structures.matched_deviation(p, b, ["label"], "vec_id").select("label", *r6("rmsd"))


@query("closest_rmsd", f"""WITH {POINTS}, d AS (SELECT a.label, a.vec_id, min((a.x - b.x - 0.3) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM pts a JOIN pts b USING (label) GROUP BY ALL)
SELECT label, round(sqrt(avg(d)), 6) AS rmsd FROM d GROUP BY label""")
def closest_rmsd(spark, sf_dir):
    p = points(spark, sf_dir)
    return structures.closest_deviation(p, p.withColumn("x", F.col("x") + 0.3), ["label"], "vec_id").select("label", *r6("rmsd"))


@query("concatenated_systems", "SELECT 'parts' AS system, count(*) AS n, sum(p_size)::BIGINT AS total FROM part UNION ALL SELECT 'customers', count(*), sum(c_nationkey)::BIGINT FROM customer")
def concatenated_systems(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("v"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("v"))
    return structures.concatenated({"parts": parts, "customers": customers}).groupBy("system").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


NEAR_RESIDUES = f"{POINTS}, env AS (SELECT DISTINCT a.vec_id AS event, b.vec_id // 3 AS residue FROM pts a JOIN pts b USING (label) WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 1.0)"


def environment(spark, sf_dir):
    p = points(spark, sf_dir)
    a = p.select(F.col("label").alias("dtag"), F.expr("vec_id div 3").alias("residue"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    return sites.environments(p.select(F.col("vec_id").alias("event"), F.col("label").alias("dtag"), *"xyz"), a, 1.0), a


@query("event_environments", f"WITH {NEAR_RESIDUES} SELECT event, residue FROM env")
def event_environments(spark, sf_dir):
    return environment(spark, sf_dir)[0]


@query("reference_places", f"""WITH {NEAR_RESIDUES}, m AS (SELECT event, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM env JOIN pts ON vec_id // 3 = residue WHERE label = 0 GROUP BY event)
SELECT vec_id AS event, round(coalesce(m.x, 0), 6) AS x, round(coalesce(m.y, 0), 6) AS y, round(coalesce(m.z, 0), 6) AS z FROM pts LEFT JOIN m ON event = vec_id""")
def reference_places(spark, sf_dir):
    env, atoms = environment(spark, sf_dir)
    found = sites.reference_centroids(points(spark, sf_dir).select(F.col("vec_id").alias("event")), env, atoms.where("dtag = 0"))
    return found.select("event", *r6(*"xyz"))


@query("moved_points", f"WITH {POINTS} SELECT vec_id, round(y - 2, 6) AS x, round(1 - x, 6) AS y, round(z - 3, 6) AS z, round(x, 6) AS back FROM pts")
def moved_points(spark, sf_dir):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    p = points(spark, sf_dir).withColumn("mat", arr(0, 1, 0, -1, 0, 0, 0, 0, 1)).withColumn("m", arr(1, 2, 3)).withColumn("r", arr(0, 0, 0))
    there = p.select("vec_id", "mat", "m", "r", *[c.alias(n) for c, n in zip(geometry.moved("xyz", "mat", "m", "r"), "xyz", strict=True)])
    return there.select("vec_id", *r6(*"xyz"), F.round(geometry.moved("xyz", "mat", "m", "r", inverse=True)[0], 6).alias("back"))


CELL = geometry.orthogonalisation(10, 12, 14, 85, 100, 95)


@query("orthogonal_points", f"WITH {POINTS} SELECT vec_id, " + ", ".join(f"round({row[0]!r} * x + {row[1]!r} * y + {row[2]!r} * z, 6) AS o{c}" for row, c in zip(CELL.tolist(), "xyz", strict=True)) + " FROM pts")
def orthogonal_points(spark, sf_dir):
    return points(spark, sf_dir).select("vec_id", *[F.round(c, 6).alias(f"o{n}") for c, n in zip(geometry.linear("xyz", CELL), "xyz", strict=True)])


@query("translated_points", f"WITH {POINTS} SELECT vec_id, round(x + 1.5, 6) AS x, round(y - 2, 6) AS y, round(z + 0.25, 6) AS z FROM pts")
def translated_points(spark, sf_dir):
    return points(spark, sf_dir).select("vec_id", *[F.round(c, 6).alias(n) for c, n in zip(geometry.translated("xyz", (1.5, -2, 0.25)), "xyz", strict=True)])


AROUND = ", unnest(range(floor({c} / 0.75)::BIGINT - 2, ceil({c} / 0.75)::BIGINT + 3)) AS {g}"


@query("grid_points", f"""WITH {POINTS}, a AS (SELECT *{AROUND.format(c="x", g="u")} FROM pts), b AS (SELECT *{AROUND.format(c="y", g="v")} FROM a), d AS (SELECT *{AROUND.format(c="z", g="w")} FROM b)
SELECT DISTINCT u, v, w FROM d WHERE (u * 0.75 - x) ** 2 + (v * 0.75 - y) ** 2 + (w * 0.75 - z) ** 2 < 1""")
def grid_points(spark, sf_dir):
    return geometry.grid_points_near(points(spark, sf_dir), 1.0, 0.75)


@query("box_maps", f"""WITH {CENTRES}, s AS (SELECT label, i, j, k, cx + (i - 1) * 0.7 AS x, cy + (j - 1) * 0.7 AS y, cz + (k - 1) * 0.7 AS z FROM c, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j), (SELECT unnest(range(3)) AS k)),
t AS (SELECT *, floor(x) + a AS u, floor(y) + b AS v, floor(z) + d AS w, (CASE a WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE b WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE d WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) AS weight
FROM s, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS d)), p AS (SELECT *, ((u::INT % 8) + 8) % 8 AS pu, ((v::INT % 8) + 8) % 8 AS pv, ((w::INT % 8) + 8) % 8 AS pw FROM t)
SELECT label, i::INT AS i, j::INT AS j, k::INT AS k, round(sum(weight * (pu * pu + 2 * pv + 3 * pw * pu)), 6) AS value FROM p GROUP BY ALL""")
def box_maps(spark, sf_dir):
    side = lambda c: spark.range(8).select(F.col("id").alias(c))
    grid = side("u").crossJoin(side("v")).crossJoin(side("w")).withColumn("value", (F.col("u") * F.col("u") + 2 * F.col("v") + 3 * F.col("w") * F.col("u")).cast("double"))
    samples = geometry.box_samples(centres(spark, sf_dir), 3, 0.7)
    return geometry.trilinear(samples, grid, ["label", "i", "j", "k"], ("sx", "sy", "sz"), (8, 8, 8)).select("label", "i", "j", "k", *r6("value"))


@query("dense_cells", "SELECT n_nationkey AS cell, coalesce(max(s_acctbal) FILTER (s_acctbal > 9000), 0.0) AS value FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def dense_cells(spark, sf_dir):
    sparse = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("cell")).agg(F.max("s_acctbal").alias("value"))
    return geometry.dense(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell")), sparse)


@query("partitioned_cells", f"""WITH {CENTRES}, n AS (SELECT vec_id, arg_min(c.label, (d, c.label)) AS residue, min(d) AS distance FROM (SELECT vec_id, c.label, {TO_CENTRE} AS d FROM pts, c) c WHERE d < 4 GROUP BY vec_id)
SELECT vec_id, residue, round(distance, 6) AS distance FROM n JOIN pts USING (vec_id) WHERE NOT EXISTS (SELECT 1 FROM c WHERE sqrt((x + cx + 1) ** 2 + (y + cy) ** 2 + (z - cz) ** 2) <= 1.0)""")
def partitioned_cells(spark, sf_dir):
    c = centres(spark, sf_dir)
    residues = c.select(F.col("label").alias("residue"), *[F.col(k).alias(f"r{k}") for k in "xyz"])
    images = c.select((-F.col("x") - 1).alias("ix"), (-F.col("y")).alias("iy"), F.col("z").alias("iz"))
    return geometry.partition_cells(points(spark, sf_dir), residues, "vec_id", "residue", 4.0, images).select("vec_id", "residue", *r6("distance"))


@query("scalar_values", """SELECT event_id, least(greatest(value, 10), 40) AS clipped, ((user_id - 75) % 7 + 7) % 7 AS wrapped, (value >= 10)::INT + (value >= 20)::INT + (value >= 50)::INT AS bin, CASE WHEN value < 15 THEN 0.0 WHEN value < 30 THEN 0.5 ELSE 1.0 END::DOUBLE AS score,
CASE WHEN value >= 75 THEN 1 WHEN value >= 50 THEN 2 WHEN value >= 25 THEN 3 ELSE 0 END AS contour, round(value * exp(-0.01 * user_id), 6) AS scaled, round(ln(event_id + 1), 6) AS logged FROM events""")
def scalar_values(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", scalar.clip(v, 10.0, 40.0).alias("clipped"), scalar.wrap(F.col("user_id") - 75, 7).alias("wrapped"), scalar.digitize(v, (10, 20, 50)).alias("bin"), scalar.score_levels(v, 15, 30).alias("score"),
        scalar.contour_level(v, ((75, 1), (50, 2), (25, 3))).alias("contour"), F.round(scalar.exp_scale(v, -0.01, F.col("user_id")), 6).alias("scaled"), F.round(scalar.log_count(F.col("event_id") + 1), 6).alias("logged"),
    )


@query("array_extremes", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS largest, (list_position(embedding, list_min(embedding)) - 1)::INT AS least FROM embeddings")
def array_extremes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", scalar.arg_extreme(F.col("embedding")).alias("largest"), scalar.arg_extreme(F.col("embedding"), False).alias("least"))


@query("merged_maps", "SELECT event_id, value AS a, user_id::DOUBLE AS b, 1.0::DOUBLE AS c FROM events")
def merged_maps(spark, sf_dir):
    m = scalar.merged(F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.lit(0.0)), F.create_map(F.lit("b"), F.col("user_id").cast("double"), F.lit("c"), F.lit(1.0)))
    return table(spark, sf_dir, "events").select("event_id", *[m[k].alias(k) for k in "abc"])


@query("fraction_labels", "SELECT DISTINCT l_discount, regexp_replace(regexp_replace(round_even(1 - l_discount, 2)::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '.') AS label FROM lineitem")
def fraction_labels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_discount").distinct().select("l_discount", scalar.fraction_label(F.col("l_discount")).alias("label"))


@query("best_builds", "SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, l_linenumber)) AS l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_orderkey")
def best_builds(spark, sf_dir):
    return ranking.best_build(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_linenumber")


@query("ligand_scores", "SELECT user_id, event_type, greatest(max(value - 40), 0.0) AS score FROM events GROUP BY ALL")
def ligand_scores(spark, sf_dir):
    return ev.best_ligand_score(table(spark, sf_dir, "events").withColumn("score", F.col("value") - 40), ["user_id", "event_type"])


@query("peak_scores", "SELECT event_id, round(greatest(value - 30, 0) / (1 + greatest(value - 30, 0)), 6) AS score FROM events")
def peak_scores(spark, sf_dir):
    return ev.peak_scorer("peak")(table(spark, sf_dir, "events").withColumn("peak", F.col("value") - 30)).select("event_id", *r6("score"))


@query("restrained_datasets", "SELECT p_partkey FROM part WHERE p_size > 25 OR p_size % 4 = 0")
def restrained_datasets(spark, sf_dir):
    ligand = lambda ok: F.struct(F.when(ok, F.col("p_name")).alias("cif"), F.lit("x").alias("smiles"))
    p = table(spark, sf_dir, "part").withColumn("ligands", F.create_map(F.lit("a"), ligand(F.col("p_size") > 25), F.lit("b"), ligand(F.col("p_size") % 4 == 0)))
    return p.where(filters.has_restraints()).select("p_partkey")


@query("site_tables", f"WITH {POINTS} SELECT label + 1 AS site_idx, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS events, CASE WHEN label < 4 THEN 'kept' END AS \"Name\" FROM pts GROUP BY label")
def site_tables(spark, sf_dir):
    p = points(spark, sf_dir)
    s = sites.site_table(p.select(F.col("vec_id").alias("event"), (F.col("label") + 1).alias("site")), p.select(F.col("vec_id").alias("event"), *"xyz")).withColumnRenamed("site", "site_idx")
    earlier = s.where("site_idx < 5").select("site_idx", F.lit("kept").alias("Name"), F.lit("").alias("Comment"))
    return outputs.inspect_sites(s, earlier).select("site_idx", *r6(*"xyz"), "events", "Name")


@query("manifests", "SELECT c_name AS dtag, json_object('c_custkey', c_custkey, 'c_mktsegment', c_mktsegment)::VARCHAR AS manifest FROM customer")
def manifests(spark, sf_dir):
    return outputs.manifest(table(spark, sf_dir, "customer").select(F.col("c_name").alias("dtag"), "c_custkey", "c_mktsegment"))


FOUND = "f AS (SELECT 'd' || (c_custkey % 50) AS dtag, 'l' || (c_custkey % 3) || (CASE c_nationkey % 4 WHEN 0 THEN '.cif' WHEN 1 THEN '.smiles' WHEN 2 THEN '.pdb' ELSE '.mtz' END) AS name, '/in/' || lpad(c_custkey::VARCHAR, 9, '0') AS path FROM customer)"


def found(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    end = F.element_at(F.array(*map(F.lit, (".cif", ".smiles", ".pdb", ".mtz"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return c.select(F.concat(F.lit("d"), (F.col("c_custkey") % 50).cast("string")).alias("dtag"), F.concat(F.lit("l"), (F.col("c_custkey") % 3).cast("string"), end).alias("name"), F.concat(F.lit("/in/"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("path"))


@query("discovered_datasets", f"WITH {FOUND} SELECT dtag, min(path) FILTER (name LIKE '%.pdb') AS model, min(path) FILTER (name LIKE 'l1.mtz') AS reflections FROM f GROUP BY dtag HAVING model IS NOT NULL AND reflections IS NOT NULL")
def discovered_datasets(spark, sf_dir):
    return inputs.discover(found(spark, sf_dir), r".*\.pdb", r"l1\.mtz")


@query("ligand_files", f"WITH {FOUND} SELECT dtag, name[:2] AS stem, min(path) FILTER (name LIKE '%.cif') AS cif, min(path) FILTER (name LIKE '%.smiles') AS smiles, min(path) FILTER (name LIKE '%.pdb') AS pdb FROM f WHERE name NOT LIKE '%.mtz' AND name NOT LIKE 'l2%' GROUP BY ALL")
def ligand_files(spark, sf_dir):
    m = inputs.ligands(found(spark, sf_dir), ("l2",))
    return m.select("dtag", F.explode("ligands").alias("stem", "l")).select("dtag", "stem", "l.cif", "l.smiles", "l.pdb")


@query("merged_ligands", """SELECT dtag, stem, arg_max(cif, (ok, folder)) AS cif FROM (SELECT 'd' || (c_custkey % 40) AS dtag, 's' || (c_nationkey % 2) AS stem, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '-' END AS cif,
(c_custkey % 3 > 0)::INT AS ok, c_custkey AS folder FROM customer) GROUP BY ALL""")
def merged_ligands(spark, sf_dir):
    c, ok = table(spark, sf_dir, "customer"), F.col("c_custkey") % 3 > 0
    rows = c.select(F.concat(F.lit("d"), (F.col("c_custkey") % 40).cast("string")).alias("dtag"), F.concat(F.lit("s"), (F.col("c_nationkey") % 2).cast("string")).alias("stem"), F.when(ok, F.col("c_name")).alias("cif"), F.lit("s").alias("smiles"), F.when(ok, F.col("c_name")).alias("pdb"), F.col("c_custkey").alias("folder"))
    return inputs.merge_ligands(rows).select("dtag", "stem", F.coalesce("cif", F.lit("-")).alias("cif"))


@query("valid_files", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_nationkey % 4 > 1 WHEN 1 THEN c_nationkey % 4 > 1 ELSE c_nationkey % 4 > 0 END AS ok FROM customer")
def valid_files(spark, sf_dir):
    n, kind = (F.col("c_nationkey") % 4).cast("int"), F.col("c_custkey") % 3
    content = F.when(kind == 0, F.repeat(F.lit("ATOM      1  CA\n"), n)).otherwise(F.repeat(F.lit("C"), n))
    name = F.when(kind == 0, "a.pdb").when(kind == 1, "a.smiles").otherwise("a.cif")
    files = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), content.cast("binary").alias("content"))
    return files.select("c_custkey", inputs.valid_text().alias("ok"))


@query("undone_datasets", "SELECT o_orderkey AS dtag FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def undone_datasets(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("dtag"))
    return inputs.undone(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dtag")), done)


@query("protein_atoms", "WITH a AS (SELECT p_partkey, p_partkey // 4 AS seq_id, CASE p_size % 3 WHEN 0 THEN 'xca1' WHEN 1 THEN 'N' ELSE 'CB' END AS atom_id FROM part) SELECT p_partkey, seq_id FROM a WHERE seq_id IN (SELECT seq_id FROM a WHERE upper(atom_id) LIKE '%CA%')")
def protein_atoms(spark, sf_dir):
    name = F.when(F.col("p_size") % 3 == 0, "xca1").when(F.col("p_size") % 3 == 1, "N").otherwise("CB")
    a = table(spark, sf_dir, "part").select("p_partkey", F.lit("d").alias("dtag"), F.lit(1).alias("model"), F.lit("A").alias("chain"), F.expr("p_partkey div 4").alias("seq_id"), name.alias("atom_id"))
    return inputs.protein_atoms(a).select("p_partkey", "seq_id")


@query("water_free_atoms", "SELECT p_partkey FROM part WHERE p_size % 5 <> 0")
def water_free_atoms(spark, sf_dir):
    return inputs.water_free(table(spark, sf_dir, "part").withColumn("residue_name", F.when(F.col("p_size") % 5 == 0, "HOH").otherwise("GLY"))).select("p_partkey")


@query("truncated_common", "WITH a AS (SELECT * FROM lineitem WHERE l_discount >= 0.03), k AS (SELECT l_linenumber, l_quantity FROM a GROUP BY ALL HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM a)) SELECT l_suppkey, count(*) AS n FROM a SEMI JOIN k USING (l_linenumber, l_quantity) GROUP BY l_suppkey")
def truncated_common(spark, sf_dir):
    return filters.truncate_common(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_linenumber", "l_quantity"], "l_discount", 0.03).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("confident_events", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::INT > 60 AND value > 20")
def confident_events(spark, sf_dir):
    e = scored(spark, sf_dir).withColumn("Ligand Confidence", F.when(F.col("k") > 60, "High").otherwise("Low"))
    return filters.unchanged(filters.masked_rows(filters.confident(e), F.col("value") > 20)).select("event_id")


@query("models_with_events", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def models_with_events(spark, sf_dir):
    return filters.with_events(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("scaled_amplitudes", f"WITH {CELLS} SELECT vec_id, cell::INT AS cell, round(value * exp((label / 10.0 - 0.5) * (cell / 64.0)), 6) AS scaled FROM cells")
def scaled_amplitudes(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("x", F.col("cell") / F.lit(64.0))
    scales = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") / F.lit(10.0) - 0.5).alias("scale"))
    return robust.apply_scale(c, scales, "vec_id", "x", "value", "scaled").select("vec_id", "cell", *r6("scaled"))


CDF = "t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))"


@query("normality_statistics", f"""WITH {CELLS}, m AS (SELECT label, cell, avg(value) AS m, stddev_samp(value) AS s, count(*) AS n FROM cells GROUP BY ALL), r AS (SELECT label, cell, n, (value - m) / s AS x, row_number() OVER (PARTITION BY label, cell ORDER BY value) AS r FROM cells JOIN m USING (label, cell) WHERE s > 0),
t AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * abs(x) / sqrt(2.0::DOUBLE)) AS t FROM r), f AS (SELECT *, 0.5::DOUBLE * ({CDF}) * exp(-x * x / 2) AS h FROM t), g AS (SELECT *, CASE WHEN x >= 0 THEN 1 - h ELSE h END AS f FROM f)
SELECT label, cell::INT AS cell, max(n) AS n, round(max(greatest(r / n::DOUBLE - f, f - (r - 1) / n::DOUBLE)), 6) AS statistic FROM g GROUP BY ALL""")
def normality_statistics(spark, sf_dir):
    return robust.normality(cells(spark, sf_dir), ["label", "cell"], "value").select("label", "cell", "n", *r6("statistic"))


@query("difference_map", f"WITH {CELLS}, m AS (SELECT label, cell, avg(value) AS a, max(value) AS b FROM cells GROUP BY ALL) SELECT label, cell::INT AS cell, round(b - a, 6) AS difference FROM m")
def difference_map(spark, sf_dir):
    c = cells(spark, sf_dir).groupBy("label", "cell")
    return robust.difference(c.agg(F.max("value").alias("value")), c.agg(F.avg("value").alias("value")), ["label", "cell"]).select("label", "cell", *r6("difference"))


@query("rank_by_event_build", "WITH s AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events) SELECT event_id, row_number() OVER (ORDER BY CASE WHEN k > 10 THEN k END DESC NULLS LAST, event_id) AS rank FROM s")
def rank_by_event_build(spark, sf_dir):
    return ranking.rank_events(scored(spark, sf_dir).withColumn("build", F.when(F.col("k") > 10, F.col("k"))), "event_build", ["event_id"], score="build").select("event_id", "rank")


@query("sorted_tags", "SELECT c_name AS dtag, row_number() OVER (ORDER BY c_name) AS rank FROM customer")
def sorted_tags(spark, sf_dir):
    return ranking.sorted_by_tag(table(spark, sf_dir, "customer").select(F.col("c_name").alias("dtag")))


@query("table_interpolation", f"SELECT event_id, round({INTERP}, 6) AS p FROM events")
def table_interpolation(spark, sf_dir):
    knots = spark.createDataFrame(KNOTS, "x double, p double")
    return ranking.interpolate_table(table(spark, sf_dir, "events"), "value", knots).select("event_id", *r6("p"))


@query("build_conformers", """WITH l AS (SELECT DISTINCT l_suppkey AS dtag, l_returnflag AS ligand FROM lineitem), c AS (SELECT DISTINCT l_suppkey AS dtag, l_returnflag AS ligand, l_linenumber AS conformer FROM lineitem WHERE l_linenumber < 4)
SELECT o_orderkey AS event, dtag, ligand, conformer FROM (SELECT o_orderkey, o_custkey % 10 + 1 AS dtag FROM orders) JOIN l USING (dtag) JOIN c USING (dtag, ligand)""")
def build_conformers(spark, sf_dir):
    """Builds to make: each event with its dataset's ligands and their conformers."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("dtag"), F.col("l_returnflag").alias("ligand"), F.col("l_linenumber").alias("conformer"))
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), (F.col("o_custkey") % 10 + 1).alias("dtag"))
    return ev.build_tasks(events, li.select("dtag", "ligand").distinct(), li.where("conformer < 4").distinct()).select("event", "dtag", "ligand", "conformer")


#: Cells on a line, above their cutoff; islands are runs without a gap of more than 2.
ISLANDS = f"""{CELLS}, med AS (SELECT label, cell, quantile_cont(value, 0.5) AS median FROM cells GROUP BY ALL),
model AS (SELECT label, cell, median, greatest(quantile_cont(abs(value - median), 0.5) / 0.6745, 0.01) AS spread FROM cells JOIN med USING (label, cell) GROUP BY ALL),
zs AS (SELECT vec_id, label, cell, (value - median) / spread AS z FROM cells JOIN model USING (label, cell)), cut AS (SELECT vec_id, greatest(quantile_cont(z, 0.98), 2.0) AS cutoff FROM zs GROUP BY ALL),
over_ AS (SELECT vec_id, cell, z, CASE WHEN cell - lag(cell) OVER w <= 2 THEN 0 ELSE 1 END AS fresh FROM zs JOIN cut USING (vec_id) WHERE z > cutoff WINDOW w AS (PARTITION BY vec_id ORDER BY cell)),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY vec_id ORDER BY cell) AS i FROM over_),
event AS (SELECT vec_id, i, count(*) AS n_points, avg(cell) AS x, max(z) AS peak FROM island GROUP BY ALL),
strong AS (SELECT a.vec_id, a.i, a.n_points, a.x, a.peak, sum(b.n_points) AS local_strength FROM event a JOIN event b ON a.vec_id = b.vec_id AND abs(a.x - b.x) < 6 GROUP BY ALL)"""


def on_a_line(spark, sf_dir):
    z = robust.robust_z(cells(spark, sf_dir), ["label", "cell"], 0.01)
    return z.select("vec_id", (F.col("vec_id") * 64 + F.col("cell")).alias("place"), F.col("cell").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("zz"), "z")


@query("dataset_events", f"""WITH {ISLANDS}, kept AS (SELECT *, peak / (1 + peak) AS score FROM strong WHERE n_points * 2.0 > 1.0), good AS (SELECT * FROM kept WHERE score > 0.7), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i) AS event_idx FROM good)
SELECT vec_id, event_idx::INT AS event_idx, n_points, round(x, 6) AS x, local_strength::DOUBLE AS local_strength, round(score, 6) AS score FROM r WHERE event_idx <= 3""")
def dataset_events(spark, sf_dir):
    """From values to selected events: point-wise z, cutoffs, clusters, strength, size, score, renumbering and the three best of each dataset."""
    found = ev.process_models(on_a_line(spark, sf_dir), ["vec_id"], "place", 2.0, 1, 2.0, 1.0, 0.7)
    best = ev.select_events(found, "vec_id")
    return best.select("vec_id", "event_idx", "n_points", *r6("x"), (F.col("local_strength") / 2.0).alias("local_strength"), *r6("score"))


ORACLE["cell_events"] = f"WITH {ISLANDS} SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1)::INT AS event, n_points, n_points::DOUBLE AS size, x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, local_strength::DOUBLE AS local_strength FROM strong"
