"""Registered queries of structures, masks, projections and exchangeable model stages, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from outlyr.operators import events as ev
from outlyr.operators import geometry, robust, spatial, structures
from outlyr.plans.catalog import CELLS, MODEL, POINTS, cells, points
from outlyr.plans.registry import query
from outlyr.session import table


@query("merged_structures", """WITH a AS (SELECT l_suppkey AS dtag, l_linenumber % 2 AS model, l_returnflag AS chain, l_orderkey AS seq_id, l_orderkey * 8 + l_linenumber AS atom_no FROM lineitem),
c AS (SELECT dtag, model, chain, min(atom_no) AS o, max(seq_id) + 100 AS seq_id FROM a GROUP BY ALL), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dtag ORDER BY o) = 1)
SELECT dtag, model::BIGINT AS model, chain, seq_id, atom_no FROM a UNION ALL SELECT dtag, f.model, f.chain, f.seq_id, -s_nationkey FROM supplier JOIN f ON s_suppkey = dtag""")
def merged_structures(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    atoms = li.select(F.col("l_suppkey").cast("long").alias("dtag"), (F.col("l_linenumber") % 2).cast("long").alias("model"), F.col("l_returnflag").alias("chain"), F.col("l_orderkey").alias("seq_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("atom_no"))
    ligands = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("dtag"), F.lit("Z").alias("chain"), F.lit(1).alias("seq_id"), (-F.col("s_nationkey")).cast("long").alias("atom_no"))
    return structures.merged_structures(atoms, ligands)


NUMBERED = f"{POINTS}, a AS (SELECT label, x, y, z, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS atom, count(*) OVER (PARTITION BY label) AS n FROM pts)"


@query("symmetric_rmsd", f"""WITH {NUMBERED}, b AS (SELECT label, (atom + 1) % n AS "to", x + 0.1 * label AS bx, y + 0.3 * (atom % 2) AS by_, z AS bz FROM a),
m AS (SELECT label, k, sqrt(avg((x - bx) ** 2 + (y - by_) ** 2 + (z - bz) ** 2)) AS rmsd FROM (SELECT *, (atom + k) % n AS "to" FROM a, (SELECT unnest(range(3)) AS k)) JOIN b USING (label, "to") GROUP BY ALL)
SELECT label, arg_min(k, (rmsd, k)) AS match, round(min(rmsd), 6) AS rmsd FROM m GROUP BY label""")
def symmetric_rmsd(spark, sf_dir):
    w = Window.partitionBy("label")
    a = points(spark, sf_dir).withColumn("atom", F.row_number().over(w.orderBy("vec_id")) - 1).withColumn("n", F.count("*").over(w))
    b = a.select("label", ((F.col("atom") + 1) % F.col("n")).alias("atom"), (F.col("x") + F.lit(0.1) * F.col("label")).alias("x"), (F.col("y") + F.lit(0.3) * (F.col("atom") % 2)).alias("y"), "z")
    matches = a.select("label", "atom", "n", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>")).alias("match")).withColumn("to", (F.col("atom") + F.col("match")) % F.col("n"))
    return structures.symmetric_deviation(a, b, matches, ["label"], "atom").select("label", "match", F.round("rmsd", 6).alias("rmsd"))


@query("calibrated_builds", "SELECT l_orderkey, arg_min(l_linenumber, (l_extendedprice, l_linenumber)) AS l_linenumber, min(l_extendedprice) AS rmsd FROM lineitem WHERE l_discount > 0.02 GROUP BY l_orderkey")
def calibrated_builds(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice")).alias("rmsd"))
    return structures.calibrated(rows, ["l_orderkey"], ["l_linenumber"])


AROUND = ", unnest(range(floor({c} / 0.75)::BIGINT - 2, ceil({c} / 0.75)::BIGINT + 3)) AS {g}"


@query("grid_masks", f"""WITH {POINTS}, a AS (SELECT *{AROUND.format(c="x", g="u")} FROM pts), b AS (SELECT *{AROUND.format(c="y", g="v")} FROM a), d AS (SELECT *{AROUND.format(c="z", g="w")} FROM b),
e AS (SELECT u, v, w, min((u * 0.75 - x) ** 2 + (v * 0.75 - y) ** 2 + (w * 0.75 - z) ** 2) AS d FROM d GROUP BY ALL) SELECT u, v, w, d < 0.49 AS inner, d < 0.09 AS atomic FROM e WHERE d < 1.44""")
def grid_masks(spark, sf_dir):
    return geometry.grid_masks(points(spark, sf_dir), 0.75, 1.2, 0.7, 0.3)


@query("principal_distances", """WITH r AS (SELECT label, arg_min(embedding, vec_id) AS r FROM embeddings GROUP BY label)
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], r::DOUBLE[]), lambda p: (p[1] - p[2]) ** 2)), 5) AS distance FROM embeddings JOIN r USING (label)""")
def principal_distances(spark, sf_dir):
    """Squared distances to each label's first vector, over all main axes: the same as without them."""
    p = spatial.principal(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "embedding", 1000)
    first = F.broadcast(p.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("r")))  # a row a label: ten in these tables
    gap = F.aggregate(F.zip_with("embedding", "r", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return p.join(first, "label").select("vec_id", F.round(gap, 5).alias("distance"))


@query("build_metrics", f"""WITH {CELLS}, {MODEL}, e AS (SELECT vec_id, cell, z, greatest(least((value - 0.3 * median) / 0.7, 3.0), 0.0) AS v FROM zs)
SELECT vec_id, round(coalesce(sum(v) FILTER (z > 1.5), 0), 6) AS signal, round(coalesce(sum(v) FILTER (cell % 3 = 0), 0), 6) AS noise, count(*) FILTER (z > 1.5) AS num_points FROM e GROUP BY vec_id""")
def build_metrics(spark, sf_dir):
    z = robust.robust_z(cells(spark, sf_dir), ["label", "cell"]).withColumn("mask", F.col("cell") % 3 == 0)
    return robust.build_metrics(z, ["vec_id"], "value", "median", "z", "mask", F.lit(0.3), 1.5).select("vec_id", F.round("signal", 6).alias("signal"), F.round("noise", 6).alias("noise"), "num_points")


@query("evaluated_model", f"""WITH {CELLS}, {MODEL}, cut AS (SELECT vec_id, greatest(quantile_cont(z, 0.98), 2.0) AS cutoff FROM zs GROUP BY ALL), o AS (SELECT zs.* FROM zs JOIN cut USING (vec_id) WHERE z > cutoff),
e AS (SELECT vec_id, cell // 8 AS block, count(*) AS n_points, max(z) AS peak FROM o GROUP BY ALL) SELECT vec_id, block, n_points, round(peak / (1 + peak), 6) AS score FROM e WHERE n_points * 2.0 > 1.0 AND peak / (1 + peak) > 0.7""")
def evaluated_model(spark, sf_dir):
    outliers = lambda v: ev.thresholded(robust.robust_z(v, ["label", "cell"]), ["vec_id"])
    clusters = lambda o: o.groupBy("vec_id", F.floor(F.col("cell") / 8).alias("block")).agg(F.count("*").alias("n_points"), F.max("z").alias("peak"))
    found = ev.evaluate(cells(spark, sf_dir), outliers, clusters, [lambda e: ev.filter_size(e, 2.0, 1.0)], None, [lambda e: e.where("score > 0.7")])
    return found.select("vec_id", "block", "n_points", F.round("score", 6).alias("score"))
