"""Registered queries of maps: Fourier transforms, and each dataset's map read under its residues' transforms, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlyr.operators import fourier, geometry
from outlyr.plans.catalog import POINTS, points
from outlyr.plans.registry import query
from outlyr.session import table

#: 64 values of a vector as a map of 4 x 4 x 4.
MAPS = "map AS (SELECT vec_id, i // 16 AS u, i // 4 % 4 AS v, i % 4 AS w, embedding[i + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(64)) AS i))"


def maps(spark, sf_dir, *keep):
    e = table(spark, sf_dir, "embeddings").select(*keep, F.posexplode("embedding").alias("i", "value"))
    return e.select(*keep, F.floor(F.col("i") / 16).cast("int").alias("u"), (F.floor(F.col("i") / 4) % 4).cast("int").alias("v"), (F.col("i") % 4).alias("w"), F.col("value").cast("double").alias("value"))


def r6(*columns):
    """Rounded, and without a negative zero."""
    return [(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in columns]


REFLECTIONS = """refl AS (SELECT l_returnflag AS dtag, (l_linenumber % 4)::INT AS h, (l_suppkey % 5 - 2)::INT AS k, (1 + l_partkey % 3)::INT AS l, sum(l_quantity) / 1000 AS f, avg(l_discount) * 3600 AS phi FROM lineitem GROUP BY ALL)"""


@query("grid_from_amplitudes", f"""WITH {REFLECTIONS}, side AS (SELECT unnest(range(8)) AS n)
SELECT dtag, u.n::INT AS u, v.n::INT AS v, w.n::INT AS w, round(sum(2 * f * cos(radians(phi) - 2 * pi() * (h * u.n + k * v.n + l * w.n) / 8)) / 100, 6) + 0.0 AS value FROM refl, side u, side v, side w GROUP BY ALL""")
def grid_from_amplitudes(spark, sf_dir):
    """Maps of three datasets from one of each pair of mates, against direct sums."""
    li = table(spark, sf_dir, "lineitem")
    refl = li.groupBy(F.col("l_returnflag").alias("dtag"), (F.col("l_linenumber") % 4).cast("int").alias("h"), (F.col("l_suppkey") % 5 - 2).cast("int").alias("k"), (1 + F.col("l_partkey") % 3).cast("int").alias("l"))
    refl = refl.agg((F.sum("l_quantity") / 1000).alias("f"), (F.avg("l_discount") * 3600).alias("phi"))
    return fourier.grid_from_amplitudes(refl, ["dtag"], (8, 8, 8), 100.0).select("dtag", "u", "v", "w", *r6(("value", F.col("value"))))


@query("amplitudes_from_grid", f"""WITH {MAPS}, idx AS (SELECT h, k, l FROM (SELECT unnest(range(-1, 3)) AS h), (SELECT unnest(range(-1, 3)) AS k), (SELECT unnest(range(-1, 3)) AS l)
  WHERE l % 2 = 1 AND l > 0 OR l % 2 = 0 AND (k = 1 OR k % 2 = 0 AND (h % 2 = 0 OR h = 1))),
f AS (SELECT vec_id, h, k, l, 2.5 * sum(value * cos(2 * pi() * (h * u + k * v + l * w) / 4)) / 64 AS a, 2.5 * sum(value * sin(2 * pi() * (h * u + k * v + l * w) / 4)) / 64 AS b FROM map, idx GROUP BY ALL)
SELECT vec_id, h::INT AS h, k::INT AS k, l::INT AS l, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(sqrt(a * a + b * b), 6) AS f FROM f""")
def amplitudes_from_grid(spark, sf_dir):
    """The amplitudes of every vector as a map, by their real and imaginary parts."""
    found = fourier.amplitudes_from_grid(maps(spark, sf_dir, "vec_id"), ["vec_id"], (4, 4, 4), 2.5)
    part = lambda turn: F.col("f") * turn(F.radians("phi"))
    return found.select("vec_id", *[F.col(c).cast("int").alias(c) for c in "hkl"], *r6(("a", part(F.cos)), ("b", part(F.sin)), ("f", F.col("f"))))


@query("aligned_values", f"""WITH {POINTS}, {MAPS}, own AS (SELECT label, u, v, w, avg(value) AS value FROM map JOIN embeddings USING (vec_id) GROUP BY ALL),
placed AS (SELECT label, vec_id, CASE vec_id % 2 WHEN 0 THEN x + 0.25 * label ELSE 1 - y END / 0.5 AS gx, CASE vec_id % 2 WHEN 0 THEN y ELSE x - 1 END / 0.5 AS gy, z / 0.5 AS gz FROM pts),
c AS (SELECT label, vec_id, ((floor(gx)::INT + a) % 4 + 4) % 4 AS u, ((floor(gy)::INT + b) % 4 + 4) % 4 AS v, ((floor(gz)::INT + d) % 4 + 4) % 4 AS w,
  (CASE a WHEN 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE b WHEN 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) * (CASE d WHEN 1 THEN gz - floor(gz) ELSE 1 - (gz - floor(gz)) END) AS weight
  FROM placed, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS d))
SELECT label, vec_id, round(sum(weight * value), 6) + 0.0 AS value FROM c JOIN own USING (label, u, v, w) GROUP BY ALL""")
def aligned_values(spark, sf_dir):
    """Each label is a dataset with a map of its own, which is read at its points moved back by one of two transforms."""
    grid = maps(spark, sf_dir, "label").groupBy("label", "u", "v", "w").agg(F.avg("value").alias("value"))
    samples = points(spark, sf_dir).withColumn("residue", F.col("vec_id") % 2)
    labels = samples.select("label").distinct()
    three = lambda *xs: F.array(*[x if not isinstance(x, float) else F.lit(x) for x in xs])
    turn = F.array(*[F.lit(float(x)) for x in (0, 1, 0, -1, 0, 0, 0, 0, 1)])
    still = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    shift = labels.select("label", F.lit(0).cast("long").alias("residue"), still.alias("mat"), three(F.lit(0.25) * F.col("label"), 0.0, 0.0).alias("com_mov"), three(0.0, 0.0, 0.0).alias("com_ref"))
    turned = labels.select("label", F.lit(1).cast("long").alias("residue"), turn.alias("mat"), three(1.0, 0.0, 0.0).alias("com_mov"), three(1.0, 0.0, 0.0).alias("com_ref"))
    read = geometry.aligned_maps(samples, grid, shift.unionByName(turned), ["label"], "vec_id", "residue", 0.5, (4, 4, 4))
    return read.select("label", "vec_id", *r6(("value", F.col("value"))))
