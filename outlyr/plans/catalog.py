"""The registered queries: each operator over the whole test tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlyr.operators import events as ev
from outlyr.operators import filters, geometry, ranking, robust, sites, spatial
from outlyr.plans.registry import query
from outlyr.session import table
from outlyr.sources import outputs

CELLS = "cells AS (SELECT vec_id, label, u.i AS cell, embedding[u.i + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(64)) AS i) u)"
MODEL = """med AS (SELECT label, cell, quantile_cont(value, 0.5) AS median FROM cells GROUP BY ALL),
model AS (SELECT label, cell, median, greatest(quantile_cont(abs(value - median), 0.5) / 0.6745, 0.1) AS spread FROM cells JOIN med USING (label, cell) GROUP BY ALL),
zs AS (SELECT vec_id, label, cell, value, median, spread, (value - median) / spread AS z FROM cells JOIN model USING (label, cell))"""
POINTS = "pts AS (SELECT vec_id, label, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y, embedding[3]::DOUBLE * 20 AS z FROM embeddings)"
#: Knots of a score quantile table, for interpolation.
KNOTS = [(0.0, 0.05), (20.0, 0.1), (50.0, 0.4), (100.0, 0.8), (200.0, 0.95)]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.cells(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", "label")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[(e[i].cast("double") * 20).alias(c) for i, c in enumerate("xyz")])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


SCORED = "sc AS (SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k')::INT AS k FROM events)"


@query("robust_zscore_events", f"""WITH {CELLS}, {MODEL}, frac AS (SELECT label, vec_id, avg(CASE WHEN abs(z) > 2 THEN 1.0 ELSE 0.0 END) AS f, max(z) AS peak FROM zs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f DESC, vec_id) AS rank FROM frac)
SELECT label, vec_id, round(f, 6) AS fraction, round(peak, 6) AS peak, rank::INT AS rank FROM r WHERE rank <= 3""")
def robust_zscore_events(spark, sf_dir):
    z = robust.robust_z(cells(spark, sf_dir), ["label", "cell"])
    f = z.groupBy("label", "vec_id").agg(robust.outlying().alias("f"), F.max("z").alias("peak"))
    return ranking.top_k(f, ["label"], "f", ["vec_id"]).select("label", "vec_id", F.round("f", 6).alias("fraction"), F.round("peak", 6).alias("peak"), "rank")


@query("robust_z_cells", f"WITH {CELLS}, {MODEL} SELECT vec_id, cell::INT AS cell, round(median, 6) AS median, round(spread, 6) AS spread, round(z, 6) AS z FROM zs")
def robust_z_cells(spark, sf_dir):
    return robust.robust_z(cells(spark, sf_dir), ["label", "cell"]).select("vec_id", "cell", *[F.round(c, 6).alias(c) for c in ("median", "spread", "z")])


@query("mean_z_cells", f"WITH {CELLS}, m AS (SELECT label, cell, avg(value) AS mean, stddev_pop(value) AS std FROM cells GROUP BY ALL) SELECT vec_id, cell::INT AS cell, round(mean, 6) AS mean, round(std, 6) AS std, round((value - mean) / nullif(std, 0), 6) AS z FROM cells JOIN m USING (label, cell)")
def mean_z_cells(spark, sf_dir):
    return robust.mean_z(cells(spark, sf_dir), ["label", "cell"]).select("vec_id", "cell", *[F.round(c, 6).alias(c) for c in ("mean", "std", "z")])


@query("standardised_z", f"WITH {CELLS}, {MODEL}, m AS (SELECT vec_id, avg(z) AS a, stddev_pop(z) AS s FROM zs GROUP BY ALL) SELECT vec_id, cell::INT AS cell, round((z - a) / s, 6) AS z_scaled FROM zs JOIN m USING (vec_id)")
def standardised_z(spark, sf_dir):
    z = robust.robust_z(cells(spark, sf_dir), ["label", "cell"])
    return robust.standardised(z, ["vec_id"], "z", "z_scaled").select("vec_id", "cell", F.round("z_scaled", 6).alias("z_scaled"))


@query("threshold_cells", f"WITH {CELLS}, {MODEL}, c AS (SELECT vec_id, greatest(quantile_cont(z, 0.98), 2.0) AS cutoff FROM zs GROUP BY ALL) SELECT vec_id, round(cutoff, 6) AS cutoff, count(*) FILTER (z > cutoff) AS n FROM zs JOIN c USING (vec_id) GROUP BY vec_id, cutoff HAVING count(*) FILTER (z > cutoff) > 0")
def threshold_cells(spark, sf_dir):
    z = robust.robust_z(cells(spark, sf_dir), ["label", "cell"])
    return ev.thresholded(z, ["vec_id"]).groupBy("vec_id", F.round("cutoff", 6).alias("cutoff")).agg(F.count("*").alias("n"))


@query("masked_median", f"WITH {CELLS} SELECT vec_id, round(quantile_cont(value, 0.5) FILTER (cell < 32), 6) AS inner_median FROM cells GROUP BY vec_id")
def masked_median(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("vec_id").agg(F.round(robust.masked_median("value", F.col("cell") < 32), 6).alias("inner_median"))


@query("bin_means", """WITH s AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL),
b AS (SELECT l_returnflag, (floor((l_quantity - lo) / ((hi - lo) / 19.0)) + 1)::INT AS bin, avg(l_extendedprice) AS mean FROM lineitem JOIN s USING (l_returnflag) WHERE hi > lo GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY bin) AS a, row_number() OVER (PARTITION BY l_returnflag ORDER BY bin DESC) AS d FROM b)
SELECT l_returnflag, bin, round(mean, 4) AS mean FROM r WHERE a > 1 AND d > 2""")
def bin_means(spark, sf_dir):
    return robust.bin_means(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice").select("l_returnflag", "bin", F.round("mean", 4).alias("mean"))


@query("cluster_aggregates", f"WITH {POINTS} SELECT label, count(*) AS n, round(count(*) * 0.125, 6) AS size, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM pts GROUP BY label")
def cluster_aggregates(spark, sf_dir):
    return points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.round(F.count("*") * 0.125, 6).alias("size"), *[F.round(F.avg(c), 6).alias(c) for c in "xyz"])


@query("parameter_summary", "SELECT 'p_retailprice' AS measure, min(p_retailprice) AS min, round(avg(p_retailprice), 6) AS mean, max(p_retailprice) AS max FROM part UNION ALL SELECT 'p_size', min(p_size)::DOUBLE, round(avg(p_size), 6), max(p_size)::DOUBLE FROM part")
def parameter_summary(spark, sf_dir):
    return robust.summary(table(spark, sf_dir, "part"), ["p_retailprice", "p_size"]).select("measure", "min", F.round("mean", 6).alias("mean"), "max")


@query("value_counts", "SELECT p_brand, count(*) AS n, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS types, max(p_retailprice) AS worst FROM part GROUP BY p_brand")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_type")), " ").alias("types"), F.max("p_retailprice").alias("worst"))


@query("skip_reasons", """SELECT c_custkey, CASE WHEN NOT coalesce(c_acctbal, 0) < 9000 THEN 'R-free' WHEN NOT c_nationkey < 20 THEN 'resolution' WHEN NOT (n >= 10 AND n < 1000000) THEN 'range'
WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'excluded' WHEN c_mktsegment NOT IN ('HOUSEHOLD', 'AUTOMOBILE') THEN 'not in the list' END AS reason
FROM (SELECT *, regexp_extract_all(c_name, '[0-9]+')[-1]::BIGINT AS n FROM customer)""")
def skip_reasons(spark, sf_dir):
    rules = [
        (filters.below("c_acctbal", 9000, 0.0), "R-free"), (filters.below("c_nationkey", 20), "resolution"), (filters.in_range("c_name", "10-1000000"), "range"),
        (filters.not_listed("c_mktsegment", "MACHINERY, BUILDING"), "excluded"), (filters.listed("c_mktsegment", "HOUSEHOLD,AUTOMOBILE"), "not in the list"),
    ]
    return table(spark, sf_dir, "customer").select("c_custkey", filters.first_failure(rules).alias("reason"))


@query("filter_chain", "SELECT s_suppkey, s_acctbal FROM supplier WHERE coalesce(s_acctbal, 0) < 8000 AND s_nationkey < 20 AND s_name NOT IN ('Supplier#000000003') AND regexp_extract_all(s_name, '[0-9]+')[-1]::BIGINT >= 5 AND regexp_extract_all(s_name, '[0-9]+')[-1]::BIGINT < 100000")
def filter_chain(spark, sf_dir):
    steps = [filters.below("s_acctbal", 8000, 0.0), filters.below("s_nationkey", 20), filters.not_listed("s_name", "Supplier#000000003"), filters.in_range("s_name", "5-100000")]
    return filters.chain(table(spark, sf_dir, "supplier"), [lambda d, c=c: d.where(c) for c in steps]).select("s_suppkey", "s_acctbal")


@query("resolution_quota", """WITH p AS (SELECT t.s_suppkey AS target, c.s_suppkey AS member, c.s_acctbal AS res, t.s_acctbal AS ref, row_number() OVER (PARTITION BY t.s_suppkey ORDER BY c.s_acctbal, c.s_suppkey) AS r
FROM supplier t JOIN supplier c USING (s_nationkey)) SELECT target, member FROM p WHERE res < ref OR r <= 3 OR (r <= 5 AND res < ref + 500)""")
def resolution_quota(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a = s.select(F.col("s_suppkey").alias("target"), F.col("s_acctbal").alias("ref"), "s_nationkey")
    b = s.select(F.col("s_suppkey").alias("member"), F.col("s_acctbal").alias("res"), "s_nationkey")
    return filters.quota(a.join(b, "s_nationkey"), "target", "res", "member", "ref", 3, 5, 500.0).select("target", "member")


@query("comparator_groups", """WITH d AS (SELECT s_suppkey::VARCHAR AS dtag, s_acctbal AS resolution, s_nationkey AS sg, s_acctbal / 20000 AS rfree FROM supplier),
res AS (SELECT DISTINCT l_suppkey::VARCHAR AS dtag, l_linenumber AS residue FROM lineitem),
ok AS (SELECT t.dtag AS target, c.dtag AS member, c.resolution AS r, t.resolution AS ref FROM d t JOIN d c USING (sg) WHERE coalesce(c.rfree, 0) < 0.4
  AND NOT EXISTS (SELECT 1 FROM res x WHERE x.dtag = t.dtag AND NOT EXISTS (SELECT 1 FROM res y WHERE y.dtag = c.dtag AND y.residue = x.residue)) AND EXISTS (SELECT 1 FROM res x WHERE x.dtag = t.dtag)),
n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY r, member) AS k FROM ok), g AS (SELECT target, member FROM n WHERE r < ref OR k <= 4 OR (k <= 8 AND r < ref + 0.1) UNION SELECT dtag, dtag FROM d)
SELECT target, member FROM g WHERE target IN (SELECT target FROM g GROUP BY target HAVING count(*) >= 3)""")
def comparator_groups(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("dtag"), F.col("s_acctbal").alias("resolution"), F.col("s_nationkey").alias("spacegroup"), (F.col("s_acctbal") / 20000).alias("rfree"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("dtag"), F.col("l_linenumber").alias("residue"))
    return filters.comparators(d, r, d, 4, 8, 0.1, 0.4, 3)


@query("key_containment", "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)")
def key_containment(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return filters.containing(li, li, "l_suppkey", "l_linenumber")


@query("common_keys", "SELECT l_linenumber, l_quantity FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def common_keys(spark, sf_dir):
    return filters.common_keys(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_linenumber", "l_quantity"])


@query("truncate_keys", "WITH k AS (SELECT l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem SEMI JOIN k USING (l_partkey, l_linenumber) WHERE l_discount >= 0.02 GROUP BY l_suppkey")
def truncate_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kept = filters.truncate_keys(li.where("l_discount >= 0.02"), li.where("l_returnflag = 'R'"), ["l_partkey", "l_linenumber"])
    return kept.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


KNN = "near AS (SELECT a.label, a.vec_id AS item, b.vec_id AS neighbour, round(sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) ** 2 for x in list_zip(a.embedding, b.embedding)])), 9) AS distance FROM embeddings a JOIN embeddings b USING (label)), ranked AS (SELECT *, row_number() OVER (PARTITION BY label, item ORDER BY distance, neighbour <> item, neighbour) AS rank FROM near)"


@query("nearest_neighbours", f"WITH {KNN} SELECT label, item, neighbour, round(distance, 6) AS distance, rank::INT AS rank FROM ranked WHERE rank <= 5")
def nearest_neighbours(spark, sf_dir):
    return spatial.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5, ["label"]).select("label", "item", "neighbour", F.round("distance", 6).alias("distance"), "rank")


@query("claimed_sets", f"""WITH RECURSIVE {KNN}, k AS (SELECT label, item, avg(distance) AS radius, list(neighbour ORDER BY rank) AS near FROM ranked WHERE rank <= 24 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY radius, item) AS i FROM k),
walk AS (SELECT label, 0::BIGINT AS i, []::BIGINT[] AS taken, 0 AS set_no, false AS won, []::BIGINT[] AS near FROM (SELECT DISTINCT label FROM embeddings)
UNION ALL SELECT w.label, o.i, CASE WHEN list_has_any(w.taken, o.near) THEN w.taken ELSE list_concat(w.taken, o.near) END, CASE WHEN list_has_any(w.taken, o.near) THEN w.set_no ELSE w.set_no + 1 END, NOT list_has_any(w.taken, o.near), o.near FROM walk w JOIN o ON o.label = w.label AND o.i = w.i + 1),
sets AS (SELECT label, set_no, unnest(near) AS member FROM walk WHERE won), first AS (SELECT label, vec_id AS member, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings)
SELECT label, set_no::INT AS set_no, member FROM sets UNION ALL SELECT label, (coalesce(m, 0) + 1)::INT, member FROM first LEFT JOIN (SELECT label, max(set_no) AS m FROM sets GROUP BY label) USING (label) WHERE r <= 30""")
def claimed_sets(spark, sf_dir):
    """Disjoint neighbourhoods of 24, and the first 30 of each label as one more set."""
    return spatial.characterization_sets(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])


@query("first_members", "SELECT label, vec_id, rank::INT AS rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings) WHERE rank <= 30")
def first_members(spark, sf_dir):
    return ranking.renumber(table(spark, sf_dir, "embeddings").select("label", "vec_id"), ["label"], ["vec_id"], "rank").where("rank <= 30")


@query("pruned_sets", """WITH f AS (SELECT user_id, event_type, avg(CASE WHEN abs(value) > 60 THEN 1.0 ELSE 0.0 END) AS score FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score, event_type) AS k FROM f)
SELECT user_id, event_type, round(score, 6) AS score FROM r WHERE k <= 3 OR score < 0.2""")
def pruned_sets(spark, sf_dir):
    f = scored(spark, sf_dir).groupBy("user_id", "event_type").agg(robust.outlying("value", 60.0).alias("score"))
    return filters.prune_sets(f, "user_id", "score", "event_type").select("user_id", "event_type", F.round("score", 6).alias("score"))


BDC = """bs AS (SELECT i * 0.05::DOUBLE AS b FROM (SELECT unnest(range(20)) AS i)),
gaps AS (SELECT vec_id, b, round(abs(quantile_cont((value - b * median) / (1 - b), 0.5) - quantile_cont(median, 0.5)), 9) AS gap FROM zs, bs GROUP BY vec_id, b),
best AS (SELECT vec_id, arg_min(b, (gap, b)) AS b FROM gaps GROUP BY vec_id)"""


@query("background_fraction", f"WITH {CELLS}, {MODEL}, {BDC} SELECT vec_id, round(b, 4) AS b FROM best")
def background_fraction(spark, sf_dir):
    return robust.background_fraction(robust.robust_z(cells(spark, sf_dir), ["label", "cell"]), ["vec_id"]).select("vec_id", F.round("b", 4).alias("b"))


@query("fraction_sweep", f"WITH {CELLS}, {MODEL} SELECT vec_id, round(0.05 + i * 0.05, 2)::DOUBLE AS b, round(avg((value - round(0.05 + i * 0.05, 2)::DOUBLE * median) / (1 - round(0.05 + i * 0.05, 2)::DOUBLE)), 6) AS mean FROM zs, (SELECT unnest(range(11)) AS i) GROUP BY ALL")
def fraction_sweep(spark, sf_dir):
    z = robust.robust_z(cells(spark, sf_dir), ["label", "cell"])
    return outputs.fraction_sweep(z, "value", "median", ["vec_id"]).groupBy("vec_id", "b").agg(F.round(F.avg("corrected"), 6).alias("mean"))


@query("rank_by_site", "SELECT event_id, row_number() OVER (ORDER BY user_id, value DESC, event_id) AS rank FROM events")
def rank_by_site(spark, sf_dir):
    return ranking.rank_events(table(spark, sf_dir, "events"), "site", ["event_id"], site="user_id", score="value").select("event_id", "rank")


@query("rank_by_signal", f"WITH {SCORED} SELECT event_id, row_number() OVER (ORDER BY value / nullif(k, 0) * user_id DESC NULLS LAST, event_id) AS rank FROM sc")
def rank_by_signal(spark, sf_dir):
    return ranking.rank_events(scored(spark, sf_dir), "signal", ["event_id"], signal="value", noise="k", strength="user_id").select("event_id", "rank")


@query("rank_by_build", "WITH b AS (SELECT o_orderkey, coalesce(max(l_extendedprice), 0.0) AS build_score FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT o_orderkey, build_score, row_number() OVER (ORDER BY build_score DESC, o_orderkey) AS rank FROM b")
def rank_by_build(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return ranking.rank_by_build(table(spark, sf_dir, "orders").select("o_orderkey"), li, ["o_orderkey"], "l_extendedprice")


INTERP = "CASE WHEN value <= 0 THEN 0.05 WHEN value < 20 THEN 0.05 + (value - 0) * ((0.1 - 0.05) / 20) WHEN value < 50 THEN 0.1 + (value - 20) * ((0.4 - 0.1) / 30) WHEN value < 100 THEN 0.4 + (value - 50) * ((0.8 - 0.4) / 50) WHEN value < 200 THEN 0.8 + (value - 100) * ((0.95 - 0.8) / 100) ELSE 0.95 END::DOUBLE"


@query("hit_probability", f"""WITH p AS (SELECT event_id, user_id, value, {INTERP} AS p FROM events)
SELECT event_id, round(p, 6) AS p, round(1 - coalesce(product(1 - p) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1), 6) AS hit_in_site_probability FROM p""")
def hit_probability(spark, sf_dir):
    p = table(spark, sf_dir, "events").withColumn("p", ranking.interpolate(F.col("value"), KNOTS))
    return ranking.remaining_hit_probability(p, "user_id", "value", ["event_id"]).select("event_id", F.round("p", 6).alias("p"), F.round("hit_in_site_probability", 6).alias("hit_in_site_probability"))


@query("selected_events", """WITH best AS (SELECT user_id, arg_max(event_type, (value, -event_id)) AS event_type FROM events GROUP BY user_id),
r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS event_idx FROM events SEMI JOIN best USING (user_id, event_type))
SELECT user_id, event_type, event_id, value, event_idx::INT AS event_idx FROM r WHERE event_idx <= 3""")
def selected_events(spark, sf_dir):
    e = scored(spark, sf_dir).select("user_id", "event_type", F.col("event_id").alias("event"), F.col("value").alias("score"))
    return ev.select_events(ev.select_model(e, "user_id", "event_type"), "user_id").select("user_id", "event_type", F.col("event").alias("event_id"), F.col("score").alias("value"), "event_idx")


MERGES = {"raw": "l_extendedprice DESC, l_orderkey, l_linenumber", "best_build": "max(l_extendedprice) OVER (PARTITION BY l_suppkey, l_orderkey) DESC, l_orderkey, l_extendedprice DESC, l_linenumber", "event_score": "l_quantity DESC, l_orderkey, l_extendedprice, l_linenumber"}


def _merge(method: str) -> None:
    inner = f"SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, max(l_extendedprice) OVER (PARTITION BY l_suppkey, l_orderkey) AS top, l_quantity FROM lineitem"
    order = MERGES[method].replace("max(l_extendedprice) OVER (PARTITION BY l_suppkey, l_orderkey)", "top")
    sql = f"SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM ({inner}) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY {order}) = 1"

    @query(f"merge_{method}", sql)
    def run(spark, sf_dir):
        li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
        return ranking.select_merge(li, "l_suppkey", "l_orderkey", "l_quantity", "l_extendedprice", "l_linenumber", method).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


for _method in MERGES:
    _merge(_method)


@query("best_reference", "SELECT s_nationkey, arg_min(s_name, (s_acctbal, s_name)) AS reference FROM supplier GROUP BY s_nationkey")
def best_reference(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min_by("s_name", F.struct("s_acctbal", "s_name")).alias("reference"))


@query("local_strength", f"WITH {POINTS} SELECT a.vec_id, sum(b.label + 1)::BIGINT AS local_strength FROM pts a JOIN pts b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 1.5 ** 2 GROUP BY a.vec_id")
def local_strength(spark, sf_dir):
    return ev.local_strength(points(spark, sf_dir).withColumn("size", F.col("label") + 1), "vec_id", "size", 1.5).select("vec_id", "local_strength")


@query("nearest_site", f"""WITH {POINTS}, c AS (SELECT label AS site, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY label),
d AS (SELECT vec_id, site, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS distance FROM pts, c)
SELECT vec_id, arg_min(site, (distance, site)) AS site, round(min(distance), 6) AS distance FROM d WHERE distance < 6 GROUP BY vec_id""")
def nearest_site(spark, sf_dir):
    p = points(spark, sf_dir)
    c = p.groupBy(F.col("label").alias("site")).agg(*[F.avg(k).alias(f"c{k}") for k in "xyz"])
    return spatial.nearest(p.select("vec_id", *"xyz"), c, "vec_id", "site", 6.0, right_xyz=("cx", "cy", "cz")).select("vec_id", "site", F.round("distance", 6).alias("distance"))


@query("environment_contacts", f"WITH {POINTS} SELECT a.vec_id, count(DISTINCT b.label) AS contacts FROM pts a JOIN pts b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 1.0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id")
def environment_contacts(spark, sf_dir):
    p = points(spark, sf_dir)
    b = p.select(F.col("vec_id").alias("other"), F.col("label").alias("residue"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    near = spatial.range_join(p, b, 1.0, right_xyz=("ax", "ay", "az")).where("vec_id <> other")
    return near.groupBy("vec_id").agg(F.count_distinct("residue").alias("contacts"))


COMPONENTS = "reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"


@query("overlap_sites", """WITH RECURSIVE env AS (SELECT DISTINCT l_suppkey AS event, l_partkey // 40 AS residue FROM lineitem),
links AS MATERIALIZED (SELECT a.event AS a, b.event AS b FROM env a JOIN env b USING (residue) GROUP BY ALL HAVING count(*) > 22),
reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS event, min(b) AS site FROM reach GROUP BY a""")
def overlap_sites(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("event"), F.expr("l_partkey div 40").alias("residue")).distinct()
    return sites.overlap_components(e, 22)


@query("density_clusters", f"""WITH RECURSIVE {POINTS}, near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM pts a JOIN pts b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.75),
core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5), links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), {COMPONENTS},
comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a)
SELECT near.a AS vec_id, coalesce(max(own.c), min(comp.c)) AS cluster FROM near JOIN comp ON comp.id = near.b LEFT JOIN comp own ON own.id = near.a GROUP BY near.a""")
def density_clusters(spark, sf_dir):
    return spatial.dbscan(points(spark, sf_dir), "vec_id", 0.75, 5).select("vec_id", "cluster")


@query("cell_events")
def cell_events(spark, sf_dir):
    """Thresholded cells of every vector, at places along a line, as density clusters with size and strength."""
    z = ev.thresholded(robust.robust_z(cells(spark, sf_dir), ["label", "cell"], 0.01), ["vec_id"])
    placed = z.select("vec_id", (F.col("vec_id") * 64 + F.col("cell")).alias("place"), F.col("cell").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return ev.local_strength(ev.cluster_events(placed, ["vec_id"], "place", 2.0, 1), "event", "size", group=["vec_id"])


@query("suppressed_points", f"""WITH RECURSIVE {POINTS}, o AS (SELECT pts.*, row_number() OVER (PARTITION BY label ORDER BY embedding[4] DESC, vec_id) AS i FROM pts JOIN (SELECT vec_id, embedding FROM embeddings) USING (vec_id)),
walk AS (SELECT label, 0::BIGINT AS i, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[] AS kept FROM (SELECT DISTINCT label FROM embeddings)
UNION ALL SELECT w.label, o.i, CASE WHEN len([p for p in w.kept if sqrt((p.x - o.x) ** 2 + (p.y - o.y) ** 2 + (p.z - o.z) ** 2) < 1.5]) > 0 THEN w.kept ELSE list_append(w.kept, {{'id': o.vec_id, 'x': o.x, 'y': o.y, 'z': o.z}}) END FROM walk w JOIN o ON o.label = w.label AND o.i = w.i + 1)
SELECT label, unnest(kept).id AS vec_id FROM (SELECT label, arg_max(kept, i) AS kept FROM walk GROUP BY label)""")
def suppressed_points(spark, sf_dir):
    """Greedy suppression by score within each label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[3].alias("score"))
    return spatial.suppress(points(spark, sf_dir).join(e, "vec_id"), ["label"], "vec_id", "score", 1.5).select("label", "vec_id")


@query("hierarchical_sites", f"""WITH RECURSIVE {POINTS}, step AS (SELECT 0 AS k, vec_id AS event, vec_id AS c, x, y, z FROM pts
UNION ALL SELECT k + 1, event, CASE WHEN c = b THEN a ELSE c END, x, y, z FROM step, (SELECT p.c AS a, q.c AS b
  FROM (SELECT c, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM step GROUP BY c) p JOIN (SELECT c, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM step GROUP BY c) q ON p.c < q.c
  WHERE sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) <= 2.0 ORDER BY (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2, a, b LIMIT 1)),
found AS (SELECT event, dense_rank() OVER (ORDER BY c) AS cluster FROM step WHERE k = (SELECT max(k) FROM step)), known AS (SELECT vec_id AS event, vec_id // 100 + 1 AS site FROM pts WHERE vec_id % 50 = 3),
claim AS (SELECT cluster, min(site) AS site FROM found JOIN known USING (event) GROUP BY cluster), fresh AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS n FROM (SELECT DISTINCT cluster FROM found) ANTI JOIN claim USING (cluster))
SELECT event, coalesce(known.site, claim.site, n + (SELECT max(site) FROM known))::INT AS site FROM found LEFT JOIN known USING (event) LEFT JOIN claim USING (cluster) LEFT JOIN fresh USING (cluster)""")
def hierarchical_sites(spark, sf_dir):
    """Centroid linkage of all points, merged with sites known from an earlier run."""
    c = points(spark, sf_dir).select(F.col("vec_id").alias("event"), *"xyz")
    known = c.where("event % 50 = 3").select("event", (F.floor(F.col("event") / 100) + 1).cast("int").alias("site"))
    return sites.get_sites("hierarchical", known, centroids=c, t=2.0)


@query("contour_levels", """WITH lv AS (SELECT i, 1.0 + i * (49.0 / 99) AS level FROM (SELECT unnest(range(100)) AS i)),
k AS (SELECT l_suppkey, l_returnflag = 'R' AS inside, least(greatest(floor((l_quantity - 1.0) / (49.0 / 99)) + 1, 0), 100)::INT AS reach, count(*) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT l_suppkey, i, level, sum(CASE WHEN reach > i THEN CASE WHEN inside THEN n ELSE -n END ELSE 0 END) AS gain FROM k, lv GROUP BY ALL)
SELECT l_suppkey, round(arg_max(level, (gain, -i)), 6)::DOUBLE AS contour, max(gain)::BIGINT AS gain FROM g GROUP BY l_suppkey""")
def contour_levels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("inside", F.col("l_returnflag") == "R")
    return robust.optimal_contour(li, "l_suppkey", "l_quantity", "inside", 1.0, 50.0).select("l_suppkey", F.round("contour", 6).alias("contour"), "gain")


@query("signal_noise", """SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN least(greatest(l_discount * 50, 0), 3) ELSE 0 END), 6) AS signal, round(sum(CASE WHEN l_returnflag <> 'R' THEN least(greatest(l_discount * 50, 0), 3) ELSE 0 END), 6) AS noise,
count(*) FILTER (l_returnflag = 'R' AND l_discount * 50 >= 2) AS n_signal, count(*) FILTER (l_returnflag <> 'R' AND l_discount * 50 >= 2) AS n_noise FROM lineitem GROUP BY l_suppkey""")
def signal_noise(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_discount") * 50)
    g = li.groupBy("l_suppkey").agg(*robust.signal_noise("v", F.col("l_returnflag") == "R", 2.0))
    return g.select("l_suppkey", F.round("signal", 6).alias("signal"), F.round("noise", 6).alias("noise"), "n_signal", "n_noise")


@query("map_correlation", f"WITH {CELLS}, {MODEL} SELECT vec_id, round(corr(value, median), 6) AS corr FROM zs GROUP BY vec_id")
def map_correlation(spark, sf_dir):
    return robust.robust_z(cells(spark, sf_dir), ["label", "cell"]).groupBy("vec_id").agg(F.round(F.corr("value", "median"), 6).alias("corr"))


@query("atom_standardised", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round((l_extendedprice - avg(l_extendedprice) OVER w) / nullif(stddev_samp(l_extendedprice) OVER w, 0), 6) AS scaled FROM lineitem WINDOW w AS (PARTITION BY l_linenumber, l_quantity)")
def atom_standardised(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy("l_linenumber", "l_quantity").agg(F.avg("l_extendedprice").alias("a"), F.stddev_samp("l_extendedprice").alias("s"))
    j = li.join(m, ["l_linenumber", "l_quantity"])
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(F.try_divide(F.col("l_extendedprice") - F.col("a"), F.expr("nullif(s, 0)")), 6).alias("scaled"))


def _poly(c: tuple[float, ...]) -> str:
    return reduce(lambda s, x: f"(({s}) * r * r + {x!r}::DOUBLE)", c[1:], f"{c[0]!r}::DOUBLE")


@query("regression_spread", f"""WITH {CELLS}, k AS (SELECT vec_id, value, (row_number() OVER (PARTITION BY vec_id ORDER BY value) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY vec_id) - 0.5::DOUBLE AS r FROM cells)
SELECT vec_id, round(regr_slope(value, {_poly(robust.QUANTILE_A)} * r / {_poly(robust.QUANTILE_B)}), 6) AS spread FROM k WHERE abs(r) < 1 / 3.0::DOUBLE GROUP BY vec_id""")
def regression_spread(spark, sf_dir):
    """Spread of each vector's cells by the slope on normal quantiles."""
    return robust.regression_spread(cells(spark, sf_dir), "vec_id", "value").select("vec_id", F.round("spread", 6).alias("spread"))


@query("scale_fit", f"""WITH {CELLS}, ref AS (SELECT label, cell, avg(value) + 1 AS ry FROM cells GROUP BY ALL), j AS (SELECT vec_id, cell::DOUBLE / 64 AS x, value + 1 AS my, ry FROM cells JOIN ref USING (label, cell)),
b AS (SELECT *, (floor((x - 0.0) / ((63.0 / 64 - 0.0) / 19.0)) + 1)::INT AS bin FROM j), s AS (SELECT i, -15 + i * 0.5::DOUBLE AS s FROM (SELECT unnest(range(61)) AS i)),
m AS (SELECT vec_id, bin, s, avg(ry) AS r, avg(my * exp(s * x)) AS t FROM b, s GROUP BY ALL), k AS (SELECT *, dense_rank() OVER (PARTITION BY vec_id ORDER BY bin) AS a, dense_rank() OVER (PARTITION BY vec_id ORDER BY bin DESC) AS d FROM m),
g AS (SELECT vec_id, s, round(sum(abs(r - t)), 6) AS gap FROM k WHERE a > 1 AND d > 2 GROUP BY ALL)
SELECT vec_id, arg_min(s, (gap, s)) AS scale FROM g GROUP BY vec_id""")
def scale_fit(spark, sf_dir):
    c = cells(spark, sf_dir)
    ref = c.groupBy("label", "cell").agg((F.avg("value") + 1).alias("ry")).withColumn("x", F.col("cell").cast("double") / 64)
    return robust.scale_fit(ref, c.withColumn("ry", F.col("value") + 1), "vec_id", ["label", "cell"], "x", "ry")


@query("correlation_fraction", f"""WITH {CELLS}, {MODEL}, bs AS (SELECT i * 0.05::DOUBLE AS b FROM (SELECT unnest(range(20)) AS i)),
c AS (SELECT vec_id, b, round(corr((value - b * median) / (1 - b), z), 9) AS corr FROM zs, bs GROUP BY ALL)
SELECT vec_id, round(max(corr), 6) AS corr FROM c GROUP BY vec_id""")
def correlation_fraction(spark, sf_dir):
    z = robust.robust_z(cells(spark, sf_dir), ["label", "cell"])
    return robust.correlation_fraction(z, ["vec_id"], "value", "median", "z").select("vec_id", F.round("corr", 6).alias("corr"))


@query("event_table", f"""WITH {SCORED}, p AS (SELECT *, {INTERP} AS p FROM sc), h AS (SELECT *, 1 - coalesce(product(1 - p) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS hit, row_number() OVER (ORDER BY user_id, value DESC, event_id) AS rank FROM p)
SELECT rank, user_id::VARCHAR AS dtag, event_id::INT AS event_idx, user_id::INT AS site_idx, round_even(value, 2) AS z_mean, k AS cluster_size, round(hit, 6) AS hit_in_site_probability, round_even(1 - k / 100.0::DOUBLE, 2) AS "1-BDC" FROM h""")
def event_table(spark, sf_dir):
    p = scored(spark, sf_dir).withColumn("p", ranking.interpolate(F.col("value"), KNOTS))
    h = ranking.rank_by_site(ranking.remaining_hit_probability(p, "user_id", "value", ["event_id"]), "user_id", "value", ["event_id"])
    tag = F.col("user_id").cast("string").alias("dtag")
    e = h.select("rank", tag, F.col("event_id").cast("int").alias("event_idx"), (F.col("k") / F.lit(100.0)).alias("bdc"), F.col("k").alias("n_points"), *[F.lit(0.0).alias(c) for c in "xyz"], F.col("value").alias("score"), F.lit(0.0).alias("build_score"), F.round("hit_in_site_probability", 6).alias("hit_in_site_probability"))
    s = h.select(tag, F.col("event_id").cast("int").alias("event_idx"), F.col("user_id").cast("int").alias("site_idx"))
    d = h.select(tag).distinct().select("dtag", F.lit(2.0).alias("resolution"), F.lit(0.2).alias("rfree"), F.lit(0.2).alias("rwork"))
    return outputs.event_table(e, d, s).select("rank", "dtag", "event_idx", "site_idx", "z_mean", "cluster_size", "hit_in_site_probability", "1-BDC")


@query("review_upsert", f"WITH {SCORED} SELECT event_id, coalesce(CASE WHEN k > 50 THEN 'High' END, 'Low') AS confidence, coalesce(CASE WHEN k > 50 THEN 'seen' END, '') AS comment FROM sc")
def review_upsert(spark, sf_dir):
    t = scored(spark, sf_dir).select(F.col("user_id").alias("dtag"), F.col("event_id").alias("event_idx"), "k")
    old = t.where("k > 50").select("dtag", "event_idx", F.lit(True).alias("Interesting"), F.lit(True).alias("Ligand Placed"), F.lit("High").alias("Ligand Confidence"), F.lit("seen").alias("Comment"), F.lit(True).alias("Viewed"))
    return outputs.inspect_table(t.drop("k"), old).select(F.col("event_idx").alias("event_id"), F.col("Ligand Confidence").alias("confidence"), F.col("Comment").alias("comment"))


@query("last_wins", "SELECT p_partkey, p_retailprice FROM part WHERE p_size <= 10 UNION ALL SELECT p_partkey, p_retailprice * 2 FROM part WHERE p_size > 10")
def last_wins(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    new = p.where("p_size > 10").select("p_partkey", (F.col("p_retailprice") * 2).alias("p_retailprice"))
    return ranking.last_wins(p.drop("p_size"), new, ["p_partkey"])


@query("size_and_score_filter", f"WITH {SCORED} SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS event FROM sc WHERE k * 0.5 > 5.0 AND value > 15")
def size_and_score_filter(spark, sf_dir):
    e = ev.filter_size(scored(spark, sf_dir), 0.5, 5.0, "k")
    return ev.filter_score(e, ["user_id"], 15.0, "event_id", "value").select("user_id", "event_id", "event")


@query("symmetry_filter", f"""WITH {POINTS}, i AS (SELECT p.vec_id, sqrt((p.x - (s * p.x + a)) ** 2 + (p.y - (s * p.y + b)) ** 2 + (p.z - (p.z + c)) ** 2) AS d FROM pts p, (SELECT unnest([1, -1]) AS s), (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b), (SELECT unnest(range(-1, 2)) AS c))
SELECT vec_id FROM i WHERE d > 1e-6 GROUP BY vec_id HAVING min(d) > 0.9""")
def symmetry_filter(spark, sf_dir):
    row = lambda s: [float(s), 0.0, 0.0, 0.0, float(s), 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    ops = spark.createDataFrame([tuple(row(1)), tuple(row(-1))], [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)] + ["t1", "t2", "t3"])
    return ev.symmetry_clear(points(spark, sf_dir), ops, "vec_id", 0.9).select("vec_id")


@query("superposition", "SELECT label, [0, 1, 0, -1, 0, 0, 0, 0, 1]::DOUBLE[] AS mat, 0.0::DOUBLE AS rmsd FROM embeddings GROUP BY label")
def superposition(spark, sf_dir):
    """Each label's first points laid on themselves after a known rotation."""
    p = points(spark, sf_dir)
    pairs = p.select("label", *[F.col(c).alias(f"r{c}") for c in "xyz"], (-F.col("y") + 1).alias("mx"), (F.col("x") + 2).alias("my"), (F.col("z") + 3).alias("mz"))
    return geometry.superpose(pairs, ["label"]).select("label", F.transform("mat", lambda v: F.round(v, 6) + 0.0).alias("mat"), F.round("rmsd", 6).alias("rmsd"))
