"""Ranks, arg-max, top-k, interpolation and tail probabilities over events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def renumber(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], out: str, first: int = 1) -> DataFrame:
    """Number the rows of each group from ``first`` on."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) + F.lit(first - 1))


def top_k(df: DataFrame, group: Sequence[str], score: str, tie: Sequence[str], k: int = 3, out: str = "rank") -> DataFrame:
    """The k highest scores of each group, numbered 1..k."""
    return renumber(df, group, [F.desc(score), *tie], out).where(F.col(out) <= k)


def arg_max(df: DataFrame, group: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """The row with the highest score of each group; of equals the first by ``tie``."""
    return top_k(df, group, score, tie, 1, "_r").drop("_r")


def rank_by_signal(df: DataFrame, signal: str, noise: str, strength: str, tie: Sequence[str]) -> DataFrame:
    """Global rank by signal / noise times local strength, descending; no noise ranks last."""
    return ranked(df.withColumn("_k", F.try_divide(F.col(signal), F.col(noise)) * F.col(strength)), [F.col("_k").desc_nulls_last(), *tie]).drop("_k")


def rank_by_site(df: DataFrame, site: str, score: str, tie: Sequence[str]) -> DataFrame:
    """Rank by site ascending, then score descending."""
    return ranked(df, [F.asc(site), F.desc(score), *tie])


def rank_by_build(events: DataFrame, builds: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Rank by the highest build score of an event; 0 where it has none."""
    best = builds.groupBy(*keys).agg(F.max(score).alias("build_score"))
    joined = events.join(best, list(keys), "left").withColumn("build_score", F.coalesce("build_score", F.lit(0.0)))
    return ranked(joined, [F.desc("build_score"), *keys])


def rank_by_event_build(df: DataFrame, score: str, tie: Sequence[str]) -> DataFrame:
    """Rank by the score of the build that an event carries, descending; none ranks last."""
    return ranked(df, [F.col(score).desc_nulls_last(), *tie])


def rank_by_best_build(df: DataFrame, builds: DataFrame, score: str, tie: Sequence[str]) -> DataFrame:
    """``rank_by_build`` with the keys as tie-breakers."""
    return rank_by_build(df, builds, tie, score)


def sorted_by_tag(df: DataFrame, tag: str = "dtag") -> DataFrame:
    """``df`` with its rank by name."""
    return ranked(df, [tag])


def rank_events(df: DataFrame, method: str, tie: Sequence[str], **columns: str) -> DataFrame:
    """Rank by a named method: ``site``, ``signal``, ``build`` or ``event_build``."""
    methods = {"site": rank_by_site, "signal": rank_by_signal, "build": rank_by_best_build, "event_build": rank_by_event_build}
    return methods[method](df, tie=tie, **columns)


def ranked(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """A global rank 1..n without one task for all rows: ranges are sorted, counted and offset."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    from outlyr.operators.spatial import ensure_checkpoints

    ensure_checkpoints(df.sparkSession)
    dealt = dealt.checkpoint()
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", "_first", before.alias("_before"))
    return dealt.join(offsets, "_p").withColumn("rank", (F.col("_before") + F.col("_i") - F.col("_first") + 1).cast("long")).drop("_p", "_i", "_first", "_before")


def interpolate(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation on knots (x, p) in ascending order, clamped at both ends."""
    out = F.lit(float(knots[-1][1]))
    for (x0, p0), (x1, p1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(x < x1, F.lit(float(p0)) + (x - F.lit(float(x0))) * F.lit((p1 - p0) / (x1 - x0))).otherwise(out)
    return F.when(x <= knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)


#: Up to so many knots (16 bytes each) are broadcast as an array.
FEW_KNOTS = 1000


def _between() -> Column:
    """The value at _x between the knots _a and _b around it; where one is missing, the other's."""
    slope = F.try_divide(F.col("_b.p") - F.col("_a.p"), F.col("_b.x") - F.col("_a.x"))
    line = F.col("_a.p") + (F.col("_x") - F.col("_a.x")) * F.coalesce(slope, F.lit(0.0))
    return F.when(F.col("_x").isNull(), F.lit(None).cast("double")).when(F.col("_a").isNull(), F.col("_b.p")).when(F.col("_b").isNull(), F.col("_a.p")).otherwise(line)


def interpolate_table(df: DataFrame, x: str, table: DataFrame, out: str = "p") -> DataFrame:
    """Interpolation on a quantile table (x, p) of any length, clamped at both ends; of equal x the largest p counts.

    Up to FEW_KNOTS knots are broadcast as one sorted array. More are ranked together with the rows by x, so that a row finds the knots around it in its own
    range or, at a range's edge, in what the ranges before and after have; nothing is gathered but one knot a range.
    """
    from outlyr.operators.spatial import ensure_checkpoints

    ensure_checkpoints(df.sparkSession)
    knots = table.groupBy(F.col("x").cast("double").alias("_x")).agg(F.max(F.col("p").cast("double")).alias("_p")).where("_x is not null")
    knot = F.struct(F.col("_x").alias("x"), F.col("_p").alias("p"))
    if knots.count() <= FEW_KNOTS:
        one = F.broadcast(knots.agg(F.sort_array(F.collect_list(knot)).alias("_k")))  # one row
        a = df.crossJoin(one).withColumn("_x", F.col(x).cast("double"))
        a = a.withColumn("_a", F.try_element_at(F.filter("_k", lambda k: k["x"] <= F.col("_x")), F.lit(-1))).withColumn("_b", F.get(F.filter("_k", lambda k: k["x"] >= F.col("_x")), F.lit(0)))
        return a.select(*df.columns, _between().alias(out))
    none = F.lit(None).cast("struct<x: double, p: double>")
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(x).cast("double").alias("_x"), none.alias("_k"))
    both = rows.unionByName(knots.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_x", knot.alias("_k")))
    dealt = both.repartitionByRange("_x").withColumn("_r", F.spark_partition_id()).checkpoint()
    edges = dealt.groupBy("_r").agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))  # one row a range
    order = Window.orderBy("_r")
    edges = edges.select("_r", F.last("_hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_lo", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    up = Window.partitionBy("_r").orderBy("_x")
    a = dealt.withColumn("_a", F.last("_k", True).over(up)).withColumn("_b", F.last("_k", True).over(Window.partitionBy("_r").orderBy(F.desc("_x"))))
    a = a.where("_row is not null").join(F.broadcast(edges), "_r").withColumn("_a", F.coalesce("_a", "_before")).withColumn("_b", F.coalesce("_b", "_after"))
    return a.select("_row.*", _between().alias(out))


def remaining_hit_probability(df: DataFrame, site: str, score: str, tie: Sequence[str], p: str = "p", out: str = "hit_in_site_probability") -> DataFrame:
    """1 - prod(1 - p) over the events ranked after this one in its site; 0 for the last.

    Events are dealt by ranges of site and rank, so that no site has to fit a task: the products of a site's
    later ranges (a row for each range, and one more for each site) meet those inside the own one.
    """
    from outlyr.operators.spatial import ensure_checkpoints

    ensure_checkpoints(df.sparkSession)
    after = (1, Window.unboundedFollowing)
    dealt = df.repartitionByRange(F.col(site), F.desc(score), *tie).withColumn("_r", F.spark_partition_id()).checkpoint()
    totals = dealt.groupBy("_r", site).agg(F.product(F.lit(1.0) - F.col(p)).alias("_t"))
    later = F.product("_t").over(Window.partitionBy(site).orderBy("_r").rowsBetween(*after))
    totals = totals.select("_r", site, F.coalesce(later, F.lit(1.0)).alias("_later"))
    own = F.product(F.lit(1.0) - F.col(p)).over(Window.partitionBy("_r", site).orderBy(F.desc(score), *tie).rowsBetween(*after))
    return dealt.withColumn("_own", F.coalesce(own, F.lit(1.0))).join(totals, ["_r", site]).withColumn(out, F.lit(1.0) - F.col("_own") * F.col("_later")).select(*df.columns, out)


def best_build(builds: DataFrame, event: Sequence[str], score: str, path: str) -> DataFrame:
    """The best build of each event."""
    return builds.groupBy(*event).agg(F.max_by(path, F.struct(F.col(score), F.col(path))).alias(path), F.max(score).alias(score))


def select_merge(builds: DataFrame, dataset: str, event: str, event_score: str, build_score: str, path: str, method: str = "best_build") -> DataFrame:
    """One build for each dataset: ``raw`` highest score; ``best_build`` event of the best build, then its best;
    ``event_score`` best-scored event, then its lowest build score."""
    if method == "raw":
        order = [F.desc(build_score), event, path]
    elif method == "best_build":
        top = Window.partitionBy(dataset, event)
        builds = builds.withColumn("_top", F.max(build_score).over(top))
        order = [F.desc("_top"), F.col(event), F.desc(build_score), F.col(path)]
    else:
        order = [F.desc(event_score), F.col(event), F.asc(build_score), F.col(path)]
    w = Window.partitionBy(dataset).orderBy(*order)
    return builds.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", *(["_top"] if method == "best_build" else []))


def last_wins(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union by name in which a key's row of ``new`` replaces that of ``old``."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)
