"""From z values to events: thresholds, clusters, size and score filters, local strength, selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyr.operators import filters, ranking, robust, spatial


def thresholded(z: DataFrame, group: Sequence[str], quantile: float = 0.98, least: float = 2.0) -> DataFrame:
    """Rows with z above their group's cutoff, max(quantile, least)."""
    cut = z.groupBy(*group).agg(robust.cutoff("z", quantile, least).alias("cutoff"))
    return z.join(cut, list(group)).where(F.col("z") > F.col("cutoff"))


def cluster_events(cells: DataFrame, group: Sequence[str], item: str, eps: float, min_samples: int = 15, volume: float = 1.0) -> DataFrame:
    """(group, event, n_points, size, x, y, z): density clusters of cells, numbered from 0 in each group."""
    found = spatial.dbscan(cells, item, eps, min_samples, group=group)
    agg = cells.join(found, [*group, item]).groupBy(*group, "cluster").agg(F.count("*").alias("n_points"), *[F.avg(c).alias(c) for c in spatial.XYZ])
    return ranking.renumber(agg.withColumn("size", F.col("n_points") * F.lit(volume)), group, ["cluster"], "event", 0).drop("cluster")


def local_strength(events: DataFrame, item: str, size: str, radius: float = 6.0, group: Sequence[str] = ()) -> DataFrame:
    """``events`` with local_strength: the sizes of all events nearer than ``radius``, its own included."""
    a = events.select(*group, F.col(item).alias("_a"), *[F.col(c).alias(f"_a{c}") for c in spatial.XYZ])
    b = events.select(*group, F.col(size).alias("_s"), *[F.col(c).alias(f"_b{c}") for c in spatial.XYZ])
    near = spatial.range_join(a, b, radius, ("_ax", "_ay", "_az"), ("_bx", "_by", "_bz"), group)
    total = near.groupBy(*group, "_a").agg(F.sum("_s").alias("local_strength")).withColumnRenamed("_a", item)
    return events.join(total, [*group, item])


def filter_size(events: DataFrame, volume: float = 1.0, least: float = 5.0, points: str = "n_points") -> DataFrame:
    return events.where(F.col(points) * volume > least)


def filter_score(events: DataFrame, group: Sequence[str], least: float, order: str, score: str = "score") -> DataFrame:
    """Events above a score, renumbered from 0."""
    return ranking.renumber(events.where(F.col(score) > least), group, [order], "event", 0)


def symmetry_clear(events: DataFrame, operators: DataFrame, item: str, radius: float = 2.0) -> DataFrame:
    """Events no image of which (other than itself, unmoved) is within ``radius``; positions are fractional times a cell.

    Images come from ``spatial.images`` on columns x, y, z; those at exactly the event's place are its identity.
    """
    pictures = spatial.images(events.select(item, *spatial.XYZ), operators)
    d = spatial.distance(spatial.XYZ, [f"image_{c}" for c in spatial.XYZ])
    clash = pictures.withColumn("_d", d).where("_d > 1e-6").groupBy(item).agg(F.min("_d").alias("_d")).where(F.col("_d") <= radius)
    return events.join(clash.select(item), item, "left_anti")


def merge_events(events: DataFrame, group: Sequence[str], item: str, t: float) -> DataFrame:
    """Events merged by complete linkage at ``t``: sizes and strengths summed, positions averaged."""
    found = spatial.linkage_clusters(events, group, item, t, linkage="complete")
    return events.join(found, [*group, item]).groupBy(*group, "cluster").agg(F.sum("size").alias("size"), F.sum("local_strength").alias("local_strength"), *[F.avg(c).alias(c) for c in spatial.XYZ], F.sort_array(F.collect_list(item)).alias("members"))


#: A scorer takes events and returns them with ``score``. The stand-in is NOT a trained model.
Scorer = Callable[[DataFrame], DataFrame]
#: An outlier model takes values and returns those that stand out; a cluster model takes these and returns events;
#: a characterisation takes vectors and returns sets of comparable ones.
OutlierModel = ClusterModel = Characterization = Callable[[DataFrame], DataFrame]


def peak_scorer(peak: str = "peak") -> Scorer:
    """Deterministic stand-in: the peak z on a scale of 0 to 1, z / (1 + z)."""
    return lambda events: events.withColumn("score", F.greatest(F.col(peak), F.lit(0.0)) / (1 + F.greatest(F.col(peak), F.lit(0.0))))


def process_models(z: DataFrame, group: Sequence[str], place: str, eps: float, min_samples: int = 15, volume: float = 1.0, least_size: float = 5.0, least_score: float = 0.15, radius: float = 6.0, scorer: Scorer | None = None) -> DataFrame:
    """One statistical model's events, for all groups (dataset and model) at once: cells above their cutoff, clustered, filtered by size, scored, filtered by score, numbered from 1.

    ``z``: group, ``place`` (unique over all groups), the position x, y, zz and the value z. A group without events has no rows.
    """
    over = thresholded(z, group)
    placed = over.select(*group, place, "x", "y", F.col("zz").alias("z"), F.col("z").alias("_value"))
    found = spatial.dbscan(placed, place, eps, min_samples, group=group)
    cells = placed.join(found, [*group, place])
    agg = cells.groupBy(*group, "cluster").agg(F.count("*").alias("n_points"), F.max("_value").alias("peak"), *[F.avg(c).alias(c) for c in spatial.XYZ])
    sized = agg.withColumn("size", F.col("n_points") * F.lit(volume))
    strong = local_strength(sized, "cluster", "size", radius, group)
    kept = filter_size(strong, volume, least_size)
    scored = (scorer or peak_scorer())(kept).where(F.col("score") > least_score)
    return ranking.renumber(scored, group, ["cluster"], "event", 1)


def evaluate(values: DataFrame, outliers: OutlierModel, clusters: ClusterModel, before: Sequence[filters.Filter] = (), scorer: Scorer | None = None, after: Sequence[filters.Filter] = ()) -> DataFrame:
    """The stages of a model by exchangeable parts: outliers, clusters, filters, score, filters. One lazy plan."""
    found = filters.chain(clusters(outliers(values)), before)
    return filters.chain((scorer or peak_scorer())(found), after)


def build_tasks(events: DataFrame, ligands: DataFrame, conformers: DataFrame, dataset: str = "dtag", ligand: str = "ligand") -> DataFrame:
    """Every event with every ligand of its dataset and every conformer of that ligand there: joins by dataset, and by dataset and ligand."""
    return events.join(ligands, dataset).join(conformers, [dataset, ligand])


def best_ligand_score(scores: DataFrame, event: Sequence[str], score: str = "score") -> DataFrame:
    """The highest score over ligands, 0 at least."""
    return scores.groupBy(*event).agg(F.greatest(F.max(score), F.lit(0.0)).alias(score))


def select_model(events: DataFrame, dataset: str, model: str, score: str = "score") -> DataFrame:
    """All events of the model that has a dataset's single highest score."""
    best = events.groupBy(dataset).agg(F.max_by(model, F.struct(F.col(score), -F.col("event"))).alias(model))
    return events.join(best, [dataset, model], "left_semi")


def select_events(events: DataFrame, dataset: str, score: str = "score", k: int = 3) -> DataFrame:
    """The k best events of a dataset, renumbered from 1."""
    return ranking.top_k(events, [dataset], score, ["event"], k, "event_idx")
