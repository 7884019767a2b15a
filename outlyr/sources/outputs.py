"""Outputs: event and site tables, review carry-over, checkpoints, manifests and map stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_table(events: DataFrame, datasets: DataFrame, sites: DataFrame) -> DataFrame:
    """The event table in ranked order, rounded half-even: 2 places, positions 3.

    ``events``: dtag, event_idx, rank, bdc, n_points, x, y, z, score, build_score, hit_in_site_probability;
    ``datasets``: dtag, resolution, rfree, rwork; ``sites``: dtag, event_idx, site_idx.
    """
    j = events.join(sites, ["dtag", "event_idx"]).join(datasets, "dtag")
    zero = [F.lit(0.0).alias(f"{a}_correlation_to_{b}_map") for a in ("global", "local") for b in ("average", "mean")]
    flags = [F.lit(False).alias(c) for c in ("analysed", "interesting", "exclude_from_z_map_analysis", "exclude_from_characterisation")]
    return j.select(
        "rank", "dtag", "event_idx", "bdc", F.col("n_points").alias("cluster_size"), *zero, "site_idx", *[F.bround(c, 3).alias(c) for c in "xyz"], F.bround("score", 2).alias("z_mean"),
        F.bround("build_score", 2).alias("z_peak"), "hit_in_site_probability", F.lit(0.0).alias("applied_b_factor_scaling"), F.bround("resolution", 2).alias("high_resolution"), F.lit(0.0).alias("low_resolution"),
        F.bround("rfree", 2).alias("r_free"), F.bround("rwork", 2).alias("r_work"), F.bround("resolution", 2).alias("analysed_resolution"), F.lit(float("nan")).alias("map_uncertainty"), *flags, F.bround(1 - F.col("bdc"), 2).alias("1-BDC"),
    )


def inspect_table(table: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """The event table with review columns, carried over from an earlier review where there is one."""
    empty = {"Interesting": F.lit(False), "Ligand Placed": F.lit(False), "Ligand Confidence": F.lit("Low"), "Comment": F.lit(""), "Viewed": F.lit(False)}
    if reviewed is None:
        return table.select("*", *[v.alias(k) for k, v in empty.items()])
    old = reviewed.select("dtag", "event_idx", *[F.col(k).alias(f"_old_{k}") for k in empty])
    joined = table.join(old, ["dtag", "event_idx"], "left")
    return joined.select(*table.columns, *[F.coalesce(F.col(f"`_old_{k}`"), v).alias(k) for k, v in empty.items()])


def inspect_sites(sites: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """The site table with name and comment, kept from an earlier one."""
    if earlier is None:
        return sites.select("*", F.lit(None).cast("string").alias("Name"), F.lit(None).cast("string").alias("Comment"))
    return sites.join(earlier.select("site_idx", "Name", "Comment"), "site_idx", "left")


def write_csv(table: DataFrame, path: str, order: str) -> None:
    """One ordered CSV file: an edge sink for reports of bounded size."""
    table.orderBy(order).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_checkpoint(events: DataFrame, path: str) -> None:
    """Events by dataset; a dataset that is written again replaces its own partition only."""
    events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dtag").parquet(path)


def write_maps(long: DataFrame, path: str) -> None:
    """Maps as (dtag, model, kind, cell, value), by dataset and kind."""
    long.select("dtag", "model", "kind", "cell", "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dtag", "kind").parquet(path)


def builds(events: DataFrame) -> DataFrame:
    """(dtag, event_idx, path, ligand_key, score, x, y, z, bdc): autobuilds as a table, a row each."""
    return events.select("dtag", "event_idx", "path", "ligand_key", "score", "x", "y", "z", "bdc")


def write_builds(events: DataFrame, path: str) -> None:
    """Autobuilds by dataset; a dataset that is written again replaces its own partition only."""
    builds(events).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dtag").parquet(path)


def structure_lines(atoms: DataFrame) -> DataFrame:
    """(dtag, line) of atoms (atom_no, atom_id, residue_name, chain, seq_id, icode, x, y, z) in the fixed columns of the PDB format."""
    name = F.when(F.length("atom_id") < 4, F.concat(F.lit(" "), F.rpad("atom_id", 3, " "))).otherwise(F.col("atom_id"))
    line = F.format_string("ATOM  %5d %4s %3s %1s%4s%1s   %8.3f%8.3f%8.3f", "atom_no", name, "residue_name", "chain", "seq_id", F.coalesce(F.when(F.col("icode") != "", F.col("icode")), F.lit(" ")), "x", "y", "z")
    return atoms.select("dtag", "atom_no", line.alias("line"))


def write_structures(atoms: DataFrame, path: str) -> None:
    """A folder for each dataset with its atoms as text, in order."""
    structure_lines(atoms).repartition("dtag").sortWithinPartitions("dtag", "atom_no").select("dtag", F.col("line").alias("value")).write.mode("overwrite").partitionBy("dtag").text(path)


def layout(root: str, dtag: str) -> dict[str, str]:
    """Where a dataset's outputs are."""
    return {k: f"{root}/{k}/dtag={dtag}" for k in ("events", "maps", "builds", "structures", "reports")}


def manifest(datasets: DataFrame) -> DataFrame:
    """(dtag, manifest): a dataset's inputs as JSON."""
    return datasets.select("dtag", F.to_json(F.struct(*[c for c in datasets.columns if c != "dtag"])).alias("manifest"))


def report(models: DataFrame, events: DataFrame) -> DataFrame:
    """(dtag, report): a dataset's models and their events, nested, as JSON."""
    e = events.groupBy("dtag", "model").agg(F.array_sort(F.collect_list(F.struct("event_idx", "score", "size"))).alias("events"))
    m = models.join(e, ["dtag", "model"], "left").groupBy("dtag").agg(F.array_sort(F.collect_list(F.struct("model", "n_initial", "n_size", "n_score", "events"))).alias("models"))
    return m.select("dtag", F.to_json(F.struct("models")).alias("report"))


def fraction_sweep(cells: DataFrame, value: str, mean: str, keep: list[str], low: float = 0.05, step: float = 0.05, count: int = 11) -> DataFrame:
    """Corrected maps at fixed fractions, one row for each cell and fraction."""
    b = F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(F.lit(low) + i * F.lit(step), 2))).alias("b")
    a = cells.select(*keep, value, mean, b)
    return a.select(*keep, "b", ((F.col(value) - F.col("b") * F.col(mean)) / (1 - F.col("b"))).alias("corrected"))
