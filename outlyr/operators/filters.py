"""Predicate chains: quality, range, allow and deny lists, ordered quotas, set containment, key sets.

Every filter is ``DataFrame -> DataFrame`` with column names as parameters. Thresholds are strict.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Filter = Callable[[DataFrame], DataFrame]


def below(column: str, limit: float, missing: float | None = None) -> Column:
    """``column < limit``; a missing value counts as ``missing`` (R-free: 0, which passes)."""
    c = F.col(column)
    return (c if missing is None else F.coalesce(c, F.lit(missing))) < F.lit(limit)


def last_integer(column: str) -> Column:
    """The last run of digits of a name as a number; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(F.col(column), F.lit("([0-9]+)"), F.lit(1)), F.lit(-1)).cast("bigint")


def in_range(column: str, spec: str) -> Column:
    """Last integer of a name in the half-open range ``"a-b"``."""
    low, high = map(int, spec.split("-"))
    n = last_integer(column)
    return (n >= low) & (n < high)


def not_listed(column: str, names: str | None) -> Column:
    """Not in a comma-separated list; None excludes nothing."""
    return F.lit(True) if names is None else ~F.col(column).isin([x.strip() for x in names.split(",")])


def listed(column: str, names: str | None) -> Column:
    """In a comma-separated list; None allows all."""
    return F.lit(True) if names is None else F.col(column).isin([x.strip() for x in names.split(",")])


def has_restraints(ligands: str = "ligands") -> Column:
    """At least one ligand of the map has a restraint file."""
    return F.exists(F.map_values(ligands), lambda v: v["cif"].isNotNull())


def chain(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Apply filters one after the other."""
    return reduce(lambda d, f: d.transform(f), filters, df)


def first_failure(rules: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first rule that fails; null where all pass. One pass over the rows."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in rules])


def quota(df: DataFrame, group: str, order: str, tie: str, ref: str, hard: int, soft: int, buffer: float) -> DataFrame:
    """Ordered selection: all below the reference, then up to ``hard``, then up to ``soft`` within ``buffer``.

    Rejection is final in ascending order, so what is accepted is a prefix and one row number says it.
    """
    r = F.row_number().over(Window.partitionBy(group).orderBy(order, tie))
    o, x = F.col(order), F.col(ref)
    return df.withColumn("_r", r).where((o < x) | (F.col("_r") <= hard) | ((F.col("_r") <= soft) & (o < x + F.lit(buffer)))).drop("_r")


def containing(pairs: DataFrame, reference: DataFrame, item: str, key: str) -> DataFrame:
    """Items whose keys contain all of ``reference``'s (relational division)."""
    wanted = reference.select(key).distinct()
    one = F.broadcast(wanted.agg(F.count("*").alias("_all")))  # one row
    have = pairs.select(item, key).distinct().join(wanted, key).groupBy(item).agg(F.count("*").alias("_n"))
    every = pairs.select(item).distinct().join(have, item, "left")  # an item contains an empty reference without any key of it
    return every.join(one, F.coalesce("_n", F.lit(0)) == F.col("_all")).select(item)


def common_keys(df: DataFrame, member: str, keys: Sequence[str]) -> DataFrame:
    """Keys that every member has."""
    members = df.agg(F.count_distinct(member).alias("_all"))
    n = df.groupBy(*keys).agg(F.count_distinct(member).alias("_n"))
    return n.join(F.broadcast(members), F.col("_n") == F.col("_all")).select(*keys)  # one row


def truncate_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in a key set."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def truncate_resolution(df: DataFrame, d: str, limit: float) -> DataFrame:
    """Rows at ``limit`` or above."""
    return df.where(F.col(d) >= limit)


def truncate_common(df: DataFrame, member: str, on: Sequence[str], d: str, limit: float) -> DataFrame:
    """Rows at ``limit`` or above whose key all members have there."""
    cut = truncate_resolution(df, d, limit)
    return truncate_keys(cut, common_keys(cut, member, on), on)


def masked_rows(df: DataFrame, mask: Column) -> DataFrame:
    """Rows where a mask is true; null is not."""
    return df.where(F.coalesce(mask, F.lit(False)))


def confident(df: DataFrame, column: str = "Ligand Confidence", level: str = "High") -> DataFrame:
    """Reviewed rows of one confidence."""
    return df.where(F.col(f"`{column}`") == level)


def with_events(models: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Models that have an event."""
    return models.join(events.select(*keys).distinct(), list(keys), "left_semi")


def unchanged(df: DataFrame) -> DataFrame:
    """The preprocessing step that does nothing."""
    return df


def prune_sets(df: DataFrame, group: str, score: str, tie: str, best: int = 3, limit: float = 0.2) -> DataFrame:
    """The ``best`` lowest scores of each group and all others below ``limit``."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(score, tie))
    return df.withColumn("_r", r).where((F.col("_r") <= best) | (F.col(score) < limit)).drop("_r")


def min_group(df: DataFrame, group: str, least: int = 25) -> DataFrame:
    """Rows of groups with at least ``least`` rows."""
    large = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(group)
    return df.join(large, group, "left_semi")


#: Targets of one space group and residue set that meet its ranked members in one task.
TARGETS = 1000


def comparators(datasets: DataFrame, residues: DataFrame | None, targets: DataFrame, hard: int = 60, soft: int = 100, buffer: float = 0.1, max_rfree: float = 0.4, least: int = 25) -> DataFrame:
    """(target, member): same space group, good R-free, residues that contain the target's, then the quota.

    ``datasets``: dtag, resolution, spacegroup, rfree. The target is a member of its own group; groups
    below ``least`` are dropped. Targets of one space group and residue set have the same members in the same order, so these are ranked
    once for all; a target takes a prefix of them. Pairs are made once, at the end, and not shuffled; there are as many as
    the result has rows, which with all members below the reference is the square of a space group's datasets.
    """
    d = datasets.where(below("rfree", max_rfree, 0.0)).select(F.col("dtag").alias("member"), F.col("resolution").alias("_res"), "spacegroup")
    t = targets.select(F.col("dtag").alias("target"), F.col("resolution").alias("_ref"), "spacegroup")
    own = t.select("target").distinct()
    if residues is None:
        t, members = t.withColumn("_a", F.lit("")), d.withColumn("_a", F.lit(""))
    else:
        # datasets of one study mostly have one residue set: containment is decided between distinct sets
        sets = residues.groupBy("dtag").agg(F.array_sort(F.collect_set("residue")).alias("_set"))
        kind = sets.select("dtag", F.sha2(F.to_json("_set"), 256).alias("_kind"), "_set")
        kinds = kind.groupBy("_kind").agg(F.first("_set").alias("_set"))
        want = kinds.select(F.col("_kind").alias("_a"), F.size("_set").alias("_n"), F.explode("_set").alias("residue"))
        have = kinds.select(F.col("_kind").alias("_b"), F.explode("_set").alias("residue"))
        inside = want.join(have, "residue").groupBy("_a", "_b", "_n").agg(F.count("*").alias("_c")).where("_c = _n").select("_a", "_b")
        t = t.join(kind.select(F.col("dtag").alias("target"), F.col("_kind").alias("_a")), "target")
        members = d.join(kind.select(F.col("dtag").alias("member"), F.col("_kind").alias("_b")), "member").join(inside, "_b")
    group = ["spacegroup", "_a"]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_res", "member"))
    # a member's first row decides, as what is taken is a prefix; _k numbers members, _r rows
    first = members.select(*group, "member", "_res", rank.alias("_r")).groupBy(*group, "member").agg(F.min(F.struct("_r", "_res")).alias("_f"))
    first = first.select(*group, "member", "_f._r", "_f._res").withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy("_r")))
    from outlyr.operators.spatial import ensure_checkpoints

    ensure_checkpoints(datasets.sparkSession)
    first, t = first.checkpoint(), t.checkpoint()
    taken = (F.col("_res") < F.col("_ref")) | (F.col("_r") <= hard) | ((F.col("_r") <= soft) & (F.col("_res") < F.col("_ref") + F.lit(buffer)))
    # a prefix of ``least`` members, the target among them or one less and the target, tells whether a group is large enough
    few = t.join(first.where(F.col("_k") <= least), group).where(taken & (F.col("target") != F.col("member"))).select("target", "member").distinct()
    large = own.join(few.groupBy("target").agg(F.count("*").alias("_c")), "target", "left").where(F.coalesce("_c", F.lit(0)) + 1 >= least).select("target").checkpoint()
    blocks = t.groupBy(*group).agg(F.ceil(F.count("*") / TARGETS).cast("int").alias("_of"))
    left = t.join(large, "target", "left_semi").join(blocks, group).withColumn("_block", F.pmod(F.xxhash64("target"), F.col("_of")).cast("int")).drop("_of")
    right = first.join(blocks, group).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).drop("_of")
    pairs = left.join(right, [*group, "_block"]).where(taken & (F.col("target") != F.col("member"))).select("target", "member")
    if not datasets.groupBy("dtag").count().where("count > 1").isEmpty() or not targets.groupBy("dtag").count().where("count > 1").isEmpty():
        pairs = pairs.distinct()  # names stand more than once
    return pairs.unionByName(large.select("target", F.col("target").alias("member")))
