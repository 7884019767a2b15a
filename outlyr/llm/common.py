"""Shared tables, shared-folder materialisation and distributed running totals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of characters other than space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: The same separators as one-character strings, for translate().
SPACES = "\t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir.

    Where it is unset, local sessions (tests) get a temporary folder; a cluster without the setting
    is an error, as a machine-local folder would lose files there.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", "") or (sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else "")
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="outlyr-")
        sc.setCheckpointDir(at)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: The folders that ``written`` has made inside each ``scratch`` that is open.
_open: list[dict[str, bool]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, the tables that ``written`` has made inside, but for those given to the function it yields.

    What is kept is what a result reads that leaves the block; an outer ``scratch`` takes it over.
    """
    own: dict[str, bool] = {}
    _open.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own[next(reversed(own))] = True  # the one written last
        return df

    try:
        yield keep
    finally:
        _open.remove(own)
        for path, kept in own.items():
            if not kept:
                drop_path(spark, path)
            elif _open:
                _open[-1][path] = False


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and nothing is computed twice."""
    path = f"{shared_dir(df.sparkSession)}/outlyr/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1][path] = False
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, by Hadoop's own file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def parts(spark: SparkSession) -> int:
    """Partitions for what this library deals out itself: the session's own number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blank_spaces(text: Column) -> Column:
    """All separators of WORD as spaces, so that a split at one character finds the words."""
    return F.translate(text, SPACES, " " * len(SPACES))


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(blank_spaces(text), F.lit("")), " "), lambda w: w != F.lit(""))


#: A key is hot if it has more than one in HOT of all rows; so there are HOT hot keys at most.
HOT = 10_000
#: Up to so many narrow rows (a few numbers each) are broadcast.
FEW = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it is counted to have FEW rows at most; otherwise it is shuffled."""
    return F.broadcast(df) if df.count() <= FEW else df


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined on ``on`` to ``right``, which is narrow, written, and has one row for each key.

    ``rows`` is right's column with the key's number of rows in ``left``, and ``total`` the number of all
    of them. Rows of hot keys stay where they are: both sides are split by the hashes of the hot
    keys, HOT numbers at most, which come to the driver, and right's part of them is broadcast. All other keys are joined
    by shuffle, and none of them fills a task. A key that shares a hot one's hash goes with it on both sides.
    """
    key = F.xxhash64(*on)
    hashes = [r.h for r in right.where(F.col(rows) * HOT > total).select(key.alias("h")).collect()]
    if not hashes:
        return left.join(right, on, how)
    names = ", ".join(f"`{c}`" for c in on)
    hot = F.expr(f"xxhash64({names}) IN ({', '.join(f'{h}L' for h in sorted(hashes) if h != -(2**63))})") if any(h != -(2**63) for h in hashes) else F.lit(False)
    return left.where(hot).join(F.broadcast(right.where(hot)), on, how).unionByName(left.where(~hot).join(right.where(~hot), on, how))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the given values alone."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """Add, for each ``out: column`` of ``sums``, the total of ``column`` over the earlier rows of the group.

    Earlier is by ``order`` (ascending, nulls last). Any group may hold a third of all rows: rows are
    dealt by ranges of (group, order), each range is summed, the ranges' totals (as many as
    partitions, and one more for each group) are accumulated, and rows add what their own range
    has before them. ``df`` should be narrow; it is written once to the shared folder.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    n = parts(spark)
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, name)
    totals = dealt.groupBy("_range", *group).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *group, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums])
    own = Window.partitionBy("_range", *group).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.select("*", *[F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))).over(own), F.lit(0)).alias(f"_o_{o}") for o, c in sums.items()])
    right = totals.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[f"_b_{o}" for o in sums])
    on = reduce(lambda a, b: a & b, [F.col("_range") == F.col("_r"), *[F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]])
    joined = inner.join(right, on)
    return joined.select(*df.columns, *[(F.col(f"_o_{o}") + F.col(f"_b_{o}")).alias(o) for o in sums])
