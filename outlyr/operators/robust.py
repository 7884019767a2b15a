"""Point-wise statistics: median, MAD, mean, deviation, z, quantile thresholds, contrast, contours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cells(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """Long form (keep..., cell, value) of an array column, as doubles."""
    return df.select(*keep, F.posexplode(vector).alias("cell", "value")).withColumn("value", F.col("value").cast("double"))


def robust_model(long: DataFrame, group: Sequence[str], floor: float = 0.1) -> DataFrame:
    """(group, median, spread): spread is MAD / 0.6745, not below ``floor``."""
    med = long.groupBy(*group).agg(F.percentile("value", F.lit(0.5)).alias("median"))
    off = long.join(med, list(group)).withColumn("_d", F.abs(F.col("value") - F.col("median")))
    return off.groupBy(*group, "median").agg(F.greatest(F.percentile("_d", F.lit(0.5)) / F.lit(0.6745), F.lit(floor)).alias("spread"))


def _middle(a: Column) -> Column:
    """The interpolated median of a sorted array; null of an empty one."""
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / F.lit(2.0)


def robust_z(long: DataFrame, group: Sequence[str], floor: float = 0.1) -> DataFrame:
    """``long`` with median, spread and z = (value - median) / spread.

    A group's rows (one cell's values in a set of members) are brought together once; both medians come from its
    sorted values, so the input is read and shuffled once.
    """
    others = [c for c in long.columns if c not in group]
    g = long.groupBy(*group).agg(F.collect_list(F.struct(*others)).alias("_g"))
    g = g.withColumn("_v", F.array_sort(F.filter(F.transform("_g", lambda e: e["value"]), lambda v: v.isNotNull()))).withColumn("median", _middle(F.col("_v")))
    g = g.withColumn("_d", F.array_sort(F.transform("_v", lambda v: F.abs(v - F.col("median"))))).withColumn("spread", F.greatest(_middle(F.col("_d")) / F.lit(0.6745), F.lit(floor)))
    rows = g.select(*group, "median", "spread", F.explode("_g").alias("_e")).select(*group, "_e.*", "median", "spread")
    return rows.select(*long.columns, "median", "spread", ((F.col("value") - F.col("median")) / F.col("spread")).alias("z"))


def mean_z(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """``long`` with mean, population deviation and z; z is null where the deviation is zero."""
    m = long.groupBy(*group).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return long.join(m, list(group)).withColumn("z", F.try_divide(F.col("value") - F.col("mean"), F.col("std")))


def standardised(df: DataFrame, group: Sequence[str], column: str, out: str) -> DataFrame:
    """``column`` less its group's mean over its group's population deviation."""
    m = df.groupBy(*group).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return df.join(m, list(group)).withColumn(out, F.try_divide(F.col(column) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def outlying(z: str = "z", limit: float = 2.0) -> Column:
    """The fraction of rows with abs(z) above ``limit``."""
    return F.avg(F.when(F.abs(z) > limit, 1.0).otherwise(0.0))


def cutoff(z: str = "z", quantile: float = 0.98, least: float = 2.0) -> Column:
    """The larger of a quantile of z and ``least``."""
    return F.greatest(F.percentile(z, F.lit(quantile)), F.lit(least))


def masked_median(value: str, mask: Column) -> Column:
    """The median over the rows in ``mask``."""
    return F.percentile(F.when(mask, F.col(value)), F.lit(0.5))


def bin_of(x: str, low: str, high: str, edges: int = 20) -> Column:
    """The bin of x among ``edges`` equally spaced edges, 1-based; the upper edge is a bin of its own."""
    return (F.floor((F.col(x) - F.col(low)) / ((F.col(high) - F.col(low)) / F.lit(float(edges - 1)))) + 1).cast("int")


def bin_means(df: DataFrame, group: str, x: str, y: str, edges: int = 20) -> DataFrame:
    """Mean of y in the bins of x; the first populated bin and the last two are dropped."""
    span = df.groupBy(group).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    means = df.join(span, group).where("_hi > _lo").withColumn("bin", bin_of(x, "_lo", "_hi", edges)).groupBy(group, "bin").agg(F.avg(y).alias("mean"))
    up, down = Window.partitionBy(group).orderBy("bin"), Window.partitionBy(group).orderBy(F.desc("bin"))
    return means.withColumn("_a", F.row_number().over(up)).withColumn("_b", F.row_number().over(down)).where("_a > 1 and _b > 2").drop("_a", "_b")


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(measure, min, mean, max) of columns, in one pass."""
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))]
    row = df.select([F.col(c).cast("double").alias(c) for c in columns]).agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"min_{c}").alias("min"), F.col(f"avg_{c}").alias("mean"), F.col(f"max_{c}").alias("max")) for c in columns])
    return row.select(F.explode(each).alias("m")).select("m.*")


def corrected(x: str, mean: str, b: Column) -> Column:
    """What is left of x without a fraction b of the mean, back on scale: (x - b m) / (1 - b)."""
    return (F.col(x) - b * F.col(mean)) / (F.lit(1.0) - b)


def grid(low: float, step: float, count: int) -> Column:
    """An array column of ``count`` equally spaced numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lit(low) + i * F.lit(step))


def background_fraction(df: DataFrame, item: Sequence[str], x: str = "value", mean: str = "median", step: float = 0.05, count: int = 20) -> DataFrame:
    """(item, b): the fraction whose corrected median is nearest to the mean map's median; the least of equals.

    The grid is a wide list of aggregates over one grouping, so cells are shuffled once.
    """
    bs = [i * step for i in range(count)]
    aggs = [F.percentile(corrected(x, mean, F.lit(b)), F.lit(0.5)).alias(f"_b{i}") for i, b in enumerate(bs)]
    wide = df.groupBy(*item).agg(F.percentile(mean, F.lit(0.5)).alias("_m"), *aggs)
    each = F.array(*[F.struct(F.round(F.abs(F.col(f"_b{i}") - F.col("_m")), 9).alias("gap"), F.lit(b).alias("b")) for i, b in enumerate(bs)])
    return wide.select(*item, F.array_min(each)["b"].alias("b"))


def correlation_fraction(df: DataFrame, item: Sequence[str], x: str, mean: str, model: str, step: float = 0.05, count: int = 20) -> DataFrame:
    """(item, b, corr): the fraction whose corrected values correlate best with a model's."""
    bs = [i * step for i in range(count)]
    wide = df.groupBy(*item).agg(*[F.corr(corrected(x, mean, F.lit(b)), F.col(model)).alias(f"_b{i}") for i, b in enumerate(bs)])
    each = F.array(*[F.struct(F.round(F.col(f"_b{i}"), 9).alias("corr"), F.lit(-b).alias("nb")) for i, b in enumerate(bs)])
    return wide.select(*item, F.array_max(each).alias("_c")).select(*item, (-F.col("_c.nb")).alias("b"), F.col("_c.corr").alias("corr"))


def signal_noise(value: str, inside: Column, level: float = 0.5) -> list[Column]:
    """Clipped sums [0, 3] and counts above ``level`` inside and outside of a mask."""
    v = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(3.0))
    return [
        F.sum(F.when(inside, v).otherwise(0.0)).alias("signal"),
        F.sum(F.when(~inside, v).otherwise(0.0)).alias("noise"),
        F.count_if(inside & (F.col(value) >= level)).alias("n_signal"),
        F.count_if(~inside & (F.col(value) >= level)).alias("n_noise"),
    ]


def optimal_contour(df: DataFrame, item: str, value: str, inside: str, low: float, high: float, levels: int = 100) -> DataFrame:
    """(item, contour, gain): the level with most cells inside less those outside; the lowest of equals.

    A cell's value is placed among the levels once; counts accumulate over levels, not over cells.
    """
    step = (high - low) / (levels - 1)
    # the number of levels that the value reaches
    reach = F.least(F.greatest(F.floor((F.col(value) - low) / step) + 1, F.lit(0)), F.lit(levels)).cast("int")
    counts = df.select(item, reach.alias("_k"), F.when(F.col(inside), 1).otherwise(-1).alias("_d")).groupBy(item, "_k").agg(F.sum("_d").alias("_d"))
    packed = counts.groupBy(item).agg(F.collect_list(F.struct("_k", "_d")).alias("_c"))
    at = lambda i: F.aggregate(F.filter("_c", lambda e: e["_k"] > i), F.lit(0).cast("long"), lambda a, e: a + e["_d"])
    each = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.struct(at(i).alias("gain"), (-i).alias("neg")))
    best = packed.select(item, F.array_max(each).alias("_b"))
    return best.select(item, (F.lit(low) + (-F.col("_b.neg")) * F.lit(step)).alias("contour"), F.col("_b.gain").alias("gain"))


def apply_scale(df: DataFrame, scales: DataFrame, item: str, x: str, y: str, out: str) -> DataFrame:
    """``df`` with ``out``: y * exp(scale * x) by each item's own fitted scale."""
    return df.join(scales.select(item, F.col("scale").alias("_s")), item).withColumn(out, F.col(y) * F.exp(F.col("_s") * F.col(x))).drop("_s")


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution by a rational approximation of the error function, to 1.5e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * F.abs(x) / F.lit(2.0**0.5))
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    half = F.lit(0.5) * poly * F.exp(-x * x / F.lit(2.0))
    return F.when(x >= 0, F.lit(1.0) - half).otherwise(half)


def normality(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, n, statistic): the largest distance of the empirical distribution from the normal one with the sample's mean and deviation.

    Groups without spread have none.
    """
    w = Window.partitionBy(*group)
    a = df.withColumn("_m", F.avg(value).over(w)).withColumn("_s", F.stddev_samp(value).over(w)).withColumn("_n", F.count(value).over(w)).where("_s > 0")
    a = a.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_f", normal_cdf((F.col(value) - F.col("_m")) / F.col("_s")))
    gap = F.greatest(F.col("_r") / F.col("_n") - F.col("_f"), F.col("_f") - (F.col("_r") - 1) / F.col("_n"))
    return a.groupBy(*group).agg(F.max("_n").alias("n"), F.max(gap).alias("statistic"))


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, difference): one map less another on their common cells."""
    return a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys)).select(*keys, (F.col("_a") - F.col("_b")).alias("difference"))


def scale_fit(reference: DataFrame, moving: DataFrame, item: str, keys: Sequence[str], x: str, y: str, low: float = -15.0, step: float = 0.5, count: int = 61) -> DataFrame:
    """(item, scale): exp-scale of the moving bin means onto the reference's, least absolute difference on a grid.

    Both tables are cut to their common keys; bins span the reference's x.
    """
    r = reference.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_ry"))
    joined = moving.select(item, *keys, F.col(y).alias("_my")).join(r, list(keys))
    span = joined.groupBy(item).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    binned = joined.join(span, item).where("_hi > _lo").withColumn("bin", bin_of("_x", "_lo", "_hi"))
    scaled = [F.avg(F.col("_my") * F.exp(F.lit(low + i * step) * F.col("_x"))).alias(f"_s{i}") for i in range(count)]
    means = binned.groupBy(item, "bin").agg(F.avg("_ry").alias("_r"), *scaled)
    up, down = Window.partitionBy(item).orderBy("bin"), Window.partitionBy(item).orderBy(F.desc("bin"))
    means = means.withColumn("_a", F.row_number().over(up)).withColumn("_b", F.row_number().over(down)).where("_a > 1 and _b > 2")
    gaps = means.groupBy(item).agg(*[F.sum(F.abs(F.col("_r") - F.col(f"_s{i}"))).alias(f"_g{i}") for i in range(count)])
    each = F.array(*[F.struct(F.round(F.col(f"_g{i}"), 6).alias("gap"), F.lit(low + i * step).alias("scale")) for i in range(count)])
    return gaps.select(item, F.array_min(each)["scale"].alias("scale"))


def regression_spread(df: DataFrame, item: str, value: str) -> DataFrame:
    """(item, spread): slope of the sorted middle two thirds on normal quantiles, a spread that outliers do not move.

    Quantiles are Acklam's rational approximation at (rank - 0.5) / n, so the result is deterministic.
    """
    w = Window.partitionBy(item)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    p = (F.col("_r") - F.lit(0.5)) / F.col("_n")
    mid = ranked.where((p > 1 / 6) & (p < 5 / 6)).withColumn("_q", central_normal_quantile(p))
    return mid.groupBy(item).agg(F.regr_slope(value, "_q").alias("spread"))


#: Coefficients of the approximation, from the highest power down.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)


def central_normal_quantile(p: Column) -> Column:
    """Inverse normal distribution for 0.02425 <= p <= 0.97575, to 1e-9."""
    q = p - F.lit(0.5)
    r = q * q
    poly = lambda c: __import__("functools").reduce(lambda s, x: s * r + F.lit(x), c[1:], F.lit(c[0]))
    return poly(QUANTILE_A) * q / poly(QUANTILE_B)


def build_metrics(cells: DataFrame, item: Sequence[str], value: str, mean: str, predicted: str, mask: str, fraction: Column, contour: float, high: float = 3.0) -> DataFrame:
    """(item, signal, noise, num_points) of builds: sums of the corrected map, clipped to 0 .. high.

    Signal is taken where the predicted density is above ``contour``, noise inside the build's mask.
    """
    strong = F.col(predicted) > F.lit(contour)
    clipped = F.least(F.greatest(corrected(value, mean, fraction), F.lit(0.0)), F.lit(high))
    total = lambda inside: F.coalesce(F.sum(F.when(inside, clipped)), F.lit(0.0))
    return cells.groupBy(*item).agg(total(strong).alias("signal"), total(F.col(mask)).alias("noise"), F.count_if(strong).alias("num_points"))
