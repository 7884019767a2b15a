"""Mixing sources to target weights by Pareto order sampling (op2).

Targets. Sources share ``budget`` times all words by weight; a target stops at ``most`` times its
source's size, and the excess is shared anew by weight until no target is above. So a target is
min(most * size, x * weight) for one x: sources in ascending order of most * size / weight are full up to
the place where x is found, from running totals over the table of sources. That table, a row a source, is never gathered: only two sums are.

Documents. Within a source, document i is to be taken e_i = min(most, L * w_i) times on average,
where w_i grows with the binary logarithm of its size (64 levels at most) and L is set so that the
expected words meet the target. Whole copies floor(e_i) are certain. What is left of the target is a
sample with inclusion probabilities p_i = frac(e_i), by Pareto order sampling: documents are
ranked by [u / (1 - u)] / [p / (1 - p)], u uniform from a hash of source, doc_id and text, and taken
from the least on while their words fit in what is left. The size that is fixed is the number of words,
not of documents, and one more closes the last gap: of the rest, the one whose size comes nearest to it. So
inclusion is p_i but for that rounding; a test over 400 sources holds its rates against p_i.

The ranking is cut without sorting a source in one task: ranges of (source, rank) are summed and
accumulated. Reruns agree, as all draws are hashes.

Defined cases: a null text has size 0 and is taken 0 times; null sources come last as one source;
repeated rows draw the same number and are taken one after the other; an empty table gives an empty one. Texts of
any length are taken whole. Extra columns take no part, whatever their names; ``mixed`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlyr.llm.common import few, keyed_join, running, uniform, words, written

BUDGET, MOST, WEIGHTS = 1.5, 2.0, (3.0, 1.0, 2.0)


def level_factor(target: float, levels: list[tuple[float, float]], most: float) -> float:
    """L with sum(size * min(most, L * w)) = target over (w, size); at least what reaches it."""
    levels = sorted((x for x in levels if x[1] > 0), reverse=True)  # the largest weights are full first
    full, left = 0.0, sum(w * s for w, s in levels)
    for w, s in levels:
        if left <= 0 or (target - full) / left * w <= most:
            break
        full += most * s
        left -= w * s
    return max(target - full, 0.0) / left if left > 1e-9 else most / min((w for w, _ in levels), default=1.0)


def _weight(size):
    return F.lit(1.0) + F.floor(F.log2(size + F.lit(1))).cast("double") / 16


def targets(sized: DataFrame, budget: float = BUDGET, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """_s (a key that is never null), source_size, rows, target and factor, one row for each source, written."""
    levels = sized.groupBy("_s", "_w").agg(F.sum("size").cast("double").alias("size"), F.count("*").alias("rows"))
    per = levels.groupBy("_s").agg(F.collect_list(F.struct("_w", "size")).alias("levels"), F.sum("size").alias("s"), F.sum("rows").alias("rows"), F.lit(1).alias("one"))
    placed = running(per, [], ["_s"], {"place": "one"}, "sources")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int"))
    full = placed.select("_s", "levels", "s", "rows", weight.alias("weight"), (F.col("s") * most).alias("full"), (F.col("s") * most / weight).alias("ratio"))
    sums = running(written(full, "sources"), [], ["ratio", "_s"], {"before": "full", "gone": "weight"}, "ratios")
    sums = written(sums, "ratios")
    whole = sums.agg(F.sum("s").alias("s"), F.sum("weight").alias("w")).first()
    words_, weight_ = budget * (whole.s or 0.0), whole.w or 0.0
    # a source is full if the share by weight of what those before it leave would be more
    is_full = F.col("ratio") * (F.lit(weight_) - F.col("gone")) <= F.lit(words_) - F.col("before")
    rest = sums.where(~is_full).agg(F.sum("weight").alias("w")).first().w
    taken = sums.where(is_full).agg(F.sum("full").alias("f")).first().f or 0.0
    target = F.when(is_full, F.col("full")).otherwise(F.col("weight") * F.lit((words_ - taken) / rest if rest else 0.0))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            factor = [level_factor(t, [(x["_w"], x["size"]) for x in ls], most) for t, ls in zip(b["target"], b["levels"], strict=True)]
            yield b[["_s", "source_size", "rows", "target"]].assign(factor=factor)

    ready = sums.select("_s", F.col("s").cast("long").alias("source_size"), "rows", target.alias("target"), "levels")
    return written(ready.mapInPandas(solve, "_s string, source_size long, rows long, target double, factor double"), "targets")


def _sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, source, _s (sources by code point, null last), size, text hash _x, weight _w and ``keep``."""
    size = F.size(words(F.col("text"))).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t"))
    a = docs.select("doc_id", "source", *keep, key.alias("_s"), size.alias("size"), F.xxhash64("text").alias("_x"))
    return a.withColumn("_w", _weight(F.col("size")))


def mix(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row, with its text's hash _x and ``keep``.

    Rows that draw the same number are ordered by ``keep``, names of the caller's own choice.
    """
    sized = written(_sized(docs, list(keep)), "sized")
    goals = targets(sized)
    total = goals.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    at = lambda df, per: keyed_join(df, per, ["_s"], "rows", total)
    joined = at(sized, goals)
    times = F.least(F.lit(MOST), F.col("factor") * F.col("_w"))
    a = joined.withColumn("_whole", F.floor(times + 1e-9)).withColumn("_p", F.greatest(times - F.col("_whole"), F.lit(0.0)))
    u = uniform("source", "doc_id", "_x")
    rank = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
    a = a.withColumn("_rank", F.when(F.col("_p") > 1e-9, rank)).withColumn("_offer", F.when(F.col("_rank").isNotNull(), F.col("size")).otherwise(0)).withColumn("_sure", F.col("_whole") * F.col("size"))
    a = a.withColumn("_rank", F.coalesce("_rank", F.lit(float("inf")))).drop("factor", "rows", "_w")
    b = written(running(a, ["_s"], ["_rank", "doc_id", "_x", *keep], {"_before": "_offer"}, "ranked"), "ranks")
    # for each source: what its sure copies leave of its target, what the documents that fit leave of that, and the
    # document that closes this gap best, if one does
    per = written(b.groupBy("_s").agg(F.count("*").alias("rows"), (F.first("target") - F.sum("_sure")).alias("_left")), "left")
    fits = (F.col("_offer") > 0) & (F.col("_before") + F.col("_offer") <= F.col("_left"))
    gap = F.first("_left") - F.sum(F.when(fits, F.col("_offer")).otherwise(0))
    per = written(at(b, per).groupBy("_s").agg(F.first("rows").alias("rows"), F.first("_left").alias("_left"), gap.alias("_gap")), "gaps")
    miss = F.abs(F.col("_gap") - F.col("_offer"))
    closest = F.min(F.when(~fits & (F.col("_offer") > 0) & (miss < F.abs("_gap")), F.struct(miss.alias("d"), "_before")))
    per = written(at(b, per).groupBy("_s").agg(F.first("rows").alias("rows"), F.first("_left").alias("_left"), closest["_before"].alias("_last")), "last")
    b = at(b, per)
    fits = fits | ((F.col("_offer") > 0) & F.coalesce(F.col("_before") == F.col("_last"), F.lit(False)))
    copies = (F.col("_whole") + F.when(fits, 1).otherwise(0)).cast("long")
    return b.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_x", *keep)


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with the same columns, each as often as the mix takes it.

    Rows are numbered and written once to the shared folder, so that each has its own copies, also
    among rows that are equal in all columns. Rows that draw the same number go by the hash of all columns.
    """
    columns = docs.columns
    rows = written(docs.select(F.struct(*columns).alias("all"), F.xxhash64(*[f.name for f in docs.schema if not isinstance(f.dataType, T.MapType)]).alias("hash"), F.monotonically_increasing_id().alias("row")), "rows")
    plan = mix(rows.select("all.doc_id", "all.source", "all.text", "hash", "row"), "hash", "row").where("copies > 0")
    plan = written(plan.select("row", F.col("copies").cast("int").alias("copies")), "plan")
    return rows.join(few(plan), "row").select("all", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("all.*")
