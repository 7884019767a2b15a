"""Filter interaction audit (op13): what every filter removes, in every order of the filters, from one SQL CUBE.

Each document has a flag for each filter that it fails. Documents are counted by part and flags, and a CUBE over part
and flags sums these counts for all subsets of them. Its rows that keep the part and whose selected flags are all false count the
documents that survive just the selected filters, so one pass gives the survivors of all 2^5 subsets of filters. What
a filter removes after the set S of others is the difference between the survivors of S and of S with the filter: each step of each order is
such a pair of subsets, joined from the table of survivors.

The work on texts is one pass; copies (filter E) are found by a digest of the text: a group of equal texts, of any size, is
reduced to its least doc_id before it is shuffled, and its rows are given that id by a join that splits hot groups.

Defined cases: a null text is an empty one, and equal to it; a text without words has not too few distinct words, but too
few words; a null language is the part '', together with the language ''; a null doc_id is no smaller one and has none, and has no
labels; of several labels of a document one suffices; repeated rows are counted each and are no copies of
each other, as their doc_id is the same; an empty table has no parts and gives no rows. Texts of any length are taken
whole, in one row's memory. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyr.llm.common import keyed_join, scratch, words, written
from outlyr.llm.native import without

#: The filters in the order of their bits in a mask of filters.
FILTERS = ("A", "B", "C", "D", "E")
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = r"[#$%&*|]"
_COUNTS = ("n", "good", "toxic")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and the flags A to E of every document."""
    t = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), t.alias("t"), words(t).alias("w"))
    n = F.size("w")
    capitals = F.length("t") - without(F.col("t"), CAPITALS)
    own = own.select(
        "doc_id", "part", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), (n < MIN_WORDS).alias("A"), (100 * F.size(F.array_distinct("w")) < MIN_DISTINCT * n).alias("B"),
        (100 * capitals > MAX_CAPITALS * F.length("t")).alias("C"), F.col("t").rlike(SYMBOLS).alias("D"),
    )
    own = written(own, "failures")
    texts = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    copies = written(texts, "copies")
    joined = keyed_join(own, copies, ["digest"], "rows", own.count(), "left")
    return joined.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def counted(failed: DataFrame, labels: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """part, flags, and the numbers of documents with them: n, and good and toxic ones by their labels.

    ``failed`` has doc_id, part and a flag for each filter. Rows of one doc_id are counted before they meet its labels.
    """
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    rows = failed.groupBy("doc_id", "part", *filters).agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    return rows.groupBy("part", *filters).agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))])


def survivors(counts: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """part, mask and n, good, toxic of the documents that pass all filters of the mask, zeros included."""
    cube = counts.cube("part", *filters).agg(
        *[F.sum(c).alias(c) for c in _COUNTS], F.grouping("part").alias("all_parts"),
        sum(((1 - F.grouping(f)).cast("int") * (1 << k) for k, f in enumerate(filters)), F.lit(0)).alias("mask"),
    )
    passed = reduce(lambda a, b: a & b, [~F.coalesce(F.col(f), F.lit(False)) for f in filters])
    found = cube.where((F.col("all_parts") == 0) & passed).select("part", "mask", *_COUNTS)
    every = counts.select("part").distinct().withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))))
    return every.join(found, ["part", "mask"], "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS])


def steps(filters: tuple[str, ...] = FILTERS) -> list[tuple[str, int, str, int, int]]:
    """filter_order, step, its filter, and the masks of the filters before and up to it, for all orders."""
    out = []
    for order in permutations(filters):
        mask = 0
        for k, f in enumerate(order):
            after = mask | 1 << filters.index(f)
            out.append(("".join(order), k + 1, f, mask, after))
            mask = after
    return out


def interactions(counts: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """One row for each part, filter_order and step, from the table of ``counted``."""
    spark, full = counts.sparkSession, (1 << len(filters)) - 1
    listed = steps(filters)
    # a pair of subsets (before, after) stands for as many orders as the filters before and after it can be arranged in
    arranged = lambda b: factorial(b.bit_count()) * factorial(len(filters) - 1 - b.bit_count())
    pairs = spark.createDataFrame(sorted({(f, b, a, arranged(b)) for _, _, f, b, a in listed}), "filter string, before int, after int, orders long")
    with scratch(spark) as keep:
        alive = written(survivors(counts, filters), "survivors")
        at = lambda mask, name: alive.select("part", F.col("mask").alias(mask), *[F.col(c).alias(f"{name}_{c}") for c in _COUNTS])
        pair = at("before", "b").join(F.broadcast(pairs), "before").join(at("after", "a"), ["part", "after"])
        pair = keep(written(pair.select("part", "filter", "before", "after", "orders", F.col("a_n").alias("kept"), *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(c) for c in _COUNTS]), "pairs"))
    # the pair from no filter counts all failures, the one from all others those of this filter alone
    rest = sum((F.when(F.col("filter") == f, F.lit(full ^ (1 << k))).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    fails, unique = F.sum(F.when(F.col("before") == 0, F.col("n"))), F.sum(F.when(F.col("before") == rest, F.col("n")))
    whole = pair.groupBy("part", "filter").agg(fails.alias("fails"), unique.alias("unique_fails"), F.sum(F.col("n") * F.col("orders")).alias("shapley"))
    order = spark.createDataFrame(listed, "filter_order string, step int, filter string, before int, after int")
    rows = pair.join(whole, ["part", "filter"]).join(F.broadcast(order), ["filter", "before", "after"])
    return rows.select(
        "part", "filter_order", "step", "kept", F.col("n").alias("removed"), (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters over ``docs``. Tables that the result does not read are deleted."""
    with scratch(docs.sparkSession) as keep:
        return keep(interactions(written(counted(failures(docs), labels), "counts")))

