"""Document fingerprints by one-permutation MinHash (op9), in DataFrame operations alone.

The 64-bit hashes of a text's 5-word shingles (fewer words: the whole sequence) are dealt into BINS
bins by their top bits, and each bin keeps its least hash. An empty bin is filled by optimal
densification: bin j looks at the bins of its own random order, the same for all texts, and takes
the value of the first that is not empty. The low BITS bits of each value, hashed once more with its
bin so that one value in many bins agrees by chance in few of them, are stored as hexadecimal digits. Two unequal values agree in them with probability 2^-BITS, which likeness
corrects: (matches / BINS - c) / (1 - c), c = 2^-BITS, not below 0.

Defined cases: a text without words (null, empty or blank) has the fingerprint '' which is like ''
alone. Several rows of one doc_id each look at the next lower doc_id; of several rows there the one
with the least text serves. A null doc_id has no next document: its edited text lacks the last
third, and near_next is null. Repeated rows get equal results. An empty table gives an empty one. Texts of any length
are taken whole, in one row's memory. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outlyr.llm.common import parts, words, written
from outlyr.llm.native import let, runs

SHINGLE, BINS, BITS = 5, 256, 4
#: Looks that are tried one by one before the rest of a bin's order is searched at once.
LOOKS = 10
_HEX = "0123456789abcdef"


def _orders() -> list[list[int]]:
    """For each bin, start and odd step of its order of all bins, from a fixed linear generator."""
    x, out = 1, []
    for _ in range(BINS):
        pair = []
        for _ in range(2):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            pair.append((x >> 33) % BINS)
        out.append([pair[0], pair[1] | 1])
    return out


def shingles(ws: Column) -> Column:
    """Hashes of the 5-word shingles of a word array."""
    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) >= SHINGLE, runs(h, SHINGLE)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.expr("CAST(array() AS array<bigint>)")))


def _bin(x: Column) -> Column:
    return (F.shiftright(x, 56) + F.lit(128)).cast("int")


def fingerprint(text: Column) -> Column:
    """The packed signature of a text."""
    starts = F.array(*[F.lit(a) for a, _ in _orders()])
    steps = F.array(*[F.lit(b) for _, b in _orders()])
    backs = F.array(*[F.lit(pow(b, -1, BINS)) for _, b in _orders()])
    digit = lambda v, j: F.substring(F.lit(_HEX), F.xxhash64(v, j).bitwiseAND(F.lit(15).cast("long")).cast("int") + 1, F.lit(1))
    void = F.lit(None).cast("bigint")

    def least(s: Column) -> Column:
        """The first hash of each bin, from sorted hashes."""
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftrightunsigned(x.bitwiseXOR(F.get(s, i - 1)), 56) != 0))

    def spread(m: Column) -> Column:
        """One element for each bin, null where it is empty."""
        gap = lambda x, i: _bin(x) - F.coalesce(_bin(F.get(m, i - 1)), F.lit(-1)) - 1
        filled = F.flatten(F.transform(m, lambda x, i: F.concat(F.array_repeat(void, gap(x, i)), F.array(x))))
        return F.concat(filled, F.array_repeat(void, F.lit(BINS - 1) - _bin(F.element_at(m, -1))))

    def densify(d: Column, m: Column) -> Column:
        at = lambda j, t: F.get(d, F.pmod(F.get(starts, j) + F.get(steps, j) * t, F.lit(BINS)))
        # beyond the first looks: the least place in bin j's order among the bins that are not empty
        place = lambda j, x: F.pmod((_bin(x) - F.get(starts, j)) * F.get(backs, j), F.lit(BINS))
        rest = lambda j: at(j, F.array_min(F.transform(m, lambda x: place(j, x))))
        return F.array_join(F.transform(d, lambda v, j: digit(F.coalesce(v, *[at(j, F.lit(t)) for t in range(LOOKS)], rest(j)), j)), "")

    def packed(m: Column) -> Column:
        one = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: digit(F.get(m, F.lit(0)), j)), "")
        return F.when(F.size(m) == 0, F.lit("")).when(F.size(m) == 1, one).otherwise(let(spread(m), lambda d: densify(d, m)))

    return let(let(F.sort_array(shingles(words(text))), least), packed)


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of the shingle sets behind two fingerprints."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    c = 2.0**-BITS
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - c) / (1 - c)))


def _lower(ids: DataFrame) -> DataFrame:
    """``ids`` (distinct doc_id, k) with ``next``: the next lower doc_id, or the highest for the lowest.

    Ids are dealt by range, so no task sees them all; the borders of the ranges are a row each.
    """
    dealt = written(ids.repartitionByRange(parts(ids.sparkSession), "doc_id").withColumn("_range", F.spark_partition_id()), "ids")
    edges = dealt.groupBy("_range").agg(F.max("doc_id").alias("_top"))
    edges = edges.select(F.col("_range").alias("_r"), F.lag("_top").over(Window.orderBy("_range")).alias("_below"), F.max("_top").over(Window.partitionBy()).alias("_highest"))
    inner = dealt.withColumn("_own", F.lag("doc_id").over(Window.partitionBy("_range").orderBy("doc_id")))
    return inner.join(edges, F.col("_range") == F.col("_r")).select("doc_id", "k", F.coalesce("_own", "_below", "_highest").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprints of all texts and edited texts and their likeness, as the query returns them.

    Whole texts are shuffled once, by doc_id; a document sends the one before it only as many of
    its first code points as that one takes, with its own fingerprint.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    third = F.floor(F.length(t) / 3).cast("int")
    ids = docs.where("doc_id is not null").select("doc_id", third.alias("k")).groupBy("doc_id").agg(F.max("k").alias("k"))
    wanted = _lower(ids).select(F.col("next").alias("_giver"), F.col("doc_id").alias("_taker"), F.col("k").alias("_k"))
    every = docs.select("doc_id", t.alias("_text"), fingerprint(t).alias("fingerprint"))
    base = every.where("doc_id is not null")  # one exchange of it serves both joins
    gifts = base.join(wanted, F.col("doc_id") == F.col("_giver")).select("_taker", F.struct(F.substring("_text", F.lit(1), F.col("_k")).alias("head"), F.col("fingerprint").alias("print")).alias("_g"))
    gifts = gifts.groupBy("_taker").agg(F.min("_g").alias("_g"))
    alone = every.where("doc_id is null").select("*", F.lit(None).cast("struct<head: string, print: string>").alias("_g"))
    joined = base.join(gifts, F.col("doc_id") == F.col("_taker"), "left").select(*every.columns, "_g").unionByName(alone)
    n = F.length("_text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - k), F.coalesce(F.substring(F.col("_g.head"), F.lit(1), k), F.lit("")))
    made = joined.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", edited.alias("_edited"), F.col("_g.print").alias("_next"))
    made = made.select("doc_id", "n_chars", "fingerprint", "_next", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("_edited")).alias("edited_fingerprint"))
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
