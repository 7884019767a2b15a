"""Sharding by k-d tree partitioning (op6), law ``bytes``.

Points are groups of equal texts, with their bytes as weight. A group of more than a 64th of a
shard's bytes is dealt into pieces of about that size, by a hash of doc_id and, among equal rows, a number; its pieces are neighbours in every dimension,
so a cut divides one group at most, and a group that no cut falls into stays whole.
A node of the tree stands for a number of shards; it is split along its widest metadata dimension
at the weighted quantile that gives the two sides bytes in the ratio of their shards, until every leaf
is one shard with the target bytes. Dimensions are size (64ths of its binary logarithm), source and
language. A value's position is the share of all bytes that lies below it, in order of the observed values (nulls
last), so a node's width is the share of all bytes that its values span, in every dimension alike.

Quantiles are distributed: the bytes in 65,536 cells of each node's dimension are summed, then those
in the cells of the cell where the quantile lies, down to single points. Ties along a dimension are ordered by the text's
hash, then by piece. Only the cuts, shards - 1 at most, come to the driver.

Defined cases: a null text has its 8 bytes and is like no empty text only in its hash; null sources and
languages are one value each; an empty table gives no rows; with fewer groups than shards some stay empty;
repeated rows take a slot each. A text of any length is one point: a shard holds it whole, also if it is larger than the target.
Extra columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outlyr.llm.common import keyed_join, running, scratch, written

SHARDS, PIECES = 24, 64
#: Bits of a dimension's position, and of the text's hash and the piece that order ties.
VALUE_BITS, HASH_BITS, PIECE_BITS, STEP = 28, 24, 11, 16
TIE_BITS = HASH_BITS + PIECE_BITS
_DIMENSIONS = ("size", "source", "lang")


def _points(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """_g, _piece, weight, n (rows), a position along each dimension and _tie of every point; and ``rows`` with their pieces."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first().s
    piece = max(total // (shards * PIECES), 1)
    groups = rows.groupBy("_g").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"), F.max("size").alias("_size"), F.min("source").alias("_source"), F.min("lang").alias("_lang"))
    # a piece holds one document at least
    pieces = F.least(F.col("_rows"), F.greatest(F.ceil(F.col("_bytes") / piece), F.lit(1)), F.lit(1 << PIECE_BITS)).cast("int")
    last = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("t"))
    value = {"size": F.floor(F.log2(F.col("_size").cast("double")) * 64), "source": last(F.col("_source")), "lang": last(F.col("_lang"))}
    groups = written(groups.select("_g", "_bytes", pieces.alias("_pieces"), *[v.alias(f"_v{d}") for d, v in value.items()]), "groups")
    n = groups.count()
    at = groups
    for d in _DIMENSIONS:
        values = groups.groupBy(f"_v{d}").agg(F.sum("_bytes").alias("_w"), F.count("*").alias("_n"))
        below = running(values, [], [f"_v{d}"], {"_below": "_w"}, f"values-{d}")
        place = F.floor(F.col("_below") * F.lit((1 << VALUE_BITS) / max(total, 1))).cast("long")
        places = written(below.select(f"_v{d}", "_n", place.alias(f"_{d}")), f"places-{d}")
        at = written(keyed_join(at, places, [f"_v{d}"], "_n", n).drop("_n", f"_v{d}"), f"at-{d}")
    at = at.drop("_bytes", "_pieces")
    # a group of several pieces holds more than a piece's bytes, so there are shards * PIECES at most
    large = F.broadcast(groups.where("_pieces > 1").select("_g", "_pieces"))
    dealt = written(_dealt(rows, large), "dealt")
    sums = dealt.groupBy("_g", "_piece").agg(F.sum("size").alias("weight"), F.count("*").alias("n"))
    tie = F.shiftleft(F.pmod(F.xxhash64("_g"), F.lit(1 << HASH_BITS)), PIECE_BITS) + F.col("_piece")
    return written(sums.join(at, "_g").withColumn("_tie", tie), "points"), dealt


def _dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``rows`` with their piece of a group of several. Equal rows go to successive pieces; which of them goes where is alike."""
    marked = rows.join(large, "_g", "left")
    alone = marked.where("_pieces is null").withColumn("_piece", F.lit(0))
    several = marked.where("_pieces is not null").select("*", F.lit(1).alias("_one"), F.monotonically_increasing_id().alias("_row"))
    several = running(several, ["_g", "doc_id", "source", "lang"], ["_row"], {"_k": "_one"}, "equal")
    several = several.withColumn("_piece", F.pmod(F.xxhash64("doc_id", "source") + F.col("_k"), F.col("_pieces")).cast("int"))
    return alone.select(*rows.columns, "_piece").unionByName(several.select(*rows.columns, "_piece"))


def leaves(points: DataFrame, shards: int) -> DataFrame:
    """``points`` with the first shard of their leaf as ``node``."""
    # a node is named by its first shard; nodes: that and its number of shards
    nodes: dict[int, int] = {0: shards}
    placed = points.withColumn("node", F.lit(0))
    while any(n > 1 for n in nodes.values()):
        cuts = _split(placed, nodes)
        at = placed.join(F.broadcast(_few(placed, "node int, dim int, cut long, half int", [(k, d, c, nodes[k] // 2) for k, (d, c) in cuts.items()])), "node", "left")
        right = F.coalesce(_position(F.col("dim")) >= F.col("cut"), F.lit(False))
        placed = written(at.withColumn("node", F.when(right, F.col("node") + F.col("half")).otherwise(F.col("node"))).drop("dim", "cut", "half"), "placed")
        nodes = {k: v for first, n in nodes.items() for k, v in (((first, n // 2), (first + n // 2, n - n // 2)) if n > 1 else ((first, n),))}
    return placed


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``. Tables that the result does not read are deleted."""
    t = F.coalesce(F.col("text"), F.lit(""))
    with scratch(docs.sparkSession) as keep:
        rows = docs.select("doc_id", (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64("text", F.crc32(t.cast("binary"))).alias("_g"), "source", "lang")
        rows = written(rows, "rows")
        total = rows.count()
        points, pieces = _points(rows, shards)
        leaf = written(leaves(points, shards).select("_g", "_piece", "n", F.col("node").alias("shard")), "leaves")
        dealt = keyed_join(pieces, leaf, ["_g", "_piece"], "n", total)
        dealt = dealt.select("doc_id", "size", "text_crc32", "shard", F.lit(1).alias("_one"), F.xxhash64("_g", "source", "lang").alias("_o"))
        slots = running(dealt, ["shard"], ["doc_id", "_o"], {"slot": "_one"}, "slots")
        keep(slots)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _few(like: DataFrame, schema: str, rows: list[tuple]) -> DataFrame:
    """A table of a row for each node: fewer than the shards, so it is broadcast."""
    return like.sparkSession.createDataFrame(rows, schema)


def _position(dim: Column) -> Column:
    """Where a point lies along a dimension: its value's place, then its text's hash and its piece."""
    return F.get(F.array(*[F.col(f"_{d}") for d in _DIMENSIONS]), dim) * F.lit(1 << TIE_BITS) + F.col("_tie")


def _split(placed: DataFrame, nodes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each node of more than one shard: its widest dimension and the position where it is cut."""
    spread = placed.groupBy("node").agg(F.sum("weight").alias("w"), *[(F.max(f"_{d}") - F.min(f"_{d}")).alias(d) for d in _DIMENSIONS]).collect()
    spread = [r for r in spread if nodes[r.node] > 1]
    widest = {r.node: max(range(len(_DIMENSIONS)), key=lambda i, r=r: r[_DIMENSIONS[i]]) for r in spread}
    # what is to be below the cut, and where the search stands: cells of a width, from a position on
    below = {r.node: r.w * (nodes[r.node] // 2) / nodes[r.node] for r in spread}
    start = dict.fromkeys(widest, 0)
    for width in (47, 31, 15, 0):
        search = _few(placed, "node int, dim int, begin long, want double", [(k, widest[k], start[k], float(below[k])) for k in widest])
        rows = placed.join(F.broadcast(search), "node").select("node", "want", "weight", F.shiftright(_position(F.col("dim")) - F.col("begin"), width).alias("_cell"))
        cells = rows.where(F.col("_cell").between(0, (1 << STEP) - 1)).groupBy("node", "_cell").agg(F.sum("weight").alias("w"), F.first("want").alias("want"))
        upto = cells.withColumn("_upto", F.sum("w").over(Window.partitionBy("node").orderBy("_cell")))
        hit = upto.where(F.col("_upto") >= F.col("want")).groupBy("node").agg(F.min(F.struct("_cell", "w", "_upto")).alias("c")).collect()
        for r in hit:
            start[r.node] += r.c["_cell"] << width
            below[r.node] -= r.c["_upto"] - r.c["w"]
            if width == 0 and below[r.node] > r.c["w"] / 2:
                start[r.node] += 1  # the point as a whole lies nearer below
    return {k: (widest[k], start[k]) for k in widest}
