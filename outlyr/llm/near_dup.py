"""Near-duplicate groups by circulant MinHash, banding and exact verification (op3).

Signatures. The 5-word shingles of a lower-cased text, as 64-bit hashes, are placed on a ring of D
positions by a first permutation; a second one, shifted by k positions round the ring, gives the
k-th coordinate: the least value over the set. One table and its wrap-around serve all K shifts, so
the coordinates of a shingle are K neighbouring cells.

Candidates. K = BANDS * ROWS coordinates; a pair of similarity s shares a band with probability
1 - (1 - s^ROWS)^BANDS: above 1 - 4e-6 at s = 0.75. Equal sets are one class, which one document
speaks for.

Verification is on full sets: |A & B| * 100 >= 75 * |A | B|. What is asked for is the classes'
components, so pairs need be checked only until the components are known:
1. in each bucket (a band's value) each member is offered the most central one, which shares most
   buckets with others; of a document's offers the PARTNERS most alike by sketch are checked;
2. while the pairs that step 3 would look at are more than LIGHT times the bucket rows, and each
   round halves them, members outside their bucket's largest component are offered one of its
   members, another in each round;
3. where DIRECT members at most are outside a bucket's largest component, these are held against all of it
   in a join that makes rows for links alone, in blocks of about MOST against MOST members. Sizes and
   a 384-bit sketch of the signatures (6 standard deviations below 0.75) decide most; what they leave
   open is compared by sets of 32-bit hashes, with as much slack as hashes fall together, in the
   first band that the pair shares alone;
4. the members of all other buckets, such as texts under one template that are not links of each other, meet
   by their rarest shingles. In one order of all shingles, rarest first, the first that a link of sizes a
   and b has in common has 3/7 (a + b) - 1 common ones after it in either set, so it is among the first
   a/7 + 1 of the shorter and b/4 + 1 of the longer. A template is less than 6/7 of texts of one size that
   are no links of each other, so its shingles, the frequent ones, are not among their first.
   Pairs that meet so are decided by sizes, places and sketch.
So nothing is capped, no bucket has to fit a task, and no link of one bucket is lost. What remains quadratic is a
rare shingle's number of texts outside its largest component, as when texts are put together from few passages.
Links are confirmed on full sets, which are joined to chosen pairs, at most EACH pairs to one copy of a set.

Components are kept as a table that each step's links change: links join components, and the
components of that small graph are found by rounds of pointers.

Defined cases: texts without words have the empty set and no links; fewer than 5 words are one
shingle; rows of one doc_id are one node, those without words included; a null doc_id has no links, component null, and is kept;
repeated rows give one result row each. An empty table gives an empty one. Texts of any length are
taken whole: a set takes 8 bytes a shingle. Extra columns take no part, whatever their names;
``survivors`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlyr.llm.common import few, keyed_join, scratch, written

SHINGLE, BANDS, ROWS = 5, 64, 6
K, D = BANDS * ROWS, 1 << 20
#: Bits of the sketch that a pair of similarity 0.75 agrees in: 7/8 of K, less 6 deviations.
AGREE = int(K * 0.875 - 6 * (K * 0.875 * 0.125) ** 0.5)
PERCENT, PARTNERS, EACH = 75, 4, 1000
#: Members and shingles of a block in which all pairs are looked at.
MOST, MOST_SHINGLES = 1000, 4_000_000
#: Pairs looked at a bucket row that need no further round, and rounds at most.
LIGHT, ROUNDS = 16, 6
#: Members outside a bucket's largest component that are held against the whole bucket.
DIRECT = 64
_CELLS = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _ring() -> np.ndarray:
    """The second permutation of D values, with its first K cells again at the end."""
    p = np.random.Generator(np.random.PCG64(20)).permutation(D).astype(np.uint32)
    return np.concatenate((p, p[:K]))


class Shingler:
    """Shingle sets of texts; hashes of words are remembered within a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def sets(self, text: str) -> np.ndarray:
        """The sorted distinct 64-bit shingle hashes of a text (as signed integers)."""
        import xxhash

        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.int64)
        if len(self.known) > 500_000:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(len(h) - SHINGLE + 1, 1)
        out = np.full(n, np.uint64(min(len(h), SHINGLE)))
        for i in range(min(SHINGLE, len(h))):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        return np.unique(out.view(np.int64))


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def signature(s: np.ndarray) -> np.ndarray:
    """The K coordinates of a set of shingle hashes."""
    ring = np.lib.stride_tricks.sliding_window_view(_ring(), K)
    at = (_mix(s.view(np.uint64)) >> np.uint64(44)).astype(np.int64)  # the first permutation's place on the ring
    best = np.full(K, D, np.uint32)
    for i in range(0, len(at), _CELLS):
        np.minimum(best, ring[at[i : i + _CELLS]].min(axis=0), out=best)
    return best


def _bands(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for r in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + r)
    return h.view(np.int64)


def _sketch(sig: np.ndarray) -> np.ndarray:
    bits = (_mix(sig.astype(np.uint64) + np.uint64(7)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, set_hi, set_lo (a 128-bit hash of the set), bands and sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        sh = Shingler()
        for b in batches:
            rows = []
            for x in b["text"]:
                s = sh.sets(x or "")
                if len(s):
                    sig, d = signature(s), xxhash.xxh3_128_intdigest(s.tobytes())
                    rows.append((len(s), (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63, _bands(sig), _sketch(sig)))
                else:
                    rows.append((0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_hi", "set_lo", "bands", "sketch"])
            yield out.assign(doc_id=b["doc_id"].to_numpy(), row=b["row"].to_numpy())

    schema = "n_shingles long, set_hi long, set_lo long, bands array<long>, sketch array<long>, doc_id long, row long"
    return docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row")).mapInPandas(run, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id and the sorted distinct shingle hashes of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh = Shingler()
        for b in batches:
            yield pd.DataFrame({"id": b["doc_id"], "set": [sh.sets(x or "") for x in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "id long, set array<long>")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the least node reachable) for undirected ``edges`` (a, b).

    Every round points nodes at the least root among their neighbours' and shortens the pointers;
    the rounds grow with the logarithm of the longest path. Each round is written to the shared
    folder, and only counts come to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    e = written(both, name)
    total = e.count()
    label = written(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("c"), F.count("*").alias("n")), name)
    while True:
        # the least label around each node; a node has as many edges as it has neighbours
        seen = keyed_join(e, label.select(F.col("node").alias("b"), F.col("c").alias("cb"), "n"), ["b"], "n", total)
        near = label.join(seen.groupBy(F.col("a").alias("node")).agg(F.min("cb").alias("m")), "node")
        near = written(near.select("node", "n", "c", F.least("c", "m").alias("m")), name)
        # a root takes the least label that any of its members sees, and every node then follows its root
        roots = near.groupBy("c").agg(F.min("m").alias("r"), F.count("*").alias("k"))
        moved = keyed_join(near, roots, ["c"], "k", total)
        moved = written(moved.select("node", "n", F.col("c").alias("old"), F.least("m", "r").alias("c")), name)
        sizes = moved.groupBy("c").agg(F.count("*").alias("k"))
        jump = sizes.join(moved.select(F.col("node").alias("c"), F.col("c").alias("to")), "c")
        short = keyed_join(moved, jump, ["c"], "k", total)
        short = written(short.select("node", "n", F.coalesce("to", "c").alias("c"), "old"), name)
        label = short.select("node", "c", "n")
        if short.where("c <> old").isEmpty():
            return label.select("node", F.col("c").alias("component"))


def merged(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components ``found`` (node, component; a node that is missing is its own) joined by ``links``.

    ``links`` has ca and cb, the components of two ends.
    """
    moved = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "merged")
    if found is None:
        return moved
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = found.join(few(to), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(old.unionByName(moved.join(few(found.select("node")), "node", "left_anti")), "found")


def verified(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``pairs`` (a, b and more) whose full sets reach the similarity.

    A set that many pairs ask for is copied once for each EACH of them, so that no task holds all
    pairs of a document.
    """
    pairs = written(pairs.distinct(), name)
    ends = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("n")), name)
    sets = shingle_sets(_texts(docs, ends.select("doc_id")))
    # ids with more than EACH pairs: at most 2 / EACH as many as pairs
    busy = few(ends.where(F.col("n") > EACH).select(F.col("doc_id").alias("id"), F.ceil(F.col("n") / EACH).alias("copies")))
    copied = sets.join(busy, "id", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)))

    def attached(df: DataFrame, end: str, other: str, out: str) -> DataFrame:
        dealt = df.withColumn("id", F.col(end)).join(busy, "id", "left").withColumn("copy", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))))
        return dealt.drop("copies").join(copied.select("id", "copy", F.col("set").alias(out)), ["id", "copy"]).drop("id", "copy")

    both = attached(attached(pairs, "b", "a", "sb"), "a", "b", "sa")
    inter = F.size(F.array_intersect("sa", "sb"))
    return written(both.where(100 * inter >= PERCENT * (F.size("sa") + F.size("sb") - inter)).select(*pairs.columns).distinct(), name)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some doc_ids. Ids are broadcast if they are few, so that the other texts stay where they are."""
    return docs.select(F.col("doc_id").cast("long"), "text").join(few(ids), "doc_id", "left_semi")


def _agree(x: str, y: str) -> Column:
    """The bits that two sketches have in common."""
    return F.lit(K) - sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(K // 64)), F.lit(0))


def _near(x: str, y: str) -> Column:
    """Whether two sizes leave the similarity open."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def buckets(sig: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal sets (set_hi, set_lo, rep, rows), the rows that speak for them (id, n, sketch, bands), and shared buckets (bucket, band, id, n, members)."""
    real = sig.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "row")).alias("f")
    sets = written(real.groupBy("set_hi", "set_lo").agg(first, F.count("*").alias("rows")).select("set_hi", "set_lo", F.col("f.doc_id").alias("rep"), F.col("f.row").alias("row"), "rows"), "sets")
    firsts = real.join(few(sets.select("row")), "row", "left_semi")
    nodes = written(firsts.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch", "bands"), "nodes")
    spread = nodes.select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    several = written(spread.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "several")
    shared = keyed_join(spread, several, ["bucket"], "members", BANDS * sets.count())
    return sets, nodes, written(shared.select("bucket", "band", "id", "n", "members"), "buckets")


def _with_hub(tops: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tops`` with the size and sketch of their column hub."""
    return written(tops.join(nodes.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch")), "hub"), "hubs")


def _central(shared: DataFrame) -> DataFrame:
    """bucket, members and hub: the member that shares most buckets with others, the least id of equals."""
    weight = shared.groupBy("id").agg(F.sum("members").alias("w"))
    top = shared.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("w", (-F.col("id")).alias("neg"), "members")).alias("h"))
    return top.select("bucket", F.col("h.members").alias("members"), (-F.col("h.neg")).alias("hub"))


def _chosen(offers: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b and their components ca, cb: of each document's ``offers`` (id, c and hub, hc, hub_n, hub_sketch) the PARTNERS most alike."""
    own = offers.join(nodes.select("id", "n", "sketch"), "id").where(_near("n", "hub_n")).withColumn("agree", _agree("sketch", "hub_sketch"))
    best = own.where(F.col("agree") >= AGREE).groupBy("id", "c").agg(F.slice(F.sort_array(F.collect_set(F.struct("agree", "hub", "hc")), False), 1, PARTNERS).alias("h"))
    pairs = best.select("id", "c", F.explode("h").alias("h"))
    return pairs.select(F.least("id", "h.hub").alias("a"), F.greatest("id", "h.hub").alias("b"), F.col("c").alias("ca"), F.col("h.hc").alias("cb"))


def _placed(shared: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, band, id, n and the component so far."""
    at = shared.join(found.withColumnRenamed("node", "id"), "id", "left")
    return written(at.select("bucket", "band", "id", "n", F.coalesce("component", "id").alias("c")), "placed")


def _mixed(placed: DataFrame, k: int) -> DataFrame:
    """Buckets of several components: their rows and shingles (now, size), the largest component (top, top_rows, top_size) and the k-th choice of its members (hub)."""
    by = placed.groupBy("bucket", "c").agg(F.count("*").alias("rows"), F.sum("n").alias("size"), F.min(F.struct(F.xxhash64("bucket", "id", F.lit(k)).alias("h"), "id")).alias("pick"))
    top = by.groupBy("bucket").agg(F.sum("rows").alias("now"), F.sum("size").alias("size"), F.count("*").alias("parts"), F.max(F.struct("rows", "c", "size", "pick")).alias("t")).where("parts > 1")
    return written(top.select("bucket", "now", "size", F.col("t.rows").alias("top_rows"), F.col("t.size").alias("top_size"), F.col("t.c").alias("top"), F.col("t.pick.id").alias("hub")), "mixed")


def _left(placed: DataFrame, mixed: DataFrame, nodes: DataFrame, docs: DataFrame, total: int) -> DataFrame:
    """a, b, ca, cb of all pairs of one bucket and two components whose sets, as 32-bit hashes, can reach the similarity.

    Of such a pair one at least is outside the bucket's largest component. These few are dealt into blocks, as
    are all members, and each block of the one meets each of the other. A pair is taken where its first common band is.
    """
    parts = lambda n, size: F.ceil(F.greatest(n / MOST, size / MOST_SHINGLES))
    blocks = mixed.select("bucket", "now", "top", parts(F.col("now"), F.col("size")).alias("of_all"), parts(F.col("now") - F.col("top_rows"), F.col("size") - F.col("top_size")).alias("of_few"))
    rows = written(keyed_join(placed, written(blocks, "blocks"), ["bucket"], "now", total), "open")
    ids = written(rows.select(F.col("id").alias("doc_id")).distinct(), "ids")
    own = nodes.select("id", F.col("n").alias("size"), "sketch", F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("bands"))
    sets = shingle_sets(_texts(docs, ids)).select("id", F.size("set").alias("size"), F.array_distinct(F.transform("set", lambda x: F.shiftright(x, 32).cast("int"))).alias("set"))
    # a doc_id of several texts has several sets, told apart by their sizes; equal sizes make candidates only
    known = own.join(sets, ["id", "size"]).withColumn("slack", F.col("size") - F.size("set"))
    rows = rows.join(known, "id").where(F.col("n") == F.col("size")).withColumn("before", F.expr("slice(bands, 1, band)"))
    rows = written(rows.select("bucket", "id", "c", "n", "top", "of_all", "of_few", "sketch", "before", "set", "slack"), "members")
    block = lambda of: F.pmod(F.xxhash64("id", F.lit(of)), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    side = lambda x, df, p, q: df.select("bucket", p.alias("p"), q.alias("q"), *[F.col(c).alias(f"{x}_{c}") for c in ("id", "c", "n", "top", "sketch", "before", "set", "slack")])
    a, b = side("a", rows, block("of_all"), every("of_few")), side("b", rows.where("c <> top"), every("of_all"), block("of_few"))
    once = (F.col("a_c") == F.col("a_top")) | (F.col("a_id") < F.col("b_id"))
    first = ~F.exists(F.zip_with("a_before", "b_before", lambda x, y: x == y), lambda e: e)
    inter = F.size(F.array_intersect("a_set", "b_set")) + F.least("a_slack", "b_slack")
    alike = 100 * inter >= PERCENT * (F.col("a_n") + F.col("b_n") - inter)
    cheap = (F.col("a_c") != F.col("b_c")) & once & _near("a_n", "b_n")
    open_ = F.when(cheap, F.when(_agree("a_sketch", "b_sketch") >= AGREE, F.when(first, alike).otherwise(F.lit(False))).otherwise(F.lit(False))).otherwise(F.lit(False))
    both = a.join(b, ["bucket", "p", "q"]).where(open_)
    return both.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), F.col("a_c").alias("ca"), F.col("b_c").alias("cb"))


def _rare(placed: DataFrame, heavy: DataFrame, nodes: DataFrame, docs: DataFrame, total: int) -> DataFrame:
    """a, b, ca, cb of the pairs of two components, among members of ``heavy`` buckets, that their rarest shingles, sizes and sketches leave open."""
    ids = written(keyed_join(placed, written(heavy.select("bucket", "now"), "heavy"), ["bucket"], "now", total).select("id", "c").distinct(), "heavy_ids")
    sets = shingle_sets(_texts(docs, ids.select(F.col("id").alias("doc_id")))).where(F.size("set") > 0)
    sets = written(sets.withColumn("key", F.xxhash64("set")).dropDuplicates(["id", "key"]), "heavy_sets")
    shingles = sets.select("id", "key", F.size("set").alias("n"), F.explode("set").alias("bucket"))
    # shingles of one text alone come first in the order, so their number is all that places need
    often = written(shingles.groupBy("bucket").agg(F.count("*").alias("df")).where("df > 1"), "often")
    ranked = keyed_join(shingles, often, ["bucket"], "df", sets.agg(F.coalesce(F.sum(F.size("set")), F.lit(0)).alias("n")).first().n)
    own = ranked.groupBy("id", "key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "bucket"))).alias("s")).withColumn("alone", F.col("n") - F.size("s"))
    first = own.withColumn("take", (F.floor(F.col("n") / 4) + 1 - F.col("alone")).cast("int")).where("take > 0")
    rows = first.select("id", F.col("n").cast("long").alias("n"), "alone", F.posexplode(F.slice("s", F.lit(1), F.col("take"))).alias("k", "s"))
    rows = rows.select("id", "n", (F.col("alone") + F.col("k")).cast("long").alias("at"), F.col("s.bucket").alias("bucket"))
    rows = rows.join(few(ids), "id").join(nodes.select("id", "n", "sketch"), ["id", "n"]).withColumn("short", F.col("at") * 7 <= F.col("n"))
    rows = written(rows, "prefixes")
    by = rows.groupBy("bucket", "c").agg(F.count("*").alias("rows"), F.max("short").alias("short"))
    top = by.groupBy("bucket").agg(F.sum("rows").alias("now"), F.max("short").alias("short"), F.count("*").alias("parts"), F.max(F.struct("rows", "c")).alias("t")).where("short and parts > 1")
    parts = lambda n: F.ceil(n / MOST)
    blocks = top.select("bucket", "now", F.col("t.c").alias("top"), parts(F.col("now")).alias("of_all"), parts(F.col("now") - F.col("t.rows")).alias("of_few"))
    rows = written(keyed_join(rows, written(blocks, "blocks"), ["bucket"], "now", rows.count()), "rare")

    def side(x: str, df: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        mine, theirs = F.pmod(F.xxhash64("id", F.lit(own)), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return df.select("bucket", mine.alias(names[0]), theirs.alias(names[1]), *[F.col(c).alias(f"{x}_{c}") for c in ("id", "c", "n", "at", "sketch")])

    def met(short: DataFrame, long: DataFrame, of_short: str, of_long: str) -> DataFrame:
        both = side("a", short, of_short, of_long, ("p", "q")).join(side("b", long, of_long, of_short, ("q", "p")), ["bucket", "p", "q"])
        longer = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_id") < F.col("b_id")))
        after = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
        cheap = (F.col("a_c") != F.col("b_c")) & longer & _near("a_n", "b_n") & (7 * after >= 3 * (F.col("a_n") + F.col("b_n")))
        found = both.where(F.when(cheap, _agree("a_sketch", "b_sketch") >= AGREE).otherwise(F.lit(False)))
        return found.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), F.col("a_c").alias("ca"), F.col("b_c").alias("cb"))

    few_, most = F.col("c") != F.col("top"), F.col("c") == F.col("top")
    return met(rows.where(F.col("short") & few_), rows, "of_few", "of_all").unionByName(met(rows.where(F.col("short") & most), rows.where(few_), "of_all", "of_few"))


def _open_pairs(placed: DataFrame, mixed: DataFrame, nodes: DataFrame, docs: DataFrame, total: int) -> DataFrame:
    """a, b, ca, cb of all pairs of one bucket and two components that can be links."""
    direct = F.col("now") - F.col("top_rows") <= DIRECT
    pairs, heavy = _left(placed, mixed.where(direct), nodes, docs, total), mixed.where(~direct)
    return pairs if heavy.isEmpty() else pairs.unionByName(_rare(placed, heavy, nodes, docs, total))


def linked(docs: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """node, component of the documents that links join; the others are alone."""
    total = shared.count()
    hubs = _with_hub(_central(shared), nodes)
    offers = keyed_join(shared.select("bucket", "id"), hubs, ["bucket"], "members", total).where("id <> hub")
    offers = offers.select("id", F.col("id").alias("c"), "hub", F.col("hub").alias("hc"), "hub_n", "hub_sketch")
    found = merged(None, verified(_chosen(offers, nodes), docs, "links"))
    before = None
    for k in range(ROUNDS + 1):
        placed = _placed(shared, found)
        mixed = _mixed(placed, k)
        work = mixed.agg(F.sum((F.col("now") - F.col("top_rows")) * F.col("now")).alias("w")).first().w
        if work is None:
            return found
        if work <= LIGHT * total or k == ROUNDS or (before is not None and work > before / 2):
            break
        offers = keyed_join(placed.select("bucket", "id", "c"), _with_hub(mixed, nodes), ["bucket"], "now", total).where("c <> top")
        found = merged(found, verified(_chosen(offers.withColumn("hc", F.col("top")), nodes), docs, f"links{k}"))
        before = work
    links = verified(_open_pairs(placed, mixed, nodes, docs, total), docs, "rest")
    return found if links.isEmpty() else merged(found, links)


def _same_id(sig: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the components joined that rows of one doc_id are in."""
    own = sig.where("n_shingles > 0 and doc_id is not null").select("doc_id", "set_hi", "set_lo").distinct()
    again = own.groupBy("doc_id").count().where("count > 1").select("doc_id")
    total = sets.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    rows = keyed_join(own.join(few(again), "doc_id", "left_semi"), sets, ["set_hi", "set_lo"], "rows", total)
    rows = written(rows.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("cb")), "same")
    links = rows.join(rows.groupBy("doc_id").agg(F.min("cb").alias("ca")), "doc_id").where("ca <> cb").select("ca", "cb").distinct()
    return found if links.isEmpty() else merged(found, links)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``. Tables that the result does not read are deleted."""
    with scratch(docs.sparkSession) as keep:
        sig = keep(written(signatures(docs), "signatures"))
        sets, nodes, shared = buckets(sig)
        found = _same_id(sig, sets, linked(docs, nodes, shared))
        # a class speaks for all its rows; one class may be any share of the table
        own = sets.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        own = keep(written(own.select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component_id"), "rows"), "classes"))
        rows = own.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
        real = sig.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "set_hi", "set_lo")
        # rows without words go with the rows of their doc_id that have some
        alone = sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles")
        bare = written(alone.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("bare")), "bare")
        some = keyed_join(real.join(few(bare.select("doc_id")), "doc_id", "left_semi"), own, ["set_hi", "set_lo"], "rows", rows)
        group = keep(written(some.groupBy("doc_id").agg(F.min("component_id").alias("component_id")).join(few(bare), "doc_id"), "group"))
        total = bare.agg(F.coalesce(F.sum("bare"), F.lit(0)).alias("n")).first().n
    out = keyed_join(real, own, ["set_hi", "set_lo"], "rows", rows).select("doc_id", "n_shingles", "component_id")
    wordless = keyed_join(alone.where("doc_id is not null"), group, ["doc_id"], "bare", total, "left")
    out = out.unionByName(wordless.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.unionByName(alone.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with the same columns, that stay: one of each group, by least doc_id.

    Of several rows of one kept doc_id one stays, unless the doc_id is null.
    """
    columns = docs.columns
    packed = docs.select(F.col("doc_id").alias("id"), F.struct(*columns).alias("all"))
    gone = written(classes(docs).where("not kept").select(F.col("doc_id").alias("id")).distinct(), "gone")
    rows = packed.join(few(gone), "id", "left_anti")
    again = few(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id"))
    once = rows.join(again, "id", "left_semi").dropDuplicates(["id"])
    return rows.join(again, "id", "left_anti").unionByName(once).select("all.*")
