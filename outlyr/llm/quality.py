"""Quality rules with risk-controlled cutoffs (op1), in DataFrame operations alone.

Each rule rejects a document if a ratio is above a cutoff. A *setting* gives all rules their cutoffs at
once: the usual ones (USUAL) times one of FACTORS, from loose to strict. This path is fixed beforehand; the
labelled documents that pass the base rules choose a setting on it for each stratum (language).

A setting is *certified* if the hypothesis "more than ``alpha`` of the stratum's good documents that pass
the base rules are rejected by any rule" is refuted by the exact binomial test, P(Bin(n, alpha) <= k) <=
``delta`` times the stratum's share of all good labelled texts. Settings are tested from the loosest on, and testing stops at the first that fails
(fixed sequence, so a stratum's path errs with its own level at most); over the strata the level is
shared out by their numbers of good labelled texts, which say nothing of what is rejected (weighted Bonferroni). So with probability 1 - delta or more, over the draw of the labels, in
no stratum do the rules reject more than ``alpha`` of the good documents among those that pass the base
rules; what the base rules reject is not part of the guarantee. Without any false rejection
log(delta * share) / log(1 - alpha) good labels are needed, 217 in each of four strata of equal size. Of certified settings
the one with the largest gain is taken: share of bad documents rejected less PRICE times that of good
ones, the loosest of equals. A stratum without a certified setting, or without gain, rejects nothing.

Defined cases: a null or empty text has no words and fails the base rules; a null language is a
stratum of its own; several labels of a document count as one, the lowest; equal texts of a stratum, which are no independent
draws, count as one with the lowest of their labels, repeated rows among them; unlabelled documents and
null qualities take no part in the choice; with no labels only the base rules reject; repeated rows
are judged each; an empty table gives an empty one. Texts of any length are taken whole,
in one row's memory. Extra columns take no part, whatever their names; ``kept`` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from outlyr.llm.common import SPACES, few, words, written
from outlyr.llm.native import let, runs, without

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
ALPHA, DELTA, PRICE = 0.02, 0.05, 5.0
#: Cutoffs in common use, and the factors that make the path of settings, from loose to strict.
USUAL = {"symbols": 0.1, "capitals": 0.3, "exclaims": 0.1, "repeats": 0.3, "lines": 0.4}
FACTORS = (5.0, 4.0, 3.2, 2.5, 2.0, 1.6, 1.3, 1.15, 1.0, 0.85, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)
NONE = "\x00"


def repeated(ws: Column) -> Column:
    """Positions covered by WINDOW-word windows that occur twice or more."""

    def covered(starts: Column) -> Column:
        widths = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(widths, F.lit(0), lambda a, x: a + x)

    def among(s: Column) -> Column:
        twice = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        return let(F.array_sort(F.transform(twice, lambda e: e["i"])), covered)

    def of(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), let(pairs, among)).otherwise(F.lit(0))

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    return let(let(hashes, lambda h: runs(h, WINDOW)), of).cast("long")


def metrics(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, a hash of every whole text as ``_h``, and its counts as ``_m`` struct."""
    t = F.coalesce(F.col("text"), F.lit(""))
    a = df.select(*keep, t.alias("_t"), F.xxhash64(t).alias("_h"))
    keep = [*keep, "_h"]
    lines = F.filter(F.split("_t", "\n"), lambda x: without(x, SPACES + " ") > 0)
    a = a.select(*keep, "_t", words(F.col("_t")).alias("_w"), let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).alias("_d"), F.size(lines).alias("_l"))
    a = a.select(
        *keep,
        F.struct(
            F.size("_w").cast("long").alias("n_words"),
            without(F.col("_t"), SPACES + " ").cast("long").alias("word_chars"),
            (F.length("_t") - without(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
            F.col("_d").cast("long").alias("n_dup_lines"),
            repeated(F.col("_w")).alias("n_repeat_words"),
            F.col("_l").cast("long").alias("n_lines"),
            (F.length("_t") - without(F.col("_t"), CAPITALS)).cast("long").alias("n_capitals"),
            (F.length("_t") - without(F.col("_t"), "!")).cast("long").alias("n_exclaims"),
        ).alias("_m"),
    )
    return a


def base_failed(m: str = "_m") -> Column:
    c = F.col(m)
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def rules(m: str = "_m") -> dict[str, Column]:
    """The ratios that cutoffs bound; a text without words has none."""
    c = F.col(m)
    per = lambda a, b: F.coalesce(F.try_divide(c[a].cast("double"), c[b].cast("double")), F.lit(0.0))
    return {
        "symbols": per("n_symbols", "word_chars"),
        "capitals": per("n_capitals", "word_chars"),
        "exclaims": per("n_exclaims", "n_words"),
        "repeats": per("n_repeat_words", "n_words"),
        "lines": per("n_dup_lines", "n_lines"),
    }


def _tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms; 1 where k is not below n * p, which certifies nothing."""
    import math

    odds = math.log(p / (1 - p))
    start = F.struct((n * F.lit(math.log1p(-p))).alias("term"), (n * F.lit(math.log1p(-p))).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        top = F.greatest(s["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(s["sum"] - top) + F.exp(term - top))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("CAST(array() AS array<bigint>)"))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, step, lambda s: s["sum"])))


def level(m: str = "_m") -> Column:
    """How many settings reject a document: the strictest so many of the path."""

    def rejecting(rule: str, value: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(f * USUAL[rule]) for f in FACTORS]), lambda cut: value > cut))

    reject = [rejecting(r, v) for r, v in rules(m).items()]
    return F.greatest(*reject)


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each stratum that rejects anything: ``_stratum`` and ``_setting``, its place on the path.

    ``measured`` has doc_id, lang, ``_m`` and, where texts may be equal, ``_h``. All strata with labels take part, and
    each of their texts is one draw.
    """
    text = "_h" if "_h" in measured.columns else "doc_id"
    truth = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q"))
    held = measured.where(~base_failed()).select("doc_id", F.col(text).alias("_text"), F.coalesce("lang", F.lit(NONE)).alias("_stratum"), level().alias("_level")).join(truth, "doc_id")
    held = held.groupBy("_stratum", "_text").agg(F.min("_q").alias("_q"), F.max("_level").alias("_level"))
    counted = held.groupBy("_stratum", "_level").agg(F.count_if(F.col("_q") > 0).alias("good"), F.count_if(F.col("_q") <= 0).alias("bad"))
    steps = counted.groupBy("_stratum").agg(F.collect_list(F.struct("_level", "good", "bad")).alias("_c"), F.sum("good").alias("n"), F.sum("bad").alias("n_bad"))
    total = steps.agg(F.sum("n").alias("_total"))
    above = lambda what: F.expr(f"aggregate(filter(_c, e -> e._level >= {len(FACTORS)} - _j), 0L, (a, e) -> a + e.{what})")
    tested = steps.crossJoin(F.broadcast(total)).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(FACTORS) - 1))))  # one row a stratum
    tested = tested.select("_stratum", "_j", "_total", "n", "n_bad", above("good").alias("k"), above("bad").alias("k_bad"))
    passed = _tail(F.col("n"), F.col("k"), alpha) <= F.lit(delta) * F.col("n") / F.col("_total")
    chain = Window.partitionBy("_stratum").orderBy("_j")
    tested = tested.withColumn("_ok", passed & (F.col("n") > 0)).withColumn("_all", F.min(F.col("_ok").cast("int")).over(chain) == 1)
    gain = F.coalesce(F.try_divide(F.col("k_bad"), F.col("n_bad")), F.lit(0.0)) - PRICE * F.coalesce(F.try_divide(F.col("k"), F.col("n")), F.lit(0.0))
    best = tested.where("_all").withColumn("_gain", gain).groupBy("_stratum").agg(F.max(F.struct("_gain", (-F.col("_j")).alias("_nj"))).alias("_b"))
    return best.where(F.col("_b._gain") > 0).select("_stratum", (-F.col("_b._nj")).alias("_setting"))


def _judged(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measured`` with ``_kept``; ``cuts`` is a written table, broadcast if it has few rows."""
    joined = measured.withColumn("_stratum", F.coalesce("lang", F.lit(NONE))).join(few(cuts), "_stratum", "left")
    return joined.withColumn("_kept", ~base_failed() & ~F.coalesce(level() >= len(FACTORS) - F.col("_setting"), F.lit(False)))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document. Texts are read once."""
    measured = written(metrics(docs.select("doc_id", "lang", "text"), ["doc_id", "lang"]), "quality")
    done = _judged(measured, written(cutoffs(measured, labels), "cutoffs"))
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return done.select("doc_id", *[F.col("_m")[c].alias(c) for c in shown], base_failed().alias("base_failed"), F.col("_kept").alias("kept"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with the same columns, that the rules keep. Texts are measured once, and written with their measures."""
    packed = docs.select("doc_id", "lang", "text", F.struct(*docs.columns).alias("all"))
    measured = written(metrics(packed, ["doc_id", "lang", "all"]), "quality")
    cuts = written(cutoffs(measured, labels), "cutoffs")
    return _judged(measured, cuts).where("_kept").select("all.*")
