"""Language identification by interpolated Kneser-Ney character models (op7).

Each language's model predicts the characters of lower-cased words (runs of letters) and their
ends from the ORDER - 1 characters before; below single characters it falls back to one in ALPHABET.
A language has, for each order, a sorted array of 64-bit hashes of the n-grams it has seen, with their log
probabilities, and one of its contexts, with their back-off weights: n-grams of other languages take no room in
it. The language of a text is the one with the lowest cross-entropy per symbol; ties go to the first by code point.

The model is learned from the whole texts of a bounded sample (BOUNDS): of every label, however many there are, about
``per_label`` rows by hash of doc_id, or fewer where that would be more than ``rows`` in all, but always the row with the least
hash. Words are counted in a distributed way, each language is learned in a
task of its own, and the arrays, whose size the sample bounds, are broadcast; beyond MOST_BYTES that is an error. A fifth
of the sample, of labels with CAL_ROWS rows or more and never a label's first row, is kept from the counts and calibrates the
temperature of ``score`` and the rejection limit: a text is
rejected if its cross-entropy, scaled by the root of its length, is above what all but ``reject`` of the
calibration texts have, with a margin. What a calibration text says is a few numbers, whatever the number of languages, and
Spark takes their quantiles and means. Predictions read whole texts.

Defined cases: a null text or one without letters is ``und`` with score 0 and is rejected; null
labels and null doc_ids are not learned from, nor texts without letters; a label with one row is learned from it; with no labelled row at all every text is ``und``; repeated rows are
predicted each, and learned from each; an empty table gives an empty one. Texts of any length are scored whole, word by
word. Extra columns take no part, whatever their names; ``accepted`` returns them as they are.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyr.llm.common import few, uniform, written

ORDER = 4
#: Rows that are learned from (expected): of a label, and in all, beside one of each label.
BOUNDS = {"per_label": 1000, "rows": 200_000}
#: Labels with fewer rows lend none to calibration.
CAL_ROWS = 10
#: The temperatures that calibration chooses from.
HEATS = (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
#: Characters that are equally likely where nothing is known, and the largest model that is broadcast.
ALPHABET, MOST_BYTES = 1 << 16, 1 << 31
#: The share of calibration texts above the limit, and what the limit is then multiplied by.
REJECT, MARGIN = 0.001, 1.25
LETTERS = re.compile(r"[^\W\d_]+").findall
START, END = "\x02", "\x03"
_REMEMBERED, _CHUNK = 300_000, 1_000_000
#: Symbols beyond which a longer text is no stronger evidence.
LONG = 1000


def _mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = (h ^ (c + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _hashes(codes: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams whose k-th characters are codes[k]."""
    h = np.zeros(len(codes[0]), dtype=np.uint64)
    for c in codes:
        h = _mix(h, c)
    return h


#: Sorted n-gram hashes and their log probabilities, sorted context hashes and their logs of back-off weights.
Table = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _laid(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of padded words one after the other, the places of all that are predicted, and each word's number of them."""
    pad = START * (ORDER - 1)
    codes = np.frombuffer("".join(pad + w + END for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    first = np.cumsum(sizes + ORDER - 1) - sizes
    at = np.arange(sizes.sum()) + np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return codes, at, sizes


def learn(words: list[str], counts: np.ndarray) -> list[Table]:
    """The tables of one language, for orders 1 to ORDER, from distinct words and how often each stands."""
    codes, at, sizes = _laid(words)
    grams = np.stack([codes[at - i] for i in range(ORDER - 1, -1, -1)], axis=1)
    weight = np.repeat(np.asarray(counts, np.float64), sizes)
    levels = []
    for k in range(ORDER, 0, -1):  # of lower orders it is counted how many characters stand before
        keys, first, inverse = np.unique(_hashes(list(grams.T)), return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=weight)
        grams = grams[first]
        levels.append((keys, count, grams))
        grams, weight = grams[:, 1:], np.ones(len(grams))
    tables: list[Table] = []
    lower: np.ndarray | None = None
    for keys, count, grams in reversed(levels):
        k = grams.shape[1]
        context = _hashes(list(grams[:, :-1].T)) if k > 1 else np.zeros(len(grams), np.uint64)
        ckeys, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, weights=count)
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        back = discount * np.bincount(inverse) / total
        behind = lower[np.searchsorted(tables[-1][0], _hashes(list(grams[:, 1:].T)))] if k > 1 else 1.0 / ALPHABET
        lower = np.maximum(count - discount, 0) / total[inverse] + back[inverse] * behind
        tables.append((keys, np.log(lower).astype(np.float32), ckeys, np.log(back).astype(np.float32)))
    return tables


@dataclass
class Model:
    langs: list[str]
    tables: list[list[Table]] = field(default_factory=list)
    usual: float = 0.0
    limit: float = float("inf")
    heat: float = 1.0

    @staticmethod
    def fit(words: dict[str, dict[str, int]]) -> Model:
        langs = sorted(words)
        return Model(langs, [learn(list(words[x]), np.array(list(words[x].values()))) for x in langs])

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities [word, language] of words with their ends."""
        codes, at, sizes = _laid(words)
        # the hash of an n-gram goes on from that of its first characters, so each order has its own
        grams = [_hashes([codes[at - i] for i in range(k - 1, -1, -1)]) for k in range(1, ORDER + 1)]
        contexts = [np.zeros(len(at), np.uint64), *(_hashes([codes[at - i] for i in range(k - 1, 0, -1)]) for k in range(2, ORDER + 1))]
        starts = np.cumsum(sizes) - sizes
        return np.stack([np.add.reduceat(self._logs(t, grams, contexts), starts) for t in self.tables], axis=1)

    @staticmethod
    def _logs(tables: list[Table], grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Log probabilities of one language at all places: of the longest n-gram that it has seen, and the weights of backing off."""
        out = np.zeros(len(grams[0]), dtype=np.float32)
        rest = np.arange(len(out))
        for k in range(ORDER - 1, -1, -1):
            keys, logs, ckeys, clogs = tables[k]
            found, row = _find(keys, grams[k][rest])
            out[rest[found]] += logs[row[found]]
            rest = rest[~found]
            known, row = _find(ckeys, contexts[k][rest])
            out[rest[known]] += clogs[row[known]]
        out[rest] += np.float32(-np.log(ALPHABET))
        return out


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[row] == h, row


class Scorer:
    """Scores texts with a model; remembers the scores of words, within a bound."""

    def __init__(self, model: Model):
        self.model, self.row, self.logs = model, {}, np.zeros((0, len(model.langs)), np.float32)

    def raw(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropies [text, language] and numbers of symbols; 0 symbols: no letter."""
        entropy, sizes = [], []
        i = 0
        while i < len(texts):
            found, size = [], 0
            while i < len(texts) and (not found or size < _CHUNK):
                x = texts[i] or ""
                found.append(LETTERS(x.lower()))
                size += len(x)
                i += 1
            new = list(set().union(*found).difference(self.row))
            if len(self.row) + len(new) > _REMEMBERED:
                self.row, self.logs, new = {}, self.logs[:0], list(set().union(*found))
            if new:
                self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
                self.logs = np.concatenate((self.logs, *(self.model.words(new[j : j + 50_000]) for j in range(0, len(new), 50_000))))
            for ws in found:
                n = sum(map(len, ws)) + len(ws)
                rows = np.fromiter(map(self.row.__getitem__, ws), np.int64, len(ws))
                entropy.append(-self.logs[rows].sum(axis=0, dtype=np.float64) / max(n, 1))
                sizes.append(n)
        return np.array(entropy).reshape(len(texts), len(self.model.langs)), np.array(sizes, dtype=np.int64)


def _excess(m: Model, best: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (best - m.usual) * np.sqrt(np.minimum(np.maximum(n, 1), LONG))


def posterior(entropy: np.ndarray, n: np.ndarray, heat: float) -> np.ndarray:
    z = -entropy * (np.minimum(n, LONG) * heat)[:, None]
    z = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf))
    return z / z.sum(axis=1, keepdims=True)


def held_out(doc_id: str = "doc_id"):
    """The fixed fold that is never learned from; a null doc_id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame) -> DataFrame:
    """lang, text and cal (for the fifth that calibrates) of the sample of labelled rows.

    A label with more rows than the bound gives those whose hash of doc_id is below bound / rows, so
    about the bound, and the one with the least; a count and the least hash for each label are all that is gathered.
    """
    fit = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    fit = fit.select("lang", "doc_id", "text", uniform("doc_id").alias("u"))
    counts = written(fit.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("least")), "labels")
    bound = min(BOUNDS["per_label"], BOUNDS["rows"] / max(counts.count(), 1))
    joined = fit.join(few(counts), "lang").where((F.col("u") * F.col("n") < F.lit(float(bound))) | (F.col("u") == F.col("least")))
    cal = (F.pmod(F.xxhash64("doc_id", F.lit("cal")), F.lit(5)) == 0) & (F.col("n") >= CAL_ROWS) & (F.col("u") > F.col("least"))
    return joined.select("lang", "text", cal.alias("cal"))


def fit(docs: DataFrame) -> Model:
    """Learn a model from ``docs`` (doc_id, text, lang). What reaches the driver is bounded by BOUNDS."""
    spark = docs.sparkSession

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, own in b.groupby("lang"):
                c: Counter[str] = Counter()
                for x in own["text"]:
                    c.update(LETTERS(x.lower()))
                yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

    def one(words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("word")
        tables = learn(words["word"].tolist(), words["n"].to_numpy())
        return pd.DataFrame({"lang": words["lang"].iloc[:1], "tables": [pickle.dumps(tables)]})

    sample = written(_sample(docs.select("doc_id", "lang", "text")), "sample")
    words = sample.where("not cal").select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    learned = written(words.groupBy("lang").applyInPandas(one, "lang string, tables binary"), "models")
    size = learned.agg(F.coalesce(F.sum(F.octet_length("tables")), F.lit(0)).alias("s")).first().s
    if size > MOST_BYTES:
        raise ValueError(f"the models take {size} bytes, too many to broadcast: lower BOUNDS")
    rows = sorted(learned.collect(), key=lambda r: r.lang)
    if not rows:
        return Model([])
    m = Model([r.lang for r in rows], [pickle.loads(r.tables) for r in rows])
    shared = spark.sparkContext.broadcast(m)

    columns = [f"loss{k}" for k in range(len(HEATS))]

    def calibrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scorer(shared.value)
        place = {x: k for k, x in enumerate(s.model.langs)}
        for b in batches:
            b = b[b["lang"].isin(place)]
            e, n = s.raw(list(b["text"]))
            at = np.arange(len(b)), b["lang"].map(place).to_numpy(np.int64)
            losses = {c: -np.log(np.maximum(posterior(e, n, heat)[at], 1e-9)) for c, heat in zip(columns, HEATS, strict=True)}
            yield pd.DataFrame({"n": n, "best": e.min(axis=1, initial=np.inf), **losses})

    schema = ", ".join(["n long", "best double", *(f"{c} double" for c in columns)])
    cal = written(sample.where("cal").select("lang", "text").mapInPandas(calibrate, schema).where("n > 0"), "calibration")
    found = cal.agg(F.expr("percentile(best, 0.5D)").alias("usual"), *[F.avg(c).alias(c) for c in columns]).first()
    if found.usual is not None:
        m.usual = found.usual
        excess = (F.col("best") - F.lit(m.usual)) * F.sqrt(F.least(F.col("n"), F.lit(LONG)))
        m.limit = max(cal.agg(F.percentile(excess, F.lit(1 - REJECT)).alias("q")).first().q, 0.1) * MARGIN
        m.heat = min(HEATS, key=lambda h: found[columns[HEATS.index(h)]])
    return m


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score, cross_entropy and rejected of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        s = Scorer(m)
        for b in batches:
            own = b.drop(columns="_text")
            if not m.langs:
                yield own.assign(lang_pred="und", score=0.0, cross_entropy=None, rejected=True)
                continue
            e, n = s.raw(list(b["_text"]))
            best = e.argmin(axis=1)
            low, none = e[np.arange(len(e)), best], n == 0
            score = np.where(none, 0.0, posterior(e, n, m.heat)[np.arange(len(e)), best])
            lang = np.where(none, "und", np.array(m.langs, dtype=object)[best])
            yield own.assign(lang_pred=lang, score=score, cross_entropy=pd.Series(low, index=own.index).mask(none), rejected=none | (_excess(m, low, n) > m.limit))

    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "lang_pred string, score double, cross_entropy double, rejected boolean"])
    return docs.select(*keep, F.col("text").alias("_text")).mapInPandas(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for all ``docs``."""
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with the same columns, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        s = Scorer(m)
        for x in texts:
            if not m.langs:
                yield pd.Series(np.zeros(len(x), bool))
                continue
            e, n = s.raw(list(x))
            yield pd.Series((n > 0) & (_excess(m, e.min(axis=1), n) <= m.limit))

    return docs.where(good("text"))
