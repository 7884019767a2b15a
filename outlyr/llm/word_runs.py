"""Periodic runs of words (op12) by partition refinement.

Positions of a text are put into classes: two are of one class at level l if the l words from them on are equal. Level
l + 1 splits each class by the classes of the next positions, and only the small classes (all but a largest of those that a
class was split into) need be looked at, so a position is moved at most log2(n) times (the smaller-half
strategy). If the next member of a position's class at level l is l words on, a square of period l stands there, and as no
nearer member exists, its period is its smallest. Squares of one period at successive positions make a run.

A run of exponent EXPONENT = 4 or more shows three or more members in each class of the positions where its squares start,
at every level up to its period: a position q, and one 2q, words on. So classes of fewer than three members are dropped, and texts are left
at the level n / EXPONENT, or where all their positions in classes lie in runs found before. Most positions of ordinary prose are
gone after three or four levels.

The texts of a batch are refined together, each with classes of its own, by array operations; from level SCAN on, squares are
found from a table of the distances to the next member, which is updated where classes change, not by looking at all positions.
No text meets another one, so nothing is shuffled, and a lost task is simply run again.

Defined cases: a null text is an empty one; a text without words has no runs, four nulls and the digests of the empty string; a null
doc_id changes no words; repeated rows are treated each; an empty table gives an empty one. Texts of any length are taken
whole, in one task's memory (some 150 bytes a word). Extra columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Least exponent and least length of a run, in words.
EXPONENT, SHORTEST = 4, 6
#: Words of texts that are refined together (one text at least), and the level from which distances are kept in a table.
TOGETHER, SCAN = 400_000, 8
_FEWEST = EXPONENT - 1


class Refinement:
    """Classes of the positions of several texts, from level 1 on; ``codes`` has a number for each word, ``sizes`` the texts' numbers of words.

    Texts lie one after the other, each followed by a place that is in no class. Classes are numbers, -1 for none. A class's members
    lie together in ``order``, and are linked in ascending order by ``after`` and ``before``.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        total = int(sizes.sum() + len(sizes))
        self.text = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.first = np.cumsum(sizes + 1) - sizes - 1
        real = np.ones(total, bool)
        real[self.first + sizes] = False
        places = np.flatnonzero(real)
        _, inverse = np.unique(self.text[places] * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
        self.level = 1
        self.sizes = sizes
        self.cls = np.full(total, -1, np.int64)
        self.cls[places] = inverse
        self.order = places[np.argsort(inverse, kind="stable")]
        self.where = np.zeros(total, np.int64)
        self.where[self.order] = np.arange(len(self.order))
        self.size = np.bincount(inverse, minlength=1).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.n_classes = len(self.size)
        self.after, self.before = np.full(total, -1, np.int64), np.full(total, -1, np.int64)
        same = self.cls[self.order[1:]] == self.cls[self.order[:-1]]
        self.after[self.order[:-1][same]] = self.order[1:][same]
        self.before[self.order[1:][same]] = self.order[:-1][same]
        self.table: dict[int, list[np.ndarray]] | None = None
        self.small = np.arange(total)  # the positions by whose classes the next level splits; a dropped one is in no class
        self._drop(np.arange(self.n_classes))
        self.by_size = np.argsort(sizes, kind="stable")
        self.left = 0  # texts, from the shortest on, that are left for their length
        self.found: list[np.ndarray] = []  # first and last positions of all runs of exponent 2 or more

    def _members(self, classes: np.ndarray) -> np.ndarray:
        n = self.size[classes]
        return self.order[np.repeat(self.start[classes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def _drop(self, classes: np.ndarray) -> np.ndarray:
        """Drops those of ``classes`` that have too few members; returns the members."""
        gone = self._members(classes[self.size[classes] < _FEWEST])
        self.cls[gone] = -1
        return gone

    def _leave(self) -> None:
        """Leaves texts that have no room for EXPONENT periods of this level."""
        while self.left < len(self.by_size) and self.sizes[self.by_size[self.left]] < EXPONENT * self.level:
            t = self.by_size[self.left]
            self.cls[self.first[t] : self.first[t] + self.sizes[t]] = -1
            self.left += 1

    def _leave_covered(self) -> None:
        """Leaves texts whose positions in classes can be in no further run.

        The squares of a run to come start at 2 * level + 1 successive positions or more, all in classes. If these lay inside
        a run of a smaller period, both periods would hold there, and by the theorem of Fine and Wilf a common divisor.
        """
        at = np.flatnonzero(self.cls >= 0)
        if not len(at):
            return
        cut = np.concatenate(([True], at[1:] != at[:-1] + 1))
        begin, end = at[cut], at[np.concatenate((cut[1:], [True]))]
        known = np.concatenate(self.found) if self.found else np.zeros((0, 2), np.int64)
        known = known[np.argsort(known[:, 0], kind="stable")]
        reach = np.concatenate(([-1], np.maximum.accumulate(known[:, 1])))[np.searchsorted(known[:, 0], begin, side="right")]
        hopeful = self.text[begin[(end - begin >= 2 * self.level) & (reach < end)]]
        stay = np.zeros(len(self.sizes), bool)
        stay[hopeful] = True
        self.cls[at[~stay[self.text[at]]]] = -1

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First positions and lengths of the runs of this level's period, of exponent 2 or more."""
        at = self.squares()
        if not len(at):
            return at, at
        new = np.concatenate(([True], at[1:] != at[:-1] + 1))
        begin, length = at[new], np.diff(np.concatenate((np.flatnonzero(new), [len(at)]))) - 1 + 2 * self.level
        self.found.append(np.stack((begin, begin + length - 1), axis=1))
        return begin, length

    def squares(self) -> np.ndarray:
        """The positions where a square of this level's period starts, ascending."""
        if self.level < SCAN:
            at = np.flatnonzero(self.cls >= 0)
        else:
            if self.table is None:
                self.table = {}
                self._note(np.flatnonzero(self.cls >= 0))
            found = self.table.pop(self.level, None)
            if found is None:
                return np.zeros(0, np.int64)
            at = np.unique(np.concatenate(found))
            at = at[self.cls[at] >= 0]
        return at[self.after[at] - at == self.level]

    def _note(self, at: np.ndarray) -> None:
        """Enter positions at the distances to their next members."""
        at = at[self.after[at] >= 0]
        gap = self.after[at] - at
        ahead = gap >= self.level
        at, gap = at[ahead], gap[ahead]
        by = np.argsort(gap, kind="stable")
        at, gap = at[by], gap[by]
        cuts = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        for g, own in zip(gap[np.concatenate(([0], cuts))].tolist() if len(gap) else [], np.split(at, cuts), strict=False):
            self.table.setdefault(g, []).append(own)

    def refine(self) -> bool:
        """Go one level on; False if no class is left."""
        self.level += 1
        self._leave()
        if self.level >= 4 and self.level.bit_count() == 1:
            self._leave_covered()
        moved = self.small[self.small > 0] - 1
        moved = moved[self.cls[moved] >= 0]
        if not len(moved):
            return False  # the last position of a class's text leaves at every level, so none is left
        of, to = self.cls[moved], self.cls[moved + 1]
        by = np.lexsort((moved, to, of))
        moved, of, to = moved[by], of[by], to[by]
        # take them out of the lists of their classes; members that follow each other are one block
        plain = np.argsort(of * len(self.cls) + moved, kind="stable")
        m = moved[plain]
        joined = self.after[m[:-1]] == m[1:]
        head, tail = np.concatenate(([True], ~joined)), np.concatenate((~joined, [True]))
        left, right = self.before[m[head]], self.after[m[tail]]
        has = left >= 0
        self.after[left[has]] = right[has]
        touched = left[has]
        has = right >= 0
        self.before[right[has]] = left[has]
        # groups (class, class of the next position) become classes of their own; those without a next one are dropped
        new = np.concatenate(([True], (of[1:] != of[:-1]) | (to[1:] != to[:-1])))
        at = np.flatnonzero(new)
        counts = np.diff(np.concatenate((at, [len(moved)])))
        parent, dead = of[at], to[at] < 0
        change = np.concatenate(([True], parent[1:] != parent[:-1]))
        parents = parent[change]
        taken = np.add.reduceat(counts, np.flatnonzero(change))
        self._swap(moved, parents, taken)
        rest = self.size[parents] - taken
        self.size[parents] = rest
        ids = self._more(len(at))
        self.size[ids] = counts
        self.start[ids] = np.repeat(self.start[parents] + rest - (np.cumsum(taken) - taken), np.diff(np.concatenate((np.flatnonzero(change), [len(at)])))) + at
        self.cls[moved] = np.where(np.repeat(dead, counts), -1, np.repeat(ids, counts))
        same = ~new[1:]
        self.after[moved], self.before[moved] = -1, -1
        self.after[moved[:-1][same]] = moved[1:][same]
        self.before[moved[1:][same]] = moved[:-1][same]
        gone = [moved[np.repeat(dead, counts)]]
        # of the parts of a class a largest one is no small class
        children = np.concatenate((ids[~dead], parents))
        family = np.concatenate((parent[~dead], parents))
        by = np.lexsort((children, -self.size[children], family))
        largest = by[np.concatenate(([True], family[by][1:] != family[by][:-1]))]
        few = np.ones(len(children), bool)
        few[largest] = False
        gone.append(self._drop(children))
        few &= self.size[children] >= _FEWEST
        if self.table is not None:
            changed = np.concatenate((moved, touched))
            self._note(changed[self.cls[changed] >= 0])
        self.small = np.concatenate((*gone, self._members(children[few])))
        return True

    def _swap(self, moved: np.ndarray, parents: np.ndarray, taken: np.ndarray) -> None:
        """Bring ``moved``, sorted by class, to the ends of their classes' places in ``order``."""
        begin = self.start[parents] + self.size[parents] - taken
        zone = np.repeat(begin - (np.cumsum(taken) - taken), taken) + np.arange(len(moved))
        inside = self.order[zone]
        mark = np.zeros(len(self.cls), bool) if len(moved) > len(self.cls) // 8 else None
        if mark is not None:
            mark[moved] = True
            stays = inside[~mark[inside]]
        else:
            known = np.sort(moved)
            stays = inside[known[np.minimum(np.searchsorted(known, inside), len(known) - 1)] != inside]
        outside = self.where[moved] < np.repeat(begin, taken)
        free = self.where[moved[outside]]
        self.order[free] = stays
        self.where[stays] = free
        self.order[zone] = moved
        self.where[moved] = zone

    def _more(self, n: int) -> np.ndarray:
        ids = np.arange(self.n_classes, self.n_classes + n)
        self.n_classes += n
        if self.n_classes > len(self.size):
            room = np.zeros(max(self.n_classes, 2 * len(self.size)) - len(self.size), np.int64)
            self.size, self.start = np.concatenate((self.size, room)), np.concatenate((self.start, room))
        return ids


def runs(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """text, start, length, period of all runs, sorted, in several texts that lie one after the other in ``codes``."""
    r = Refinement(codes, sizes)
    out = [np.zeros((0, 4), np.int64)]
    while True:
        begin, length = r.runs()
        long = length >= max(SHORTEST, EXPONENT * r.level)
        begin, length = begin[long], length[long]
        text = r.text[begin]
        out.append(np.stack((text, begin - r.first[text], length, np.full(len(begin), r.level)), axis=1))
        if not r.refine():
            break
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, of which every tenth document, by the hash of its id, repeats a stretch up to its end."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return (words[:a] + stretch * ((n - a) // p + 1))[:n]


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct word, for all words of ``texts``, and the texts' numbers of words."""
    known = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    sizes = np.array([len(ws) for ws in texts], np.int64)
    return np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum())), sizes


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """``words`` without those that any run has after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 1] + found[:, 3], 1)
    np.add.at(edge, found[:, 1] + found[:, 2], -1)
    inside = np.cumsum(edge[:-1])
    return [w for w, k in zip(words, inside.tolist(), strict=True) if not k] if len(found) else words


def _strongest(found: np.ndarray) -> tuple[int, int, int] | None:
    """start, length, period of the run with the greatest length / period."""
    best = None
    for _, s, n, q in found.tolist():
        if best is None or n * best[2] > best[1] * q:  # sorted by start, then period, so equals come later
            best = (s, n, q)
    return best


def repetitions(docs: DataFrame, change: Callable[[list[bytes], int | None], list[bytes]] = planted) -> DataFrame:
    """doc_id, n_words, n_runs, the strongest run, and the digests of all runs and of the collapsed words.

    ``change`` gives the words of a document from its own and its doc_id.
    """

    def rows(ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
        found = runs(*_coded(texts))
        cuts = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
        out = []
        for k, ws in enumerate(texts):
            own = found[cuts[k] : cuts[k + 1]]
            best = _strongest(own) or (None, None, None)
            listed = "".join(f"{s},{n},{q}\n" for _, s, n, q in own.tolist())
            milli = None if best[0] is None else 1000 * best[1] // best[2]
            out.append((ids[k], len(ws), len(own), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(ws, own))).hexdigest()))
        df = pd.DataFrame(out, columns=["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])
        return df.astype({c: "Int64" for c in ("doc_id", "start", "length", "period", "exponent_milli")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts, n = [], [], 0
            for d, t in zip(b["doc_id"].tolist(), b["text"], strict=True):
                ws = change(_split(t), None if pd.isna(d) else int(d))
                if texts and n + len(ws) > TOGETHER:
                    yield rows(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(None if pd.isna(d) else int(d))
                texts.append(ws)
                n += len(ws)
            if texts:
                yield rows(ids, texts)

    schema = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, schema)
