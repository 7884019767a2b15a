"""Byte-level BPE encoding and decoding by monoid tree reduction (op4).

A text is halved until its parts are leaves of LEAF characters. A leaf is split into pre-tokens by the
pattern and each is encoded by the ranks; a node's value is its pre-tokens' borders and tokens, for
the node's text alone. Two neighbours are joined by splitting and encoding a window around their
border again, which grows pre-token by pre-token until the tokens outside provably stand:

* To the left it begins at the first pre-token that ends within ``reach`` characters of the border.
  The pattern has no look-behind and no anchor, so a match depends on the text from its start on alone, and it reads
  ``reach`` characters behind its end at most. So all pre-tokens before the window are those of the joined text.
* To the right it ends where a pre-token of the window ends at a border of the right neighbour. From there on both
  go on alike, as both match from the same place on the same text.

``reach`` is known for the patterns in REACH, with the reason; any other pattern has one leaf, the whole
text, which is exact as well. A run without borders grows the window over all of it. The root's tokens are the
library's (tested, with every code point). Decoding concatenates the bytes of halves up the tree.

Defined cases: a null text is empty; an empty text has no ids; other columns are carried as they
are, and one called like an output is replaced; an empty table gives an empty table; repeated rows
are encoded each for itself. Texts of any length are taken whole, in one row's memory.
"""

from __future__ import annotations

import base64
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a leaf, ids of a leaf when decoding, and pre-tokens remembered.
LEAF, LEAF_IDS, REMEMBERED = 512, 512, 400_000
#: Rows whose ids and bytes are held at once.
SLICE = 256
#: Characters behind its end that a match can have read, by pattern. Of this one: a loop reads the one character that ends
#: it; ``\s+(?!\S)`` gives one back when a character follows its run, and so has read two; ``'re``, ``'ve`` and ``'ll`` read
#: two characters behind the quote, one more than the match of a quote alone that is taken instead.
REACH = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": 2}
#: Where the split by Python's engine can differ from the library's (it takes these as white space or not): left to the library.
_APART = re.compile("[\x1c-\x1f]").search


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> TreeBpe:
    """The codec of a rank file, built once for each Python worker."""
    return TreeBpe(path, pattern)


class TreeBpe:
    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.reach, self.leaf = regex.compile(pattern), REACH.get(pattern), leaf
        self.known: dict[str, bytes] = {}

    def _tokens(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each pre-token."""
        out = list(map(self.known.get, pieces))
        if None in out:
            if len(self.known) > REMEMBERED:
                self.known = {}
            known, ids = self.known, self.enc.encode_ordinary
            for i, x in enumerate(out):
                if x is None:
                    x = known.get(pieces[i])
                    out[i] = known[pieces[i]] = array("I", ids(pieces[i])).tobytes() if x is None else x
        return out

    def encode(self, text: str) -> np.ndarray:
        if self.reach is None or _APART(text):
            return self.enc.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        return np.frombuffer(b"".join(self._node(text, 0, len(text))[1]), "<u4")

    def _node(self, text: str, a: int, b: int) -> tuple[list[int], list[bytes]]:
        """Where the pre-tokens of ``text[a:b]`` alone end, and their tokens."""
        if b - a <= self.leaf:
            pieces = self.pattern.findall(text, a, b)
            return list(accumulate(map(len, pieces), initial=a))[1:], self._tokens(pieces)
        mid = (a + b) // 2
        return self._join(text, a, b, self._node(text, a, mid), self._node(text, mid, b))

    def _join(self, text: str, a: int, b: int, left: tuple[list[int], list[bytes]], right: tuple[list[int], list[bytes]]) -> tuple[list[int], list[bytes]]:
        mid = left[0][-1]
        keep = bisect_right(left[0], mid - self.reach)  # these have not read beyond the left part
        at = left[0][keep - 1] if keep else a
        ends, pieces, skip = [], [], 0
        while at < b:
            m = self.pattern.match(text, at, b)
            at = m.end()
            ends.append(at)
            pieces.append(m[0])
            if at > mid:
                skip = bisect_left(right[0], at, skip)
                if right[0][skip] == at:  # a border of both
                    break
            elif at == mid:
                skip = -1
                break
        return left[0][:keep] + ends + right[0][skip + 1 :], left[1][:keep] + self._tokens(pieces) + right[1][skip + 1 :]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self.enc.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def _added(df: DataFrame, **columns: T.DataType) -> T.StructType:
    """The schema of ``df`` with columns added or replaced, the new ones last."""
    return T.StructType([f for f in df.schema.fields if f.name not in columns] + [T.StructField(k, v) for k, v in columns.items()])


def _coded(df: DataFrame, path: str, pattern: str, work, drop: tuple[str, ...] = (), **columns: T.DataType) -> DataFrame:
    """``df`` with columns that ``work(codec, slice)`` gives for a few rows at once, in one Python pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                some = batch.slice(i, SLICE)
                made = work(bpe, some)
                kept = [f.name for f in some.schema if f.name not in columns and f.name not in drop]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), *(pa.array(made[c], pa.binary()) for c in columns)], names=[*kept, *columns])

    return df.mapInArrow(run, _added(df.drop(*drop), **columns))


def _ids(bpe: TreeBpe, texts: pa.Array) -> list[bytes]:
    return [bpe.encode(x.as_py() or "").astype("<u4", copy=False).tobytes() for x in texts]


def _bytes(bpe: TreeBpe, ids: list[bytes | None]) -> list[bytes]:
    return [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in ids]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of each whole text as little-endian unsigned 32-bit integers."""
    return _coded(df, path, pattern, lambda bpe, b: {out: _ids(bpe, b.column(text))}, **{out: T.BinaryType()})


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the packed ids stand for; null ids give no bytes."""
    return _coded(df, path, pattern, lambda bpe, b: {out: _bytes(bpe, b.column(ids).to_pylist())}, **{out: T.BinaryType()})


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and ids (packed) of every row; a row whose bytes do not come back is an error."""

    def work(bpe: TreeBpe, b: pa.RecordBatch) -> dict[str, list[bytes]]:
        ids = _ids(bpe, b.column("text"))
        if _bytes(bpe, ids) != [(x or "").encode() for x in b.column("text").to_pylist()]:
            raise ValueError("decoding does not give the text back")
        return {"ids": ids}

    coded = _coded(docs.select("doc_id", "source", "lang", "text"), path, pattern, work, ("text",), ids=T.BinaryType())
    return coded.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def transcoded(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``df`` with ids and decoded in place of its text: encoded, and decoded from the ids alone."""

    def work(bpe: TreeBpe, b: pa.RecordBatch) -> dict[str, list[bytes]]:
        ids = _ids(bpe, b.column("text"))
        return {"ids": ids, "decoded": _bytes(bpe, ids)}

    return _coded(df, path, pattern, work, ("text",), ids=T.BinaryType(), decoded=T.BinaryType())


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them."""
    back = transcoded(docs.select("doc_id", "text"), path, pattern)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
