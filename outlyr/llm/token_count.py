"""Token counts by the whole-token shortcut (op5).

Offline, from the model file alone, it is proved that (1) no piece has the white-space mark after
another character, so no token spans the border of a word and the mark that follows it; (2) which
of the line controls no longer piece holds, so that they stand alone; (3) which vocabulary strings
encode alone as one token: each is encoded. A text then falls into pre-tokens that are encoded
independently: those proved under (3) count one, and only the rest is merged, once for each
distinct one. A model for which (1) fails, or which normalises texts, is used as it is.

Defined cases: a null or empty text has 0 tokens and 0 bytes; special strings in texts are text;
repeated rows are counted each; an empty table gives an empty one. Texts of any length are counted whole, in one row's
memory. Extra columns take no part, whatever their names; ``keep`` names those that are returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters handled at once, distinct pre-tokens remembered, and the longest one remembered.
CHUNK, REMEMBERED, LONGEST = 1_000_000, 400_000, 64
MARK = "▁"


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        norm = model.normalizer_spec
        pieces = [p.piece for p in model.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL]
        held = set("".join(p for p in pieces if len(p) > 1))
        own = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces)
        self.lone = "".join(c for c in "\n\t\r" if c not in held)
        self.split = (
            model.trainer_spec.model_type == pb.TrainerSpec.BPE
            and norm.name == "identity" and not norm.precompiled_charsmap
            and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
            and "\n" in self.lone and not own
            and not any(MARK in p.lstrip(MARK) for p in pieces)
        )
        self.unit = re.compile(f" *[^ {self.lone}]+| +|[{self.lone}]").findall if self.split else None
        self.lead = len(self.sp.encode("\n"))
        self.proved: dict[str, int] = {}
        if self.split:
            strings = [p.replace(MARK, " ") for p in pieces] + list(self.lone)
            self.proved = {s: 1 for s, n in zip(strings, self._merge(strings), strict=True) if n == 1}
        self.known = dict(self.proved)

    def _merge(self, units: list[str]) -> list[int]:
        """Tokens of each pre-token: behind a lone line feed, where no mark is put before it."""
        return [len(x) - self.lead for x in self.sp.encode(["\n" + u for u in units], num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.split:
            return [len(self.sp.encode(x)) for x in texts]
        out: list[int] = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            out += self._some(texts[start:end])
            start = end
        return out

    def _some(self, texts: list[str]) -> list[int]:
        units = [self.unit(" " + x.replace(MARK, " ")) if x else [] for x in texts]
        if len(self.known) > REMEMBERED + len(self.proved):
            self.known = dict(self.proved)
        new = list(set().union(*units).difference(self.known))
        counts = self._merge(new)
        long = {u: n for u, n in zip(new, counts, strict=True) if len(u) > LONGEST}
        self.known.update((u, n) for u, n in zip(new, counts, strict=True) if len(u) <= LONGEST)
        if long:
            look = {**self.known, **long} if len(long) > 1000 else None
            get = look.__getitem__ if look else lambda u: long[u] if len(u) > LONGEST else self.known[u]
        else:
            get = self.known.__getitem__
        return [sum(map(get, x)) for x in units]


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes and n_tokens of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for b in batches:
            n = c.count([x or "" for x in b["_text"]])
            yield b.drop(columns="_text").assign(n_tokens=pd.array(n, dtype="int64"))

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), "n_bytes long, n_tokens long"])
    chosen = df.select(*keep, F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), F.col(text).alias("_text"))
    return chosen.mapInPandas(run, schema)


def limits(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Counts with over_limit: more than ``limit`` tokens."""
    return count_tokens(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
