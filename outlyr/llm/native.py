"""Column expressions shared by the native operators: bindings, words and their hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(hashes: Column, k: int) -> Column:
    """A 64-bit hash of each run of ``k`` consecutive elements; fewer elements give none."""
    n = F.size(hashes)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.expr("CAST(array() AS array<int>)"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def without(text: Column, characters: str) -> Column:
    """Code points of ``text`` that are none of ``characters``."""
    return F.length(F.translate(text, characters, ""))
