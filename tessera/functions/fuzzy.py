"""Indel similarity of strings (200 * LCS / total length), batch-wise over Arrow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    if a is None or b is None:
        return 0.0
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def token_set_ratio(a: str | None, b: str | None) -> float:
    """The best ratio of shared tokens, and of shared tokens with either side's own."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    if shared and (x <= y or y <= x):
        return 100.0
    left, right = (f"{shared} {' '.join(sorted(s))}".strip() for s in (x - y, y - x))
    return max([ratio(left, right), *(ratio(shared, s) for s in (left, right) if shared)])


@F.pandas_udf(T.DoubleType())
def fuzz_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fuzz_token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    order = lambda s: " ".join(sorted((s or "").split()))
    return pd.Series([ratio(order(x), order(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fuzz_token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
