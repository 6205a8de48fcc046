"""The few scalar functions that built-in ones express too slowly, as vectorised functions over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, with one big integer for a row of the table of lengths."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def lcs_similarity(a: str | None, b: str | None) -> float | None:
    """2 LCS / (|a| + |b|), 1 for two empty strings, null if either is null."""
    if a is None or b is None:
        return None
    return 2.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def lcs_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_similarity(p, q) for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)
