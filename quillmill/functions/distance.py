"""Edit distances that Spark has no expression for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def damerau_levenshtein(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein: inserts, deletes, substitutions, and transpositions that edits may stand between.

    Rows of the table are kept by the last place of each letter of `a`, so that a transposition costs the way back to
    the row where its letter stood and the letters skipped on either side.
    """
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    far = len(a) + len(b)
    rows = [list(range(len(b) + 1))]
    seen_in_a: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row = [i]
        last_match = 0
        above = rows[i - 1]
        for j, y in enumerate(b, 1):
            best = min(above[j], row[j - 1]) + 1
            best = min(best, above[j - 1] + (x != y))
            k = seen_in_a.get(y, 0)
            if k and last_match:
                best = min(best, rows[k - 1][last_match - 1] + (i - k - 1) + 1 + (j - last_match - 1))
            if x == y:
                last_match = j
            row.append(min(best, far))
        rows.append(row)
        seen_in_a[x] = i
    return rows[-1][-1]


@F.pandas_udf(T.IntegerType())
def _dld(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple, int | None] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = None if pair[0] is None or pair[1] is None else damerau_levenshtein(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="Int32")


def dld(a: Column | str, b: Column | str) -> Column:
    """The distance of two columns; equal pairs within a batch are computed once. Null if either is null."""
    return _dld(a, b)


def within(a: Column, b: Column, most: int) -> Column:
    """A native test that every pair of at most that distance passes: Levenshtein is at most twice the distance."""
    return F.levenshtein(a, b, 2 * most) >= 0
