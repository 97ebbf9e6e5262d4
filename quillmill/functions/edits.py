"""Token edits between two texts, as a multiset, and what they score."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import derive, replayed_tokens
from .segmentation import TOKEN

EDIT = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("op", T.StringType()), T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])
COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("tp", "fp", "fn", "gold", "predicted")])


def token_edits(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, str, str | None, str | None]]:
    """(place in a, op, token of a, token of b): a shortest list of substitutions, deletions and insertions.

    What both begin and end with is left out first, so that either copy of a doubled word counts as the same deletion.
    Among shortest lists a match is preferred to a substitution, that to a deletion, and that to an insertion, from the end.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    right, down = _rises(x, y)
    out = []
    i, j = len(x), len(y)
    while i and j:
        # By how much the table falls from here to the column on the left, and from there to the row above.
        across = _rise(right[i], j)
        crosswise = across + (_rise(down[i], j - 1) if j > 1 else 1)
        if x[i - 1] == y[j - 1] and crosswise == 0:
            i, j = i - 1, j - 1
        elif crosswise == 1:
            i, j = i - 1, j - 1
            out.append((head + i, "substitute", x[i], y[j]))
        elif _rise(down[i], j) == 1:
            i -= 1
            out.append((head + i, "delete", x[i], None))
        else:
            j -= 1
            out.append((head + i, "insert", None, y[j]))
    out += [(head + k, "delete", x[k], None) for k in range(i - 1, -1, -1)]
    out += [(head, "insert", None, y[k]) for k in range(j - 1, -1, -1)]
    return out[::-1]


Rises = list[tuple[int, int]]


def _rise(bits: tuple[int, int], j: int) -> int:
    """1, 0 or -1: what a column has more."""
    return (bits[0] >> (j - 1) & 1) - (bits[1] >> (j - 1) & 1)


def _rises(x: Sequence[str], y: Sequence[str]) -> tuple[Rises, Rises]:
    """For each row of the distance table of x and y, in bits by column: where it has one more, and one less, than the
    column on the left, and than the row above.

    Neighbours in the table differ by one at most, so that a whole row is a few operations on long integers.
    """
    full = (1 << len(y)) - 1
    places: dict[str, int] = {}
    for j, t in enumerate(y):
        places[t] = places.get(t, 0) | 1 << j
    plus, minus = full, 0
    right, down = [(plus, minus)], [(0, 0)]
    for s in x:
        same = places.get(s, 0)
        free = same | minus
        still = (((same & plus) + plus) ^ plus) | same | minus
        more, less = minus | (full & ~(still | plus)), plus & still
        down.append((more, less))
        more, less = (more << 1 | 1) & full, (less << 1) & full
        plus, minus = less | (full & ~(free | more)), more & free
        right.append((plus, minus))
    return right, down


def text_edits(a: str | None, b: str | None) -> list[tuple[int, str, str | None, str | None]]:
    return token_edits(TOKEN.findall(a or ""), TOKEN.findall(b or ""))


def edit_counts(source: str | None, target: str | None, predicted: str | None) -> tuple[int, int, int, int, int]:
    """True and false positives, false negatives, gold and predicted edits; edits are compared as multisets."""
    gold, got = Counter(text_edits(source, target)), Counter(text_edits(source, predicted))
    tp = sum((gold & got).values())
    return tp, sum(got.values()) - tp, sum(gold.values()) - tp, sum(gold.values()), sum(got.values())


def labels_between(source: str, target: str) -> list[str] | None:
    """Labels of the source's tokens whose replay gives the target's tokens; None where there are none.

    What is inserted goes with the token before it, or with the first one if that one is replaced; before a first token
    that stays nothing can be inserted.
    """
    a, b = TOKEN.findall(source), TOKEN.findall(target)
    made: list[list[str]] = [[t] for t in a]
    lead: list[str] = []
    for at, op, _, new in token_edits(a, b):
        if op == "insert":
            (made[at - 1] if at else lead).append(new)
        else:
            made[at] = made[at][1:] if op == "delete" else [new, *made[at][1:]]
    if lead:
        if not a or made[0][:1] in ([], [a[0]]):
            return None
        made[0] = lead + made[0]
    try:
        labels = [derive(t, words) for t, words in zip(a, made, strict=True)]
        return labels if list(replayed_tokens(a, labels)) == b else None
    except ValueError:
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _labels(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([labels_between(a or "", b or "") for a, b in zip(source, target, strict=True)], dtype=object)


def aligned_labels(source: Column | str, target: Column | str) -> Column:
    """array of labels, checked by replay; null where no labels make the target."""
    return _labels(source, target)


@F.pandas_udf(T.ArrayType(EDIT))
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(EDIT.names, e, strict=True)) for e in text_edits(x, y)] for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(COUNTS)
def _counts(source: pd.Series, target: pd.Series, predicted: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_counts(*row) for row in zip(source, target, predicted, strict=True)], columns=COUNTS.names)


def edits(a: Column | str, b: Column | str) -> Column:
    """array of at, op, src, dst."""
    return _edits(a, b)


def counts(source: Column | str, target: Column | str, predicted: Column | str) -> Column:
    """struct of tp, fp, fn, gold, predicted."""
    return _counts(source, target, predicted)


def multiset_counts(gold: Column, got: Column) -> tuple[Column, Column, Column]:
    """tp, fp, fn from how often an edit is in either multiset, natively."""
    return F.least(gold, got), F.greatest(got - gold, F.lit(0)), F.greatest(gold - got, F.lit(0))
