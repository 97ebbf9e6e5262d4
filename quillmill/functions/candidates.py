"""Character n-gram rules: what a word pair teaches, and the candidates that rules make of a word."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rules = Mapping[str, Mapping[str, float]]
RULE = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])
CANDIDATE = T.StructType([T.StructField("candidate", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("ord", T.IntegerType())])


def pair_rules(source: str, target: str, n: int) -> list[tuple[str, str]]:
    """The replacements of n-grams that a pair shows: equal n-grams are passed in both words, after a different one the
    source moves by one letter and the target by n."""
    out = []
    i = j = 0
    while i < len(source) and j < len(target):
        left, right = source[i : i + n], target[j : j + n]
        out.append((left, right))
        i += n if left == right else 1
        j += n
    return out


def candidates(word: str, rules: Rules, longest: int, cutoff: int) -> dict[str, float]:
    """The candidates of a word and their weights, in the order in which they first came up.

    Built from the end of the word: what the rules make of each suffix follows from shorter suffixes. An n-gram with
    rules gives way to each replacement, after which one letter is used up, or all n if it stays as it is, and the rest
    may also be dropped; an n-gram without rules keeps its first letter. A candidate that comes up again keeps its place
    and takes the later weight. Each suffix keeps those that weigh no less than the cutoff-th.
    """
    size = len(word)
    of: list[dict[str, float]] = [{} for _ in range(size + 1)]
    of[size] = {"": 1.0}
    for at in range(size - 1, -1, -1):
        rest = word[at:]
        if at == size - 1:
            of[at] = dict(rules[rest]) if rest in rules else {rest: 1.0, "": 1.0}
            continue
        found: dict[str, float] = {}
        for n in range(2, min(longest, len(rest)) + 1):
            gram = rest[:n]
            if gram not in rules:
                found.update((rest[0] + tail, weight) for tail, weight in of[at + 1].items())
                continue
            for new, chance in rules[gram].items():
                tails = of[at + (n if new == gram else 1)] | {"": 1.0}
                found.update((new + tail, chance * weight) for tail, weight in tails.items())
        found = found or {rest: 1.0}
        if len(found) > cutoff:
            least = sorted(found.values(), reverse=True)[cutoff - 1]
            found = {c: w for c, w in found.items() if w >= least}
        of[at] = found
    return of[0]


def candidates_udf(rules: Rules, longest: int, cutoff: int):
    """A UDF from a word to its candidates; rules are few thousand at most and travel with it."""
    frozen = {src: dict(dst) for src, dst in rules.items()}

    @F.pandas_udf(T.ArrayType(CANDIDATE))
    def run(words: pd.Series) -> pd.Series:
        return pd.Series([[{"candidate": c, "weight": float(x), "ord": i} for i, (c, x) in enumerate(candidates(w, frozen, longest, cutoff).items())] if w is not None else None for w in words], dtype=object)

    return run


def pair_rules_udf(sizes: Iterable[int]):
    """A UDF from source and target to their replacements for these n."""
    sizes = tuple(sizes)

    @F.pandas_udf(T.ArrayType(RULE))
    def run(source: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([[{"src": a, "dst": b} for n in sizes for a, b in pair_rules(s, t, n)] for s, t in zip(source, target, strict=True)], dtype=object)

    return run


def eligible(word: Column) -> Column:
    """Words that automatic normalization looks at: 2 to 128 characters; the vocabulary is an anti-join's business."""
    return F.length(F.lower(word)).between(2, 128)
