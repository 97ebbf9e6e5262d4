"""The engine's functions in SQL: register(spark), then call them from spark.sql.

Scalars: dld(a, b), tokenize_spans(text), segment_sentences(text), replay_labels(text, labels, chances),
edit_set(source, target), and with rules ngram_candidates(word). Table function: collect_rules, which takes either two
strings, as in a lateral join, or a table with columns source and target:

    SELECT r.src, r.dst, r.n FROM pairs, LATERAL collect_rules(source, target, 3) r
    SELECT src, dst, sum(n) FROM collect_rules(TABLE(pairs) PARTITION BY (substr(source, 1, 1)), 3) GROUP BY src, dst
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .functions import distance, edits, labels, segmentation
from .functions.candidates import candidates_udf, pair_rules

#: Different rules of one partition that are counted before they are passed on.
COUNTED = 100_000
_TEXT = (T.StringType, T.VarcharType, T.CharType)


class CollectRules:
    """src, dst, n: the n-gram replacements of word pairs, for n-grams of 2 to `longest` letters.

    Of two strings each replacement comes as often as it is shown, n being 1. Of a table, replacements are counted within
    each partition as long as there are few different ones, so that a sum over (src, dst) has less to shuffle; the counts
    of one replacement may come in several rows. Nulls show nothing.
    """

    def __init__(self):
        self.counts: Counter = Counter()

    @staticmethod
    def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
        table = bool(args) and args[0].isTable
        if len(args) != (2 if table else 3):
            raise ValueError("collect_rules takes (source, target, longest) or (TABLE(pairs), longest)")
        longest = args[-1]
        if not isinstance(longest.dataType, T.IntegralType) or not longest.isConstantExpression or longest.value is None or longest.value < 2:
            raise ValueError("longest is a constant of 2 or more")
        if table:
            kinds = {f.name.lower(): f.dataType for f in args[0].dataType.fields}
            if not all(isinstance(kinds.get(c), _TEXT) for c in ("source", "target")):
                raise ValueError("the table needs strings named source and target")
        elif not all(isinstance(a.dataType, (*_TEXT, T.NullType)) for a in args[:2]):
            raise ValueError("source and target are strings")
        return AnalyzeResult(T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("n", T.LongType())]))

    def eval(self, *args) -> Iterator[tuple[str, str, int]]:
        if len(args) == 3:
            source, target, longest = args
        else:
            row, longest = args
            by_name = {k.lower(): v for k, v in row.asDict().items()}
            source, target = by_name["source"], by_name["target"]
        if source is None or target is None:
            return
        found = (pair for n in range(2, longest + 1) for pair in pair_rules(source, target, n))
        if len(args) == 3:
            for src, dst in found:
                yield src, dst, 1
            return
        self.counts.update(found)
        if len(self.counts) >= COUNTED:
            yield from self.terminate()

    def terminate(self) -> Iterator[tuple[str, str, int]]:
        for (src, dst), n in self.counts.items():
            yield src, dst, n
        self.counts.clear()


def register(spark: SparkSession, rules: Mapping[str, Mapping[str, float]] | None = None, longest: int = 2, cutoff: int = 100) -> list[str]:
    """Makes the functions known to the session and gives their names; ngram_candidates is there where rules are given."""
    scalars = {
        "dld": distance._dld,
        "tokenize_spans": segmentation._token_spans,
        "segment_sentences": segmentation._segments,
        "replay_labels": labels._replay,
        "edit_set": edits._edits,
    }
    if rules is not None:
        scalars["ngram_candidates"] = candidates_udf(rules, longest, cutoff)
    for name, function in scalars.items():
        spark.udf.register(name, function)
    spark.udtf.register("collect_rules", F.udtf(CollectRules))
    return [*scalars, "collect_rules"]
