"""Spans of texts as rows, and joins of spans that overlap, natively.

An equality is needed to join by: spans are dealt to bins of a fixed width, a span to each bin that it reaches into, and
spans of one key meet bin by bin, so that neither a long text nor a hot key gathers. The edges are compared exactly, and
a pair that shares several bins counts in that where the later of the two begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a bin.
BIN = 256


def matches(texts: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """keys, start, end, match, before, after: what the pattern finds in each text, from the left, none overlapping, and
    the letters on both sides (empty at the ends, and between matches that touch); code points, end exclusive. keys are
    unique; the pattern finds nothing empty. Null texts have nothing.

    What lies between matches alternates with them, so that running lengths say where each begins.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    parted = texts.select(*keys, F.split(own, pattern, -1).alias("gaps"), F.regexp_extract_all(own, F.lit(f"({pattern})"), F.lit(1)).alias("found"))
    triples = F.arrays_zip(F.col("gaps").alias("gap"), F.col("found").alias("match"), F.slice("gaps", F.lit(2), F.size("gaps")).alias("next"))
    each = parted.select(*keys, F.posexplode(triples).alias("at", "x")).where("x.match IS NOT NULL").select(*keys, "at", F.length("x.gap").alias("gap"), F.col("x.match").alias("match"), F.expr("right(x.gap, 1)").alias("before"), F.left("x.next", F.lit(1)).alias("after"))
    upto = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = each.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto))
    return ends.select(*keys, (F.col("end") - F.length("match")).alias("start"), "end", "match", "before", "after")


def _bins(start: Column, end: Column, width: int) -> Column:
    """The bins of a span; an empty one has that of its place."""
    return F.explode(F.sequence(F.floor(start / width), F.greatest(F.floor((end - 1) / width), F.floor(start / width))))


def _both(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides in bins, and what it takes to overlap: the right side's columns are o_ and their names."""
    a = left.withColumn("__bin", _bins(F.col("start"), F.col("end"), width))
    b = right.select(*[F.col(c).alias(f"o_{c}") for c in right.columns]).withColumn("o___bin", _bins(F.col("o_start"), F.col("o_end"), width))
    on = F.col("__bin") == F.col("o___bin")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    meet = (F.col("start") < F.col("o_end")) & (F.col("end") > F.col("o_start"))
    return a, b, on & meet


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Pairs of spans (keys, start, end and more) that share a character, with the right side's columns as o_NAME. Null
    keys equal each other. An empty span meets what it stands inside of."""
    a, b, on = _both(left, right, keys, width)
    here = F.col("__bin") == F.floor(F.greatest("start", "o_start") / width)
    return a.join(b, on & here).drop("__bin", "o___bin")


def apart(left: DataFrame, right: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """The spans of left that share a character with none of right. Left's rows are told apart by keys, start and end;
    equal ones stay or go together."""
    a, b, on = _both(left, right, keys, width)
    hit = a.join(b, on, "left_semi").select(*[F.col(c).alias(f"h_{c}") for c in (*keys, "start", "end")]).distinct()
    same = (F.col("start") == F.col("h_start")) & (F.col("end") == F.col("h_end"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"h_{k}"))
    return left.join(hit, same, "left_anti")

