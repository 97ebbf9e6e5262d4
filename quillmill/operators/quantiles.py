"""Exact percentiles of groups of any size.

Values are counted before anything is shuffled. A group's distinct values are cut into buckets at sketched quantiles, the
buckets' counts say which of them hold the ranks asked for, and only those are sorted, each by itself: a hot group is
spread over as many tasks as it has buckets, and no task keeps a group's values. The sketch decides how even buckets are,
not what comes out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, ACCURACY = 64, 1000


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and right by keys, nulls being equal; right's keys are dropped."""
    if not keys:
        return left.crossJoin(right)  # right is one row
    named = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(named, on, how).drop(*[f"__k_{k}" for k in keys])


def exact_quantiles(df: DataFrame, value: str, keys: list[str], between: Mapping[str, float] | None = None, nearest: Mapping[str, float] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """keys and a double for each name: `between` interpolates between ranks (0.5 gives the median), `nearest` takes the
    value of the nearest rank. Null values don't count; a group without others has no row."""
    between, nearest = dict(between or {}), dict(nearest or {})
    own = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    counted = own.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    cuts = counted.groupBy(*keys).agg(F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], ACCURACY).alias("__cuts"))
    placed = _same(counted, cuts, keys).withColumn("__bucket", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")

    order = Window.partitionBy(*keys).orderBy("__bucket")
    sums = placed.groupBy(*keys, "__bucket").agg(F.sum("__n").alias("__in"))
    sums = sums.withColumn("__upto", F.sum("__in").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__all", F.sum("__in").over(Window.partitionBy(*keys)))

    def low(p: float, n: Column) -> Column:
        return (F.floor(F.lit(p) * (n - 1)) + 1).cast("long")

    def high(p: float, n: Column) -> Column:
        return (F.ceil(F.lit(p) * (n - 1)) + 1).cast("long")

    def rank(p: float, n: Column) -> Column:
        return F.greatest(F.ceil(F.lit(p) * n), F.lit(1)).cast("long")

    ranks = [f(p, F.col("__all")) for p in between.values() for f in (low, high)] + [rank(p, F.col("__all")) for p in nearest.values()]
    before = F.col("__upto") - F.col("__in")
    inside = F.filter(F.array_distinct(F.array(*ranks)), lambda r: (r > before) & (r <= F.col("__upto")))
    needed = sums.select(*keys, "__bucket", "__all", before.alias("__before"), inside.alias("__ranks")).where(F.size("__ranks") > 0)

    named = needed.withColumnRenamed("__bucket", "__b")
    at = _same(placed, named, keys).where("__bucket = __b") if not keys else placed.join(*_by_bucket(named, keys))
    walk = Window.partitionBy(*keys, "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = at.withColumn("__end", F.col("__before") + F.sum("__n").over(walk))
    hits = walked.select(*keys, "__all", "__v", F.explode(F.filter("__ranks", lambda r: (r > F.col("__end") - F.col("__n")) & (r <= F.col("__end")))).alias("__rank"))
    found = hits.groupBy(*keys).agg(F.first("__all").alias("__all"), F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))
    n, value_at = F.col("__all"), lambda r: F.element_at("__at", r)
    out = [*keys]
    for name, p in between.items():
        part = F.lit(p) * (n - 1) - F.floor(F.lit(p) * (n - 1))
        out.append((value_at(low(p, n)) + part * (value_at(high(p, n)) - value_at(low(p, n)))).alias(name))
    return found.select(*out, *[value_at(rank(p, n)).alias(name) for name, p in nearest.items()])


def _by_bucket(named: DataFrame, keys: list[str]) -> tuple[DataFrame, Column, str]:
    own = named.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__b", "__all", "__before", "__ranks")
    on = F.col("__bucket") == F.col("__b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return own, on, "inner"
