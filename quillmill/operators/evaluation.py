"""Scores of corrections: pooled, grouped, and compared.

Ratios are ratios of sums, never means of ratios. Precision, recall and F0.5 are 0 where nothing is divided by; error
reduction and the word-pair ratios are null there.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edits import counts, edits
from ..functions.text import with_case_of
from .quantiles import exact_quantiles

OVERALL = "overall"


def ratio0(top: Column, below: Column) -> Column:
    return F.when(below == 0, F.lit(0.0)).otherwise(top / below)


def ratio(top: Column, below: Column) -> Column:
    return F.try_divide(top.cast("double"), below.cast("double"))


def prf(tp: Column, fp: Column, fn: Column, beta: float = 0.5) -> dict[str, Column]:
    """precision, recall and f05 of sums."""
    p, r = ratio0(tp, tp + fp), ratio0(tp, tp + fn)
    square = beta * beta
    return {"precision": p, "recall": r, "f05": ratio0((1 + square) * p * r, square * p + r)}


SUMS = ("tp", "fp", "fn", "errors_before", "errors_after", "final_errors_after")


def metric_columns(df: DataFrame) -> DataFrame:
    """df of sums (SUMS) with the scores and error reductions: the stage's in per cent, the system's as a share."""
    before = F.col("errors_before")
    return df.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"))).withColumns(
        {"error_reduction_rate": ratio(before - F.col("errors_after"), before) * 100, "final_system_error_reduction_rate": ratio(before - F.col("final_errors_after"), before)}
    )


def pooled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, sums and scores."""
    return metric_columns(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in SUMS]))


def dense_groups(rows: DataFrame, fixed: list[str], mode: str = "mode", group: str = "grp", order: str = "row_id") -> DataFrame:
    """mode, grp, position and the pooled metrics: `overall` first, then the fixed groups, also those without rows, then others as first seen.

    Every row counts once under overall; a row with a blank group counts nowhere else.
    """
    named = F.when(F.length(F.btrim(group)) > 0, F.btrim(group))
    both = rows.withColumn("__g", F.explode(F.array_compact(F.array(F.lit(OVERALL), named))))
    sums = both.groupBy(mode, "__g").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in SUMS])
    seen = rows.where(named.isNotNull()).groupBy(named.alias("__g")).agg(F.min(order).alias("at")).where(~F.col("__g").isin(*fixed) if fixed else F.lit(True))
    spark = rows.sparkSession
    set_ones = spark.createDataFrame([(g, i, 0) for i, g in enumerate([OVERALL, *fixed])], "__g string, tier long, at long")
    places = set_ones.unionByName(seen.select("__g", F.lit(len(fixed) + 1).cast("long").alias("tier"), F.col("at").cast("long").alias("at")))
    # Modes and groups are names in a report: a few each.
    frame = rows.select(mode).distinct().crossJoin(places)
    filled = frame.join(sums, [mode, "__g"], "left").na.fill(0, ["n", *SUMS])
    position = F.row_number().over(Window.partitionBy(mode).orderBy("tier", "at", "__g"))
    return metric_columns(filled.withColumn("position", position)).withColumnRenamed("__g", group).drop("tier", "at")


def by_memberships(rows: DataFrame, groups: Column, keys: list[str]) -> DataFrame:
    """keys, grp and the bundle of sums, for rows that belong to several groups each.

    Adds exact_rate, deletion-only scores and diagnostic_err, one minus residual over initial errors.
    """
    each = rows.withColumn("grp", F.explode(F.array_distinct(groups)))
    sums = each.groupBy(*keys, "grp").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "delete_tp", "delete_fp", "delete_fn", "initial", "residual")],
        F.count_if("exact").alias("exact_count"),
    )
    deletes = {f"delete_{k}": v for k, v in prf(F.col("delete_tp"), F.col("delete_fp"), F.col("delete_fn")).items()}
    return sums.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"))).withColumns(deletes).withColumns({"exact_rate": ratio(F.col("exact_count"), F.col("n")), "diagnostic_err": 1 - ratio(F.col("residual"), F.col("initial"))})


def field_groups(**fields: Column) -> Column:
    """An array of `name=value` labels, for by_memberships; null values give none."""
    return F.array_compact(F.array(*[F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in fields.items()]))


def pair_metrics(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Word-pair metrics of source, expected, prediction, by keys or as one row."""
    same, changed, right = F.col("source") == F.col("expected"), F.col("prediction") != F.col("source"), F.col("prediction") == F.col("expected")
    counts = {
        "pair_count": F.count(F.lit(1)),
        "exact": F.count_if(right),
        "needed": F.count_if(~same),
        "changed": F.count_if(changed),
        "correct_changes": F.count_if(~same & right & changed),
        "unchanged_failures": F.count_if(~same & ~changed),
        "wrong_replacements": F.count_if(~same & changed & ~right),
        "identity_rows": F.count_if(same),
        "false_positives": F.count_if(same & changed),
    }
    sums = pairs.groupBy(*(keys or [])).agg(*[c.alias(n) for n, c in counts.items()])
    out = sums.withColumns(
        {
            "exact_rate": ratio(F.col("exact"), F.col("pair_count")),
            "changed_precision": ratio(F.col("correct_changes"), F.col("changed")),
            "changed_recall": ratio(F.col("correct_changes"), F.col("needed")),
            "false_positive_rate": ratio(F.col("false_positives"), F.col("identity_rows")),
            "unchanged_failure_rate": ratio(F.col("unchanged_failures"), F.col("needed")),
            "wrong_replacement_rate": ratio(F.col("wrong_replacements"), F.col("changed")),
        }
    )
    p, r = F.col("changed_precision"), F.col("changed_recall")
    return out.withColumn("changed_f1", F.when(p.isNull() | r.isNull(), F.lit(None).cast("double")).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def valid_word_rates(words: DataFrame, training: DataFrame, examples: int = 20) -> DataFrame:
    """One row: how many valid words (line, word, prediction) were changed, without those that training (source) has; the first of these as examples."""
    known = training.select(F.lower("source").alias("k")).distinct().withColumn("in_training", F.lit(True))
    joined = words.join(known, F.lower("word") == F.col("k"), "left")
    marked = joined.withColumn("excluded", F.coalesce("in_training", F.lit(False)))
    changed = F.count_if(~F.col("excluded") & (F.col("prediction") != F.col("word")))
    sums = marked.agg(F.count_if("excluded").alias("excluded"), F.count_if(~F.col("excluded")).alias("evaluated"), changed.alias("changed"))
    # Every task keeps its first few, so that nothing but these is sorted in one place.
    first = marked.where("excluded").select("line", "word").orderBy("line", "word").limit(examples).agg(F.array_sort(F.collect_list(F.struct("line", "word"))).alias("e"))
    return sums.crossJoin(first).select("excluded", "evaluated", "changed", ratio(F.col("changed"), F.col("evaluated")).alias("false_positive_rate"), F.transform("e", lambda x: x["word"]).alias("examples"))


def summary(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """n, mean, median, p95 (between ranks), p95_rank (nearest rank) and max of a column; exact for groups of any size."""
    v, keys = F.col(value), keys or []
    sums = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    ranks = exact_quantiles(df, value, keys, between={"median": 0.5, "p95": 0.95}, nearest={"p95_rank": 0.95})
    if not keys:
        return sums.join(ranks, F.lit(True), "left").select("n", "mean", "median", "p95", "p95_rank", "max")
    named = ranks.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "median", "p95", "p95_rank")
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys))
    return sums.join(named, on, "left").select(*keys, "n", "mean", "median", "p95", "p95_rank", "max")


def histogram(df: DataFrame, value: str) -> DataFrame:
    """value, n, in the order of the value."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(value)


def overlap_flags(gold: DataFrame, training: DataFrame) -> DataFrame:
    """gold (row_number, source, expected) with pair_overlap, source_overlap, target_overlap and kept: training knows neither the source nor the pair."""
    t = training.select(F.lower("source").alias("ts"), F.lower("expected").alias("te"))

    def flag(df: DataFrame, known: DataFrame, on, name: str) -> DataFrame:
        return df.join(known.distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False))).drop(*known.columns)

    s, e = F.lower("source"), F.lower("expected")
    out = flag(gold, t, (s == F.col("ts")) & (e == F.col("te")), "pair_overlap")
    out = flag(out, t.select("ts"), s == F.col("ts"), "source_overlap")
    out = flag(out, t.select("te"), e == F.col("te"), "target_overlap")
    return out.withColumn("kept", ~(F.col("pair_overlap") | F.col("source_overlap")))


def overlap_counts(flags: DataFrame) -> DataFrame:
    """One row of counts of overlap_flags."""
    return flags.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(c) for c in ("pair_overlap", "source_overlap", "target_overlap", "kept")])


def complete(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: ids only on the left, only on the right, and twice on either side; all 0 where the sides match one to one."""
    sides = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "l"), (right, "r"))]
    both = sides[0].join(sides[1], keys, "full_outer")
    return both.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated"))


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of two sides that must match one to one; ValueError if they don't."""
    found = complete(left, right, keys).first().asDict()
    if any(found.values()):
        raise ValueError(f"the two sides differ: {found}")
    return left.join(right, keys)


def compared_modes(metrics: DataFrame, values: list[str], mode: str = "mode", group: str = "grp", off: str = "off", on: str = "on") -> DataFrame:
    """grp and, for each value, on minus off."""
    wide = metrics.groupBy(group).pivot(mode, [off, on]).agg(*[F.first(v).alias(v) for v in values])
    pick = lambda m, v: F.col(f"{m}_{v}" if len(values) > 1 else m)
    return wide.select(group, *[(pick(on, v) - pick(off, v)).alias(f"delta_{v}") for v in values])


def hash_split(pairs: DataFrame, seed: int, fraction: float) -> DataFrame:
    """pairs (row_number, source, expected) with digest and is_test: the share with the lowest digests, one row at least on either side.

    The threshold is looked up by rank; the ranking is a sort of digests alone, and no row but the threshold's moves.
    """
    if not 0 < fraction < 1:
        raise ValueError("the fraction lies between 0 and 1")
    text = F.concat_ws("\0", F.lit(str(seed)), F.col("row_number").cast("string"), "source", "expected")
    hashed = pairs.withColumn("digest", F.sha2(text.cast("binary"), 256))
    n = hashed.count()
    if n < 2:
        raise ValueError("a split needs two rows")
    k = min(n - 1, max(1, int(n * fraction + 0.5)))
    ends = hashed.select("digest", "row_number").orderBy("digest", "row_number").offset(k - 1).limit(1)
    last = ends.first()
    at = F.struct("digest", "row_number")
    return hashed.withColumn("is_test", at <= F.struct(F.lit(last["digest"]).alias("digest"), F.lit(last["row_number"]).alias("row_number")))


def scored_rows(rows: DataFrame, outputs: DataFrame) -> DataFrame:
    """rows (row_id, input, target, grp) and outputs (row_id, mode, normalized, output) as one row a mode with edit counts.

    errors_before, errors_after and final_errors_after are the edits that the input, the normalized text and the output
    are away from the target; tp, fp and fn compare the edits of the output with those of the target.
    """
    joined = rows.join(outputs, "row_id").withColumn("c", counts("input", "target", "output"))
    away = lambda text: F.size(edits(text, "target")).cast("long")
    return joined.select("row_id", "mode", "grp", "input", "target", "normalized", "output", "c.tp", "c.fp", "c.fn", F.col("c.gold").alias("errors_before"), away("normalized").alias("errors_after"), away("output").alias("final_errors_after"), (F.col("output") == F.col("target")).alias("exact"))


def evaluated(rows: DataFrame, outputs: DataFrame, fixed: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics by mode and group, predictions, and the comparison of modes on and off (empty with one mode)."""
    predictions = scored_rows(rows, outputs)
    metrics = dense_groups(predictions, fixed)
    return metrics, predictions, compared_modes(metrics, ["precision", "recall", "f05", "error_reduction_rate", "final_system_error_reduction_rate"])


PREDICTION_COLUMNS = ("row_id", "grp", "input", "target")


def prediction_columns(modes: list[str]) -> list[str]:
    """The columns of a predictions report: what each mode made, side by side."""
    return [*PREDICTION_COLUMNS, *[f"{mode}_{c}" for mode in modes for c in ("normalized", "output", "exact")]]


def prediction_report(predictions: DataFrame, modes: list[str]) -> DataFrame:
    """predictions (of scored_rows) with a row for each input and the columns of each mode."""
    wide = predictions.groupBy(*PREDICTION_COLUMNS).pivot("mode", modes).agg(*[F.first(c).alias(c) for c in ("normalized", "output", "exact")])
    return wide.select(*prediction_columns(modes))


def word_report(gold: DataFrame, training: DataFrame, answers: DataFrame, seed: int, fraction: float, diagnostics: DataFrame | None = None, valid: DataFrame | None = None) -> dict[str, DataFrame]:
    """The word-level report: overlap counts, and the metrics of validation and test, whole and by category.

    gold: row_number, source, expected, category. training: source, expected. answers: word, normalized. Pairs that
    training knows are left out before the split. With diagnostics (as of candidate_diagnostics; source, expected,
    generated, survivors, failure) also failures by split and why, and how many candidates words had; with valid words
    (line, word) how many of those that training does not teach are changed.
    """
    flags = overlap_flags(gold, training)
    split = hash_split(flags.where("kept").drop("pair_overlap", "source_overlap", "target_overlap", "kept"), seed, fraction)
    own = answers.select(F.col("word").alias("w"), "normalized")
    predicted = split.join(own, F.lower("source") == F.col("w"), "left").withColumn("prediction", with_case_of(F.col("source"), F.coalesce("normalized", "source")))
    side = predicted.withColumn("split", F.when(F.col("is_test"), "test").otherwise("validation"))
    named = side.withColumn("category", F.lower(F.btrim("category")))
    report = {"overlap": overlap_counts(flags), "metrics": pair_metrics(side, ["split"]), "categories": pair_metrics(named.where("category <> ''"), ["split", "category"])}
    if diagnostics is not None:
        facts = diagnostics.select(F.col("source").alias("d_source"), F.col("expected").alias("d_expected"), "generated", "survivors", "failure").dropDuplicates(["d_source", "d_expected"])
        met = side.select("split", "source", "expected").join(facts, (F.col("source") == F.col("d_source")) & (F.col("expected") == F.col("d_expected")), "left")
        report["failures"] = met.where("failure IS NOT NULL").groupBy("split", "failure").agg(F.count(F.lit(1)).alias("n"))
        report["candidates"] = summary(met, "generated", ["split"]).join(summary(met, "survivors", ["split"]).select("split", *[F.col(c).alias(f"survivors_{c}") for c in ("mean", "median", "p95", "max")]), "split")
    if valid is not None:
        answered = valid.join(own, F.lower("word") == F.col("w"), "left").withColumn("prediction", with_case_of(F.col("word"), F.coalesce("normalized", "word")))
        report["valid_words"] = valid_word_rates(answered.drop("w", "normalized"), training.select("source"))
    return report
