"""Sampling, paired comparisons and gates of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import segmentation as sg
from ..functions import text as tx
from ..functions.edits import aligned_labels, counts, edits
from .evaluation import by_memberships, complete, field_groups, ratio

# Fixed values of the acceptance gate: what it looks at, and the bounds to proceed and to stop.
#: (rule, suite, group, metric, kind, bound, least n). Kinds: gain (difference at least), value (the candidate's value at
#: least), increase (difference at most), rate (difference of metric over n at most). Group family:* is every shared family.
PROCEED = (
    ("duplicate recall", "stress", "duplicate_corruptions", "recall", "gain", 0.05, 0),
    ("duplicate precision", "stress", "duplicate_corruptions", "precision", "value", 0.95, 0),
    ("duplicate F0.5", "stress", "duplicate_corruptions", "f0_5", "gain", -0.01, 0),
    ("duplicate exact", "stress", "duplicate_corruptions", "exact_rate", "gain", -0.01, 0),
    ("unseen recall", "stress", "duplicate_token_coverage=unseen", "recall", "gain", 0.05, 0),
    ("content recall", "stress", "target_class=content", "recall", "gain", 0.05, 0),
    ("function recall", "stress", "target_class=function", "recall", "gain", -0.01, 0),
    ("official F0.5", "official", "official_stage3_dev", "f0_5", "gain", -0.005, 0),
    ("official ERR", "official", "official_stage3_dev", "err", "gain", -0.005, 0),
    ("historical recall", "official", "historical_duplicate_dev", "recall", "gain", -0.01, 0),
    ("identity false positives", "stress", "identity_controls", "fp", "increase", 2, 0),
    ("identity false deletions", "stress", "identity_controls", "delete_fp", "increase", 2, 0),
    ("official identity rate", "official", "identity_controls", "fp", "rate", 0.001, 0),
    ("natural repetition rate", "official", "natural_repetition_identity", "fp", "rate", 0.005, 0),
    ("families", "official", "family:*", "f0_5", "gain", -0.01, 30),
)
VETO = (
    ("duplicate F0.5", "stress", "duplicate_corruptions", "f0_5", "gain", -0.05, 0),
    ("official F0.5", "official", "official_stage3_dev", "f0_5", "gain", -0.02, 0),
    ("official ERR", "official", "official_stage3_dev", "err", "gain", -0.02, 0),
    ("identity false positives", "stress", "identity_controls", "fp", "increase", 3, 0),
    ("identity false deletions", "stress", "identity_controls", "delete_fp", "increase", 3, 0),
    ("official identity rate", "official", "identity_controls", "fp", "rate", 0.01, 0),
    ("natural repetition rate", "official", "natural_repetition_identity", "fp", "rate", 0.05, 0),
    ("families", "official", "family:*", "f0_5", "gain", -0.05, 50),
)
PASSES = (1, 5)
STOP, GO, AGAIN = "DO NOT PROCEED", "PROCEED TO CANONICAL RETRAINING", "RUN ANOTHER BOUNDED EXPERIMENT"
#: Stratum -> how many short and long cases.
QUOTAS = {
    "interior_function": {"short": 10, "long": 10},
    "interior_content": {"short": 10, "long": 10},
    "initial_function": {"short": 7, "long": 8},
    "initial_content": {"short": 7, "long": 8},
    "punctuation_function": {"short": 8, "long": 7},
    "final_content": {"short": 8, "long": 7},
}
CONTEXT_MARKS, TERMINAL_MARKS = ",;:—–", ".!?…"


# Gate


def compared(metrics: DataFrame) -> DataFrame:
    """suite, pass, grp with the metrics of both models, base_* and cand_*. metrics: model (baseline, candidate), suite, pass, grp, values."""
    keys = ["suite", "pass", "grp"]
    values = [c for c in metrics.columns if c not in (*keys, "model")]
    side = lambda model, prefix: metrics.where(F.col("model") == model).select(*keys, *[F.col(v).alias(prefix + v) for v in values])
    return side("baseline", "base_").join(side("candidate", "cand_"), keys, "full_outer")


def shared_groups(metrics: DataFrame, passes: tuple[int, ...] = PASSES) -> DataFrame:
    """suite, grp that both models have in all passes."""
    return metrics.where(F.col("pass").isin(*passes)).select("suite", "grp", "model", "pass").distinct().groupBy("suite", "grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2 * len(passes)).select("suite", "grp")


def gate_rules(metrics: DataFrame) -> DataFrame:
    """tier (proceed, veto), rule, pass, grp, difference, holds: each threshold on each pair of measurements that it is for."""
    spark = metrics.sparkSession
    schema = "tier string, rule string, r_suite string, r_group string, metric string, kind string, bound double, least_n long"
    rules = spark.createDataFrame([(tier, *r[:5], float(r[5]), r[6]) for tier, rs in (("proceed", PROCEED), ("veto", VETO)) for r in rs], schema)
    pairs = compared(metrics).where(F.col("pass").isin(*PASSES)).join(shared_groups(metrics), ["suite", "grp"])
    family = (F.col("r_group") == "family:*") & F.col("grp").startswith("family:")
    met = pairs.join(F.broadcast(rules), (F.col("suite") == F.col("r_suite")) & ((F.col("grp") == F.col("r_group")) | family) & (F.coalesce("base_n", F.lit(0)) >= F.col("least_n")))
    names = sorted({r[3] for r in PROCEED + VETO})
    value = lambda prefix: F.coalesce(*[F.when(F.col("metric") == m, F.col(prefix + m).cast("double")) for m in names])
    base, cand = value("base_"), value("cand_")
    share = lambda v, prefix: v / F.greatest(F.col(prefix + "n"), F.lit(1))
    difference = F.when(F.col("kind") == "value", cand).when(F.col("kind") == "rate", share(cand, "cand_") - share(base, "base_")).otherwise(cand - base)
    holds = F.when(F.col("kind").isin("gain", "value"), F.col("difference") >= F.col("bound")).otherwise(F.col("difference") <= F.col("bound"))
    return met.withColumn("difference", difference).withColumn("holds", holds).select("tier", "rule", "pass", "grp", "difference", "bound", "holds")


def gate_decision(metrics: DataFrame) -> DataFrame:
    """One row, verdict: stop if any veto fails, go on if every condition holds, else another experiment. What was not measured does not hold."""
    rules = gate_rules(metrics)
    found = rules.agg(F.coalesce(F.bool_or((F.col("tier") == "veto") & ~F.coalesce("holds", F.lit(False))), F.lit(False)).alias("severe"), F.coalesce(F.bool_and(F.when(F.col("tier") == "proceed", F.coalesce("holds", F.lit(False)))), F.lit(False)).alias("all"))
    needed = len({r[0] for r in PROCEED if r[2] != "family:*"}) * len(PASSES)
    present = rules.where("tier = 'proceed' AND NOT startswith(grp, 'family:')").agg(F.count_distinct("rule", "pass").alias("present"))
    return found.crossJoin(present).select(F.when(F.col("severe"), STOP).when(F.col("all") & (F.col("present") == needed), GO).otherwise(AGAIN).alias("verdict"))


def paired_outcomes(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """pass, n, changed, exact_gains, exact_losses, tp_gains, tp_losses. Both sides: case_id, pass, output, exact, tp; they must have the same cases."""
    b = baseline.select("case_id", "pass", *[F.col(c).alias(f"b_{c}") for c in ("output", "exact", "tp")])
    joined = b.join(candidate.select("case_id", "pass", "output", "exact", "tp"), ["case_id", "pass"])
    return joined.groupBy("pass").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("output") != F.col("b_output")).alias("changed"),
        F.count_if(F.col("exact") & ~F.col("b_exact")).alias("exact_gains"),
        F.count_if(~F.col("exact") & F.col("b_exact")).alias("exact_losses"),
        F.sum(F.greatest(F.col("tp") - F.col("b_tp"), F.lit(0))).alias("tp_gains"),
        F.sum(F.greatest(F.col("b_tp") - F.col("tp"), F.lit(0))).alias("tp_losses"),
    )


def probability_facts(probes: DataFrame, keys: list[str]) -> DataFrame:
    """Mean probability and margins of probes (probability, margin, rank), and how often each rank below 4 occurs."""
    return probes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"), F.min("margin").alias("least_margin"), F.avg("margin").alias("mean_margin"), F.max("margin").alias("most_margin"), *[F.count_if(F.col("rank") == k).alias(f"rank_{k}") for k in (1, 2, 3)])


def drifted_cases(passes: DataFrame) -> DataFrame:
    """pass, case_id, added: cases to whose first slots a fresh segmentation would add sentences. passes: case_id, pass, initial_slots, fresh_slots."""
    return passes.select("pass", "case_id", (F.col("fresh_slots") - F.col("initial_slots")).alias("added")).where(F.col("added") > 0)


def segmentation_drift(passes: DataFrame) -> DataFrame:
    """pass, added, cases: how many sentences a fresh segmentation would add, and in how many cases (see drifted_cases)."""
    more = F.greatest(F.lit(0), F.col("fresh_slots") - F.col("initial_slots"))
    return passes.groupBy("pass").agg(F.sum(more).alias("added"), F.count_if(more > 0).alias("cases"))


# Samples


def rank_of(seed: int, stratum: Column, key: Column) -> Column:
    """A rank that seed, stratum and key decide alone."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), stratum, key).cast("binary"), 256)


def quota_sample(pool: DataFrame, quotas: dict[str, dict[str, int]], seed: int, require_full: bool = True) -> DataFrame:
    """pool (key, clean_id, stratum, bucket and more) with selection_rank: each stratum's quota by rank, no clean_id twice.

    Strata are served in their order, and what one took the next ones don't see; that order is the semantics, so the loop
    runs over the strata, of which there are few. The sample itself is quota-sized.
    """
    ranked = pool.withColumn("selection_rank", rank_of(seed, F.concat_ws(":", "stratum", "bucket"), F.col("key").cast("string")))
    taken: list[DataFrame] = []
    used: list = []
    for stratum, of_bucket in quotas.items():
        for bucket, quota in of_bucket.items():
            own = ranked.where((F.col("stratum") == stratum) & (F.col("bucket") == bucket))
            if used:
                own = own.where(~F.col("clean_id").isin(*used))
            best = own.groupBy("clean_id").agg(F.min_by(F.struct(*ranked.columns), F.struct("selection_rank", "key")).alias("x")).select("x.*").orderBy("selection_rank", "key").limit(quota)
            rows = best.collect()
            if require_full and len(rows) < quota:
                raise ValueError(f"{stratum}/{bucket}: {quota} wanted, {len(rows)} there")
            used += [r["clean_id"] for r in rows]
            taken.append(pool.sparkSession.createDataFrame(rows, best.schema))
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


def prepared_cases(rows: DataFrame, seed: int, quotas: dict[str, dict[str, int]] | None = None, control_quota: int = 10, require_full: bool = True) -> DataFrame:
    """The stress set of clean rows (key, clean_id, text): doubled tokens by quota and controls, each with an id from its content.

    A doubled token counts only if labels can undo it. case_id is the first 20 digits of a digest.
    """
    pool = corruption_candidates(rows)
    pool = pool.withColumn("labels", aligned_labels("source_text", "target_text")).where("labels IS NOT NULL")
    chosen = quota_sample(pool, quotas or QUOTAS, seed, require_full)
    cases = chosen.select(F.lit("duplicate").alias("case_type"), "stratum", F.col("bucket").alias("length_bucket"), "clean_id", "source_text", "target_text", F.col("token").alias("duplicate_token"))
    plain = controls(rows, chosen, control_quota, seed)
    none = F.lit(None).cast("string")
    cases = cases.unionByName(plain.select(F.col("kind").alias("case_type"), none.alias("stratum"), none.alias("length_bucket"), "clean_id", F.col("text").alias("source_text"), F.col("text").alias("target_text"), none.alias("duplicate_token")))
    return cases.withColumn("case_id", F.substr(F.sha2(F.concat_ws("\0", "case_type", "source_text", "target_text").cast("binary"), 256), F.lit(1), F.lit(20)))


def audit(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """One row: cases that only the record has, and that only the recomputation has; both 0 where they agree."""
    columns = recorded.columns
    again = recomputed.select(*columns)
    return recorded.exceptAll(again).agg(F.count(F.lit(1)).alias("only_recorded")).crossJoin(again.exceptAll(recorded).agg(F.count(F.lit(1)).alias("only_recomputed")))


def stress_summary(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """pass, grp and the bundle of sums: predictions (case_id, pass, output) of cases, scored by edits and grouped by what the case is.

    Groups: duplicate_corruptions or identity_controls, and field=value for stratum, bucket, target class and coverage.
    """
    joined = matched_cases(cases, predictions).withColumn("g", edits("source_text", "target_text")).withColumn("p", edits("source_text", "output")).withColumn("c", counts("source_text", "target_text", "output"))
    deletes = lambda c: F.size(F.filter(c, lambda e: e["op"] == "delete"))
    hit = F.size(F.array_intersect(F.filter("g", lambda e: e["op"] == "delete"), F.filter("p", lambda e: e["op"] == "delete")))
    kind = F.when(F.col("case_type") == "duplicate", "duplicate_corruptions").otherwise("identity_controls")
    target = F.when(F.col("duplicate_token").isNotNull(), F.when(tx.is_function_word("duplicate_token"), "function").otherwise("content"))
    labels = F.concat(F.array(kind), field_groups(stratum=F.col("stratum"), length_bucket=F.col("length_bucket"), target_class=target, **({"duplicate_token_coverage": F.col("duplicate_token_coverage")} if "duplicate_token_coverage" in cases.columns else {})))
    scored = joined.select("pass", labels.alias("groups"), "c.tp", "c.fp", "c.fn", hit.alias("delete_tp"), (deletes("p") - hit).alias("delete_fp"), (deletes("g") - hit).alias("delete_fn"), F.size("g").alias("initial"), F.size(edits("output", "target_text")).alias("residual"), (F.col("output") == F.col("target_text")).alias("exact"))
    return by_memberships(scored, F.col("groups"), ["pass"])


def matched_cases(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """cases with their predictions; ValueError unless every case has every pass once and nothing else is predicted."""
    passes = predictions.select("pass").distinct()
    grid = cases.select("case_id").crossJoin(passes)  # cases times a handful of passes
    found = complete(grid, predictions, ["case_id", "pass"]).first().asDict()
    if any(found.values()):
        raise ValueError(f"cases and predictions differ: {found}")
    return cases.join(predictions, "case_id")


def controls(rows: DataFrame, used: DataFrame, quota: int, seed: int) -> DataFrame:
    """Clean rows (key, clean_id, text) as controls: of those with and of those without a doubled word the quota by rank, none that `used` has."""
    free = rows.join(used.select("clean_id").distinct(), "clean_id", "left_anti")
    words = F.filter(tx.tokens("text"), lambda t: tx.is_lexical(t))
    kind = F.when(tx.has_adjacent_repeat(words), "identity_repeat").otherwise("identity_plain")
    ranked = free.withColumn("kind", kind).withColumn("rank", rank_of(seed, F.col("kind"), F.col("key").cast("string")))
    return ranked.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("rank", "key"))).where(F.col("r") <= quota).drop("r")


def corruption_places(rows: DataFrame) -> DataFrame:
    """The tokens of clean rows (key, clean_id, text) of a length bucket that can be said twice: key, clean_id, stratum, bucket, token, token_index, start, end, text.

    The stratum is the token's place (initial, final, interior, or beside a mark) and whether it is a function word;
    combinations without a quota fall out. What a row's tokens share is told before they become rows, and a token's row
    has its neighbours alone.
    """
    spans = rows.select("key", "clean_id", "text", sg.token_spans_of("text").alias("spans"))
    letters = F.transform("spans", lambda s: tx.is_lexical(s["text"]))
    near = F.transform("spans", lambda s, i: F.struct(i.alias("i"), s.alias("span"), F.get("spans", i - 1)["text"].alias("before"), F.get("spans", i + 1)["text"].alias("after")))
    base = spans.select("key", "clean_id", "text", "spans", letters.alias("letters"), tx.length_bucket(F.size(F.filter(letters, lambda x: x))).alias("bucket")).where("bucket IS NOT NULL")
    ends = base.select("key", "clean_id", "text", "bucket", (F.array_position("letters", True) - 1).alias("first"), (F.size("letters") - F.array_position(F.reverse("letters"), True)).alias("last"), near.alias("near"))
    each = ends.select("key", "clean_id", "text", "bucket", "first", "last", F.explode("near").alias("t")).select("*", F.col("t.i").alias("token_index"), F.col("t.span.text").alias("token"))
    marks = list(CONTEXT_MARKS)
    beside = F.coalesce(F.col("t.before").isin(*marks), F.lit(False)) | F.coalesce(F.col("t.after").isin(*marks), F.lit(False))
    place = F.when(F.col("token_index") == F.col("first"), "initial").when(F.col("token_index") == F.col("last"), "final").when(beside, "punctuation").otherwise("interior")
    kind = F.when(tx.is_function_word("token"), "function").otherwise("content")
    each = each.where(tx.is_lexical("token")).withColumn("stratum", F.concat_ws("_", place, kind)).where(F.col("stratum").isin(*QUOTAS))
    return each.select(F.concat_ws(":", F.col("key").cast("string"), F.col("token_index").cast("string")).alias("key"), "clean_id", "stratum", "bucket", "token", "token_index", F.col("t.span.start").alias("start"), F.col("t.span.end").alias("end"), "text")


def corruption_candidates(rows: DataFrame) -> DataFrame:
    """Every way to say one token twice in clean rows, as of corruption_places: key, clean_id, stratum, bucket, token, token_index, source_text, target_text."""
    source = tx.with_duplicate(F.col("text"), F.col("start"), F.col("end"))
    return corruption_places(rows).select("key", "clean_id", "stratum", "bucket", "token", "token_index", source.alias("source_text"), F.col("text").alias("target_text"))


def cyclic(items: DataFrame, n: int, order: str) -> DataFrame:
    """n rows: position from 0, and the items (in order) over and over."""
    # The list of a benchmark's inputs; numbering it is a sort of that list.
    numbered = items.withColumn("__i", F.row_number().over(Window.orderBy(order)) - 1)
    count = items.count()
    slots = items.sparkSession.range(n).select(F.col("id").alias("position"), F.pmod(F.col("id"), F.lit(max(1, count))).alias("__i"))
    return slots.join(numbered, "__i").drop("__i")


# Provenance


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row, sha256: a digest of the rows with their number of copies, which no order of the input changes.

    Row digests are counted, the distinct ones with one beginning (four hexadecimal digits) are put in order and digested
    together, and so are the digests of all beginnings: 65,536 at most, so that no task and no row gathers the table.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    sha = lambda x: F.sha2(F.array_join(F.array_sort(F.collect_list(x)), "").cast("binary"), 256)
    counted = rows.select(row.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    parts = counted.groupBy(F.substring("d", 1, 4).alias("p")).agg(sha(F.concat_ws(":", "d", F.col("n").cast("string"))).alias("d"))
    return parts.agg(sha(F.concat("p", "d")).alias("sha256"))


def provenance(rows: DataFrame, names: list[str]) -> Column:
    """A struct of the named columns; null for those that rows lacks."""
    return F.struct(*[(F.col(n) if n in rows.columns else F.lit(None).cast("string")).alias(n) for n in names])


def duplicated_word(operation: Column, duplicated: Column, spans: Column) -> Column:
    """The doubled word of a row: the operation's correct form, else the named one, else the first nonblank target span."""
    some = lambda c: F.nullif(F.btrim(c), F.lit(""))
    texts = F.filter(F.transform(spans, lambda s: some(s["text"])), lambda t: t.isNotNull())
    return F.coalesce(some(F.get_json_object(operation, "$.correct")), some(duplicated), F.get(texts, F.lit(0)))


def form_counts(rows: DataFrame, form: Column, where: Column | None = None) -> DataFrame:
    """form, n: how often each form (in lower case) occurs among the rows."""
    kept = rows if where is None else rows.where(where)
    return kept.select(F.lower(form).alias("form")).where("form IS NOT NULL").groupBy("form").agg(F.count(F.lit(1)).alias("n"))


def coverage(cases: DataFrame, training: DataFrame) -> DataFrame:
    """cases (duplicate_token) with duplicate_token_coverage: seen if training (form) has the word, else unseen."""
    known = training.select(F.col("form").alias("k")).distinct().withColumn("hit", F.lit(True))
    joined = cases.join(known, F.lower("duplicate_token") == F.col("k"), "left")
    return joined.withColumn("duplicate_token_coverage", F.when(F.col("hit"), "seen").otherwise("unseen")).drop("k", "hit")


def clean_identity(split: Column, errorful: Column, source: Column, target: Column) -> Column:
    return (split == "dev") & ~errorful & (source == target)


def faulty_rows(rows: DataFrame) -> DataFrame:
    """Rows (case_id, split, is_errorful, tags, source_text, target_text) that contradict themselves, with the reason."""
    n = F.count(F.lit(1)).over(Window.partitionBy("case_id"))
    has_tags = F.size(F.coalesce("tags", F.array().cast(T.ArrayType(T.StringType())))) > 0
    reason = (
        F.when(n > 1, "repeated id")
        .when(F.col("split") != "dev", "wrong split")
        .when(tx.blank("source_text") | tx.blank("target_text"), "blank text")
        .when(has_tags != F.col("is_errorful"), "tags and errorful disagree")
        .when(~F.col("is_errorful") & (F.col("source_text") != F.col("target_text")), "clean row with a change")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL")


def weighted_counts(words: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: candidates per occurrence (mean) and the most of any word. words: word, one row an occurrence; counts: word, n."""
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    joined = often.join(counts, "word")
    return joined.agg(F.sum("times").alias("occurrences"), F.count(F.lit(1)).alias("words"), ratio(F.sum(F.col("times") * F.col("n")), F.sum("times")).alias("mean"), F.max("n").alias("most"))


def suite_shape(cases: DataFrame, expected: dict[str, int]) -> DataFrame:
    """case_type, n, wanted where a suite (case_id, case_type) has another number of cases than wanted, or repeats an id."""
    spark = cases.sparkSession
    wanted = spark.createDataFrame([*expected.items()], "case_type string, wanted long")
    have = cases.groupBy("case_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("d"))
    both = wanted.join(have, "case_type", "full_outer")
    return both.where(~F.col("n").eqNullSafe(F.col("wanted")) | (F.col("d") < F.col("n"))).select("case_type", "n", "wanted")


def focus_tokens(focus: DataFrame, tokens: DataFrame) -> DataFrame:
    """focus spans (case_id, start, end) with the token (token_index, and more) that stands exactly there; none gives null."""
    return focus.join(tokens, ["case_id", "start", "end"], "left")


def provenance_block(files: DataFrame, settings: dict[str, str]) -> DataFrame:
    """One row: the files' digests (path, sha256) by path, and the settings, as maps."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha256"))))
    given = F.create_map(*[F.lit(x) for pair in sorted(settings.items()) for x in pair]) if settings else F.create_map().cast("map<string,string>")
    return files.agg(entries.alias("files")).withColumn("settings", given)
