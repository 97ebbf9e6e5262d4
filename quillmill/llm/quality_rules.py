"""Quality rules with adaptive thresholds.

Each document gets a few counts over its whole text. A fixed base rule removes what is too short or repeats itself.
Every other threshold is learned from the corpus: the counts become ratios, each ratio is summarised per language and
source in a mergeable quantile sketch, the fences come from the sketches' quantiles, and the documents are joined with
the fences of their own group.

A rule trusts a share of a group: up to that quantile what the documents do is normal. The fence lies beyond it by REACH
times its distance from the median. Many ratios are zero for nearly all documents; then that distance says nothing, and
the fence lies halfway, by orders of magnitude, between the trusted quantile and that of TAIL. No fence has a fixed
value; the only floor under a distance is the width of the quantile's own bin, the resolution of the sketch.

The sketch is a histogram over integer bins that keep the leading seven bits of a value, so that a quantile is off by
at most one part in 64. Bins and counts are all there is to it: sketches of parts of the data merge by adding counts,
in any order, with one result. A group with fewer documents than `min_group` takes the merged sketch of its language,
and a small language that of the corpus.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, hold, map_texts, table, with_row

#: Symbols that seldom stand in prose.
SYMBOLS = "#*$%&|<>"
SYMBOL_SET = frozenset(SYMBOLS)
WINDOW = 8
#: Ratio name -> (numerator, scale, denominator, trusted share in percent, reach, fences: 1 upper, 2 both).
RATIOS = {
    "symbol_rate": ("n_symbols", 1000, "n_words", 90, 3, 1),
    "stutter_rate": ("n_stutters", 1000, "n_words", 95, 3, 1),
    "dup_line_rate": ("n_dup_lines", 1000, "n_lines", 99, 1, 1),
    "word_length": ("word_chars", 100, "n_words", 90, 3, 2),
}
#: The quantile, in percent, that stands for the far end of a group; a rule that trusts more has its own there.
TAIL = 97
MIN_GROUP = 200
BROADCAST_GROUPS = 100_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters"]
SKETCH_BITS = 7


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS; zeros for None.

    n_lines counts lines that have a word, n_stutters words that equal the word before.
    """
    if not text:
        return (0,) * len(COUNTS)
    words = WORD.findall(text)
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if WORD.search(x)] if "\n" in text else [text] if words else []
    return len(words), sum(map(len, words)), n_symbols, len(lines) - len(set(lines)), repeated(words), len(lines), sum(map(eq, words, words[1:]))


def repeated(words: list[str]) -> int:
    """How many words lie in a window of eight that occurs twice or more. Exact: windows are named by doubling."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[str, int] = {}
    names = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    step = 1
    while step < WINDOW:
        names = names[:-step] * np.int64(n + 1) + names[step:]
        values, names, counts = np.unique(names, return_inverse=True, return_counts=True)
        if len(values) == len(names):
            return 0
        step *= 2
    starts = np.flatnonzero(counts[names] > 1)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(marks[:n])))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and the counts; the texts stay where they are."""

    def counts(texts: list[str | None]):
        found = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        return None, {name: found[:, i] for i, name in enumerate(COUNTS)}

    return map_texts(docs, keep, dict.fromkeys(COUNTS, "long"), lambda: counts).withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ratio(name: str) -> Column:
    top, scale, below = RATIOS[name][:3]
    return F.expr(f"cast(({scale} * {top}) div greatest({below}, 1) as bigint)")


def sketch_bin(value: Column) -> Column:
    """The lowest value of the bin that a non-negative integer falls into."""
    low = _spare_bits(value)
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def _spare_bits(value: Column) -> Column:
    return F.greatest(F.length(F.bin(value)) - F.lit(SKETCH_BITS), F.lit(0))


def bin_width(value: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), _spare_bits(value))


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, rule, bin, n: the sketch of each ratio over the documents that the base rule lets through."""
    ratios = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), sketch_bin(ratio(r)).alias("bin")) for r in RATIOS])).alias("x")
    return counted.where(~F.col("base_failed")).select("lang", "source", ratios).groupBy("lang", "source", "x.rule", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """f_lang, f_source, and low_<rule>, high_<rule> and level_<rule> for each rule.

    The three levels (0: language and source, 1: language, 2: all) are merges of the same sketches; a group takes the
    first that summarises at least min_group documents, or the last. A small group's own quantiles would be its few
    documents themselves.
    """
    levels = {0: ["lang", "source"], 1: ["lang"], 2: []}
    trusted = F.create_map(*[F.lit(x) for r, spec in RATIOS.items() for x in (r, spec[3])])
    parts = []
    for level, keys in levels.items():
        merged = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "rule")
        running = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group)).withColumn("t", trusted[F.col("rule")])
        share = {"low": 100 - F.col("t"), "mid": F.lit(50), "high": F.col("t"), "tail": F.greatest("t", F.lit(TAIL))}
        marks = [F.min(F.when(100 * F.col("upto") >= of * F.col("total"), F.col("bin"))).alias(name) for name, of in share.items()]
        parts.append(running.groupBy(*keys, "rule").agg(F.max("total").alias("total"), *marks))
    joined = sketch.select("lang", "source", "rule").distinct()
    for level, keys in levels.items():
        part = parts[level].select(*[F.col(k).alias(f"{k}_{level}") for k in keys], F.col("rule").alias(f"rule_{level}"), F.struct("total", "low", "mid", "high", "tail", F.lit(level).alias("level")).alias(f"of_{level}"))
        on = F.col("rule") == F.col(f"rule_{level}")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}_{level}"))
        joined = joined.join(part, on)
    pick = F.coalesce(*[F.when(F.col(f"of_{i}.total") >= min_group, F.col(f"of_{i}")) for i in (0, 1)], F.col("of_2"))
    chosen = joined.select("lang", "source", "rule", pick.alias("of"))
    reach = F.create_map(*[F.lit(x) for r, spec in RATIOS.items() for x in (r, spec[4])])[F.col("rule")]
    low, mid, high, tail = (F.col(f"of.{m}") for m in ("low", "mid", "high", "tail"))
    halfway = F.floor(F.sqrt(((high + 1) * (tail + 1)).cast("double"))) - 1
    upper = F.greatest(high + F.greatest(reach * (high - mid), bin_width(high)), halfway)
    bounds = chosen.select("lang", "source", "rule", "of.level", (low - F.greatest(reach * (mid - low), bin_width(low))).alias("low"), upper.alias("high"))
    return bounds.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(
        *[F.max(F.when(F.col("rule") == r, F.col(side))).alias(f"{side}_{r}") for r in RATIOS for side in ("low", "high", "level")]
    )


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source; more columns are ignored): the counts, the ratios, base_failed, kept, level.

    level says which sketch gave the fences: 0 that of language and source, 1 that of the language, 2 that of all; null
    where no document of the group got past the base rule.

    Null and empty texts have zero counts and fail the base rule, as every text under 20 words does. Null languages and
    sources form groups of their own. Equal rows get equal verdicts. An empty table gives an empty result. A group
    without any document past the base rule has no fences and needs none.
    """
    counted = hold(measured(docs, ["doc_id", "lang", "source"]))
    judged_rows = judged(counted, fences(sketches(counted), min_group))
    return judged_rows.select("doc_id", "lang", "source", *COUNTS, *[ratio(r).alias(r) for r in RATIOS], "base_failed", "kept", F.col("level_symbol_rate").alias("level"))


def judged(counted: DataFrame, bounds: DataFrame) -> DataFrame:
    """counted, joined with the fences of each row's group, with kept.

    The fences of up to BROADCAST_GROUPS groups are broadcast, some 200 bytes each, so that no row moves and a hot group
    stays spread; beyond, rows are shuffled by their group.
    """
    bounds = hold(bounds)
    bounds = F.broadcast(bounds) if bounds.count() <= BROADCAST_GROUPS else bounds
    on = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    inside = F.lit(True)
    for r, spec in RATIOS.items():
        inside = inside & (ratio(r) <= F.col(f"high_{r}"))
        if spec[5] == 2:
            inside = inside & (ratio(r) >= F.col(f"low_{r}"))
    return counted.join(bounds, on, "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of docs (text, lang, source) that quality_rules keeps, with all their columns.

    Null and empty texts and all others under 20 words go, rows without language or source are judged as groups of their
    own, repeated rows share one verdict, and an empty table stays empty. The texts are measured twice, before and
    after the fences are known, so that neither texts nor rows are shuffled or stored.
    """
    columns = ["lang", "source", "text"]
    bounds = fences(sketches(hold(measured(docs, ["lang", "source"]))), min_group)
    rows = judged(measured(with_row(docs, *columns), ["lang", "source", "__row"]), bounds)
    return rows.where("kept").select("__row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same in SQL. Windows of eight words are compared as lists."""
    ratios = ", ".join(f"({scale} * {top}) // greatest({below}, 1) AS {r}" for r, (top, scale, below, *_) in RATIOS.items())
    binned = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, ({r} >> greatest(length(bin({r})) - {SKETCH_BITS}, 0)) << greatest(length(bin({r})) - {SKETCH_BITS}, 0) AS bin FROM r WHERE NOT base_failed" for r in RATIOS)
    trusted = "CASE rule " + " ".join(f"WHEN '{r}' THEN {spec[3]}" for r, spec in RATIOS.items()) + " END"
    marks = {"low": "100 - t", "mid": "50", "high": "t", "tail": f"greatest(t, {TAIL})"}
    found = ", ".join(f"min(bin) FILTER (WHERE 100 * upto >= ({of}) * total) AS {name}" for name, of in marks.items())
    level = "SELECT {k} rule, max(total) AS total, " + found + f" FROM (SELECT *, {trusted} AS t, sum(n) OVER (PARTITION BY {{k}} rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {{k}} rule) AS total FROM (SELECT {{k}} rule, bin, count(*) AS n FROM b GROUP BY ALL)) GROUP BY ALL"
    reach = "CASE rule " + " ".join(f"WHEN '{r}' THEN {spec[4]}" for r, spec in RATIOS.items()) + " END"
    width = lambda q: f"(1::BIGINT << greatest(length(bin({q})) - {SKETCH_BITS}, 0))"
    pick = lambda q: f"CASE WHEN l0.total >= {MIN_GROUP} THEN l0.{q} WHEN l1.total >= {MIN_GROUP} THEN l1.{q} ELSE l2.{q} END AS {q}"
    verdicts = " AND ".join(f"coalesce(r.{r} <= (SELECT max(upper) FROM f WHERE rule = '{r}' AND f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source), false)" + (f" AND coalesce(r.{r} >= (SELECT max(lower) FROM f WHERE rule = '{r}' AND f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source), false)" if s[5] == 2 else "") for r, s in RATIOS.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, lang, source, text, regexp_extract_all(text, '[^ \t-\r]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
p AS (SELECT k, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT k, i, list(word) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS gram FROM p),
h AS (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g WHERE len(gram) = {WINDOW}),
c AS (SELECT k, count(DISTINCT i + o) AS n_repeat_words FROM h, range({WINDOW}) t(o) WHERE n > 1 GROUP BY k),
m AS (SELECT k, doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1]))::BIGINT AS n_stutters, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (k)),
r AS (SELECT *, {ratios}, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
b AS ({binned}),
l0 AS ({level.format(k="lang, source,")}), l1 AS ({level.format(k="lang,")}), l2 AS ({level.format(k="")}),
q AS (SELECT g.lang, g.source, g.rule, {", ".join(map(pick, marks))} FROM (SELECT DISTINCT lang, source, rule FROM b) g
 JOIN l0 ON g.rule = l0.rule AND g.lang IS NOT DISTINCT FROM l0.lang AND g.source IS NOT DISTINCT FROM l0.source JOIN l1 ON g.rule = l1.rule AND g.lang IS NOT DISTINCT FROM l1.lang JOIN l2 ON g.rule = l2.rule),
f AS (SELECT *, greatest(high + greatest({reach} * (high - mid), {width("high")}), floor(sqrt(((high + 1) * (tail + 1))::DOUBLE)) - 1) AS upper, low - greatest({reach} * (mid - low), {width("low")}) AS lower FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdicts} AS kept FROM r
"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": _oracle()}
