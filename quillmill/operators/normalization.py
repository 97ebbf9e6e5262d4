"""Building rules, and normalizing words and documents with them.

Words are normalized once each: documents are taken apart into words, the distinct words go through the rules, and what
they become is put in at their offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow as ar
from ..functions import text as tx
from ..functions.candidates import CANDIDATE, candidates, candidates_udf, eligible, pair_rules_udf
from ..functions.distance import damerau_levenshtein, dld
from ..functions.forms import EACH, FormTable, ends_of, folded, leftmost, stretches, whole_forms

#: Tables that travel with a UDF may have so many rows; larger ones are joined.
MOST_RULES, MOST_WORDS, MOST_INDEXED, MOST_ANSWERS = 200_000, 500_000, 30_000, 500_000


# Artifacts


def rule_weights(observed: DataFrame) -> DataFrame:
    """src, dst, weight, n: the share of each replacement of an n-gram, counting it once more as itself.

    observed has a row (src, dst) for each replacement seen.
    """
    seen = observed.select("src", "dst").unionByName(observed.select("src", F.col("src").alias("dst")).distinct())
    counted = seen.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("src")))


def induced_rules(pairs: DataFrame, longest: int = 2) -> DataFrame:
    """rule_weights of word pairs (source, target), for n-grams of 2 to `longest` letters."""
    walk = pair_rules_udf(range(2, longest + 1))
    return rule_weights(pairs.select(F.inline(walk("source", "target"))))


def curated_forms(rows: DataFrame, category: str = "slang") -> DataFrame:
    """key, targets, source_ids, normalized, source_id, rows, ambiguous of the rows (row, id, informal, normalized, category) of that category.

    Forms are compared by their key; a form whose rows disagree on the target's key is ambiguous and maps to nothing.
    """
    own = rows.where(F.lower(F.btrim("category")) == category).select("row", F.btrim("id").alias("id"), tx.form_key("informal").alias("key"), F.btrim("normalized").alias("target"), tx.form_key("normalized").alias("target_key"))
    grouped = own.groupBy("key").agg(
        F.count_distinct("target_key").alias("targets"),
        F.count(F.lit(1)).alias("rows"),
        F.min_by("target", "row").alias("normalized"),
        F.min_by("id", "row").alias("source_id"),
        F.transform(F.array_sort(F.collect_list(F.struct("row", "id"))), lambda x: x["id"]).alias("source_ids"),
    )
    ambiguous = F.col("targets") > 1
    return grouped.withColumn("ambiguous", ambiguous).withColumns({c: F.when(~ambiguous, F.col(c)) for c in ("normalized", "source_id")})


def curated_statistics(rows: DataFrame, forms: DataFrame, category: str = "slang") -> DataFrame:
    """One row: how many rows and forms there are, are accepted, doubled and ambiguous."""
    filled = F.coalesce(F.length(F.btrim(F.concat_ws("", "informal", "normalized", "category"))) > 0, F.lit(False))
    of_rows = rows.agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(filled).alias("populated_rows"), F.count_if(F.lower(F.btrim("category")) == category).alias("category_rows"))
    accepted, twice = ~F.col("ambiguous"), F.col("rows") > 1
    of_forms = forms.agg(
        F.count(F.lit(1)).alias("unique_inputs"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(accepted & twice).alias("duplicate_forms"),
        F.coalesce(F.sum(F.when(accepted, F.col("rows") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.count_if("ambiguous").alias("ambiguous_forms"),
        F.coalesce(F.sum(F.when(F.col("ambiguous"), F.col("rows"))), F.lit(0)).alias("ambiguous_rows"),
    )
    return of_rows.crossJoin(of_forms)  # one row each


def conflict_summary(forms: DataFrame) -> DataFrame:
    """One row, summary: the ambiguous forms and their ids as text, in order; empty without any."""
    lines = forms.where("ambiguous").select(F.concat(F.col("key"), F.lit(": "), F.array_join("source_ids", ", ")).alias("line"))
    return lines.agg(F.coalesce(F.array_join(F.array_sort(F.collect_list("line")), "; "), F.lit("")).alias("summary"))


def vocabulary_union(*words: DataFrame) -> DataFrame:
    """word: the distinct words, in lower case, of tables with a column word."""
    out = words[0].select("word")
    for other in words[1:]:
        out = out.unionByName(other.select("word"))
    return out.select(F.lower(F.btrim("word")).alias("word")).where("word <> ''").distinct()


def unique_words(lines: DataFrame) -> DataFrame:
    """line, word: of words that are the same in lower case the first, in its own spelling. lines: line, word."""
    first = Window.partitionBy(F.lower("word")).orderBy("line")
    return lines.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


# Candidates


def cutoff_with_ties(scored: DataFrame, keys: list[str], weight: str, cutoff: int) -> DataFrame:
    """The rows of each key that weigh no less than the cutoff-th; there may be more than cutoff."""
    return scored.withColumn("__rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(weight)))).where(F.col("__rank") <= cutoff).drop("__rank")


def first_least(scored: DataFrame, keys: list[str], distance: str = "distance", order: str = "ord") -> DataFrame:
    """One row a key: the candidate of least distance, of equal ones that with the least order."""
    rest = [c for c in scored.columns if c not in keys]
    return scored.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(distance, order)).alias("x")).select(*keys, "x.*")


def nearest(scored: DataFrame, keys: list[str], k: int, distance: str = "distance", order: str = "ord") -> DataFrame:
    """The k nearest candidates of each key, with their rank from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(distance, order))).where(F.col("rank") <= k)


def in_vocabulary(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Those rows (word, candidate, ...) of which every part of the candidate is in the vocabulary (word); blank ones are not."""
    parts = found.select("word", "candidate", F.explode(tx.space_words(F.lower("candidate"))).alias("part")).distinct()
    missing = parts.join(vocabulary.select(F.col("word").alias("part")), "part", "left_anti").select("word", "candidate").distinct()
    return found.where(~tx.blank("candidate")).join(by_merge(missing), ["word", "candidate"], "left_anti")


def by_merge(df: DataFrame) -> DataFrame:
    """df, which grows with the texts, joined where its rows are: a table that looks small is else sent through the driver."""
    return df.hint("merge")


Rules = Mapping[str, Mapping[str, float]]


def rule_map(rules: DataFrame) -> dict[str, dict[str, float]] | DataFrame:
    """The rules as a dictionary on the driver, or above MOST_RULES rows as the table src, dst, weight, ord, which every
    operator here takes as well. Replacements stand in the order of ord if there is one."""
    order = ["src", "ord"] if "ord" in rules.columns else ["src", F.desc("weight"), "dst"]
    rows = rules.orderBy(*order).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        return ordered_rules(rules)
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        out.setdefault(r["src"], {})[r["dst"]] = float(r["weight"])
    return out


def ordered_rules(rules: DataFrame) -> DataFrame:
    """src, dst, weight, ord of rules; ord counts by falling weight where there is none."""
    if "ord" not in rules.columns:
        rules = rules.withColumn("ord", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst")))
    return rules.select("src", "dst", F.col("weight").cast("double").alias("weight"), F.col("ord").cast("long").alias("ord"))


def words_with_rules(words: DataFrame, rules: DataFrame, longest: int) -> DataFrame:
    """words (column word, distinct) with `own`, those of the rules (src, dst, weight, ord) that the word can meet.

    What rules make of a word hangs on the rules of its own n-grams, so that one join by n-gram finds them, of any number
    of rules, and each word goes on with a few.
    """
    n = F.length("word")
    grams = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(max(2, longest))), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda at: F.substr(F.col("word"), at, k))))
    last = F.substr(F.col("word"), F.greatest(n, F.lit(1)), F.lit(1))
    met = words.select("word", F.explode(F.array_distinct(F.concat(grams, F.array(last)))).alias("src"))
    found = met.join(ordered_rules(rules), "src").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("src", "ord", "dst", "weight"))).alias("own"))
    return words.select("word").join(found, "word", "left")


def _own_rules(rows) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for r in rows if rows is not None else ():
        out.setdefault(r["src"], {})[r["dst"]] = r["weight"]
    return out


def word_candidates(words: DataFrame, rules: Rules | DataFrame, longest: int = 2, cutoff: int = 100) -> DataFrame:
    """word, candidate, weight, ord of distinct words (column word, in lower case)."""
    asked = words.select("word").distinct().where(eligible(F.col("word")))
    if not isinstance(rules, DataFrame):
        return asked.select("word", F.inline(candidates_udf(rules, longest, cutoff)("word")))

    @F.pandas_udf(T.ArrayType(CANDIDATE))
    def make(own_words: pd.Series, own_rules: pd.Series) -> pd.Series:
        found = (candidates(w, _own_rules(r), longest, cutoff) for w, r in zip(own_words, own_rules, strict=True))
        return pd.Series([[{"candidate": c, "weight": float(x), "ord": i} for i, (c, x) in enumerate(f.items())] for f in found], dtype=object)

    return words_with_rules(asked, rules, longest).select("word", F.inline(make("word", "own")))


def small_vocabulary(vocabulary: DataFrame) -> frozenset[str] | None:
    """The words on the driver, or None above MOST_WORDS."""
    rows = vocabulary.select(F.lower("word").alias("word")).distinct().limit(MOST_WORDS + 1).collect()
    return frozenset(r["word"] for r in rows) if len(rows) <= MOST_WORDS else None


_ANSWER = T.StructType([T.StructField("normalized", T.StringType()), T.StructField("distance", T.IntegerType())])


def shortened(word: str, k: int) -> set[str]:
    """The word without up to k of its letters. Words within an edit distance of k, transpositions included, share one."""
    out = last = {word}
    for _ in range(k):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


@lru_cache(maxsize=2)
def shortened_words(words: frozenset[str], k: int) -> frozenset[str]:
    """All that shortened() makes of the words; built once a worker."""
    return frozenset().union(*(shortened(w, k) for w in words if len(w) <= 128))


@lru_cache(maxsize=2)
def known_ends(words: frozenset[str], longest: int) -> frozenset[str]:
    """All ends of the words of up to so many letters, the empty one among them; built once a worker."""
    return frozenset(w[i:] for w in words if len(w) <= longest for i in range(len(w) + 1)) | {""}


def known_candidates(word: str, rules: Rules, longest: int, words: frozenset[str], ends: frozenset[str]) -> set[str]:
    """Those of words that the rules make of the word without any cutoff; candidates() has no others of them.

    As candidates() builds each from its end, all it goes through on the way to a known word are ends of that word.
    """
    size = len(word)
    of: list[set[str]] = [set() for _ in range(size + 1)]
    of[size] = {""}
    last = word[-1:]
    barren = not rules.get(last, True)  # whether there is nothing at all at the place behind
    for at in range(size - 1, -1, -1):
        if at == size - 1:
            of[at] = set(ends.intersection(rules[last] if last in rules else (last, "")))
            continue
        found: set[str] = set()
        some = False
        for n in range(2, min(longest, size - at) + 1):
            gram = word[at : at + n]
            if gram not in rules:
                some = some or not barren
                found.update(ends.intersection([gram[0] + tail for tail in of[at + 1]]))
                continue
            for new in rules[gram]:
                some = True
                if new in ends:
                    found.add(new)
                found.update(ends.intersection([new + tail for tail in of[at + (n if new == gram else 1)]]))
        of[at] = found if some else set(ends.intersection((word[at:],)))
        barren = False
    return of[0] & words


def nearest_known(rules: Rules | None, words: frozenset[str], longest: int, cutoff: int, max_distance: int | None, spaced: bool | None = None):
    """A UDF from a word that is not in `words` to the nearest known candidate and its distance, in an array that is empty
    where the word stays. Without rules it takes each word's own ones as well; spaced says if any makes several words."""
    frozen = {src: dict(dst) for src, dst in rules.items()} if rules is not None else None
    if spaced is None:
        spaced = any(c.isspace() for dst in frozen.values() for new in dst for c in new)
    indexed = max_distance in (1, 2) and not spaced and len(words) <= MOST_INDEXED
    # With rules that write no white space and no capitals a candidate is known as it stands.
    plain = frozen is not None and max_distance is not None and len(words) <= MOST_INDEXED and not any(c.isspace() or c != c.lower() for dst in frozen.values() for new in dst for c in new)

    def answer(word: str, own: Rules) -> list[dict]:
        best, least = None, 0
        for c in candidates(word, own, longest, cutoff):
            parts = c.split()
            if parts and words.issuperset(map(str.lower, parts)):
                d = damerau_levenshtein(word, c)
                if best is None or d < least:
                    best, least = c, d
        stays = best is None or best == word or max_distance is not None and least > max_distance
        return [] if stays else [{"normalized": best.strip(), "distance": least}]

    def told(word: str) -> list[dict]:
        """answer(word, frozen), whose candidates are made only if a known word that is near enough can be among them."""
        if any(c.isspace() or c != c.lower() for c in word):
            return answer(word, frozen)
        made = known_candidates(word, frozen, longest, words, known_ends(words, 128 + max_distance))
        near = {c: d for c in made if c and abs(len(c) - len(word)) <= max_distance and (d := damerau_levenshtein(word, c)) <= max_distance}
        if not near:
            return []
        best = min((c for c in candidates(word, frozen, longest, cutoff) if c in near), key=near.__getitem__, default=word)
        return [] if best == word else [{"normalized": best, "distance": near[best]}]

    def near_any(word: str, index) -> bool:
        # No candidate within the distance can be known if no known word is: then none need be made.
        return index is None or not index.isdisjoint(shortened(word, max_distance))

    @F.pandas_udf(T.ArrayType(_ANSWER))
    def shared(asked: pd.Series) -> pd.Series:
        if plain:
            return pd.Series([told(w) for w in asked], dtype=object)
        index = shortened_words(words, max_distance) if indexed else None
        return pd.Series([answer(w, frozen) if near_any(w, index) else [] for w in asked], dtype=object)

    @F.pandas_udf(T.ArrayType(_ANSWER))
    def single(asked: pd.Series, own: pd.Series) -> pd.Series:
        index = shortened_words(words, max_distance) if indexed else None
        return pd.Series([answer(w, _own_rules(r)) if near_any(w, index) else [] for w, r in zip(asked, own, strict=True)], dtype=object)

    return shared if rules is not None else single


def normalized_words(words: DataFrame, vocabulary: DataFrame, rules: Rules | DataFrame, longest: int = 2, cutoff: int = 100, max_distance: int | None = 2, relational: bool = False) -> DataFrame:
    """word, normalized, distance of the words that automatic normalization changes.

    Words of the vocabulary, of one or of more than 128 letters stay. Of the candidates that the vocabulary knows, the
    nearest by Damerau-Levenshtein wins, of equally near ones the one that came up first; if it is the word itself or
    further than max_distance, the word stays. A vocabulary of up to MOST_WORDS words travels with the UDF; beyond, or
    if relational is set, candidates are rows that are joined with it. Rules travel likewise, or are a table (src, dst,
    weight and maybe ord) of any size that words are joined with.
    """
    unknown = words.select(F.lower("word").alias("word")).distinct().join(vocabulary.select(F.lower("word").alias("word")), "word", "left_anti")
    known = None if relational else small_vocabulary(vocabulary)
    if known is not None:
        # Distinct words are few bytes and much work: they are dealt to a set number of tasks, which is not reduced.
        tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        asked = unknown.where(eligible(F.col("word")))
        if isinstance(rules, DataFrame):
            spaced = not rules.where(F.col("dst").rlike(r"(?U)\s")).isEmpty()
            asked = words_with_rules(asked, rules, longest).repartition(tasks)
            return asked.select("word", F.inline(nearest_known(None, known, longest, cutoff, max_distance, spaced)("word", "own")))
        return asked.repartition(tasks).select("word", F.inline(nearest_known(rules, known, longest, cutoff, max_distance)("word")))
    survivors = in_vocabulary(word_candidates(unknown, rules, longest, cutoff), vocabulary)
    best = first_least(survivors.withColumn("distance", dld("word", "candidate")), ["word"])
    near = F.lit(True) if max_distance is None else F.col("distance") <= max_distance
    return best.where((F.col("candidate") != F.col("word")) & near).select("word", F.btrim("candidate").alias("normalized"), "distance")


# Documents


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("word", T.StringType())])
_SPANS = T.StructType([T.StructField("curated", T.ArrayType(_SPAN)), T.StructField("words", T.ArrayType(_SPAN))])
_EDIT = T.StructType([*_SPAN.fields, T.StructField("suggestion", T.StringType()), T.StructField("strategy", T.StringType()), T.StructField("source_id", T.StringType())])
_EDITED = T.StructType([T.StructField("normalized", T.StringType()), T.StructField("changes", T.ArrayType(_EDIT))])

_EDIT_KINDS = (("start", pa.int32()), ("end", pa.int32()), *((n, pa.string()) for n in _EDIT.names[2:]))

# What automatic words are made of, and what may not touch them.
_URL = re.compile(r"(?i)(?:https?://|ftp://|www\.)\S+")
_EMAIL = re.compile(tx.EMAIL)
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def apart(spans: Iterable[tuple[int, int]], closed: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of spans that overlap none of closed; both are in order and closed ones don't overlap. One walk over both."""
    out, k = [], 0
    for start, end in spans:
        while k < len(closed) and closed[k][1] <= start:
            k += 1
        if k == len(closed) or closed[k][0] >= end:
            out.append((start, end))
    return out


def spans_in(text: str, tables: Sequence[FormTable], met: Sequence | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Curated and automatic spans of a text.

    URLs and addresses are left alone. A curated form is matched longest first, not inside words, and not where
    an apostrophe or dash ties it to one. Words are runs of letters that no digit or underscore touches. met: the longest
    form at each place, where they have been found already.
    """
    closed = merged(m.span() for guard in (_URL, _EMAIL) for m in guard.finditer(text))
    curated = apart(whole_forms(text, tables) if met is None else leftmost([(m["start"], m["end"]) for m in met]), closed) if tables or met is not None else []
    touched = lambda c: c.isdigit() or c == "_"
    plain = [(s, e) for s, e in apart((m.span() for m in _WORD.finditer(text)), merged([*closed, *curated])) if not touched(text[s - 1 : s]) and not touched(text[e : e + 1])]
    return curated, plain


def document_spans(forms: Iterable[str]):
    """A UDF from a text to its curated and automatic spans: struct of curated and words, each an array of start, end, word."""
    own = list(forms)
    tables = [FormTable.of(own)] if own else []

    @F.pandas_udf(_SPANS)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            t = t or ""
            rows.append([[{"start": s, "end": e, "word": t[s:e]} for s, e in spans] for spans in spans_in(t, tables)])
        return pd.DataFrame(rows, columns=["curated", "words"])

    return run


def with_case_of(source: str, suggestion: str) -> str:
    """The suggestion in the case of the source: all upper, first upper, or as it is."""
    if source == source.upper() != source.lower():
        return suggestion.upper()
    return suggestion[:1].upper() + suggestion[1:] if source[:1] == source[:1].upper() != source[:1].lower() else suggestion


def met_forms(texts: DataFrame, forms: DataFrame, key: str) -> DataFrame:
    """key, met: of each text (key, text) that has some, the longest form (column form) at each place, by start.

    For any number of forms: the stretches of texts that could be forms are joined with them by their letters.
    """

    @F.pandas_udf("ends int, letters int")
    def size(own: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"ends": [ends_of(f) for f in own], "letters": own.str.len()})

    @F.pandas_udf(T.StringType())
    def fold(own: pd.Series) -> pd.Series:
        return own.map(folded)

    known = forms.select(fold("form").alias("letters")).where("letters <> ''").distinct()
    most = known.select(size("letters").alias("s")).agg(F.max("s.ends"), F.max("s.letters")).first()
    ends, longest = most[0] or 0, most[1] or 0

    @F.pandas_udf(T.ArrayType(_SPAN))
    def cut(own: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "word": x} for a, b, x in stretches(t or "", ends, longest)] for t in own], dtype=object)

    each = texts.select(key, F.inline(cut("text")))
    longest_each = each.join(known, F.col("word") == F.col("letters"), "left_semi").groupBy(key, "start").agg(F.max("end").alias("end"))
    return longest_each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("met"))


def form_map(forms: DataFrame) -> dict[str, tuple[str, str]] | DataFrame:
    """The unambiguous ones of curated_forms as form key -> (normalized, source_id), or above MOST_ANSWERS as a table form,
    target, source_id; normalize_documents takes either."""
    own = forms.where("NOT ambiguous").select(F.col("key").alias("form"), F.col("normalized").alias("target"), "source_id")
    rows = own.limit(MOST_ANSWERS + 1).collect()
    return {r["form"]: (r["target"], r["source_id"]) for r in rows} if len(rows) <= MOST_ANSWERS else own


def _form_key(text: str) -> str:
    return " ".join(text.split()).lower()


def normalize_documents(docs: DataFrame, vocabulary: DataFrame, rules: Rules | DataFrame, curated: Mapping[str, tuple[str, str]] | DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, text, normalized, changes of each row; key is unique. curated: form key -> (normalized, source_id), or a table
    form, target, source_id, of any size.

    changes: array of start, end, word, suggestion, strategy, source_id, in order. Null texts stay null. Spans are found
    in one walk over each text; distinct words are normalized once. Up to MOST_ANSWERS words that change travel to the
    texts, and nothing of a document is shuffled; beyond, and for a table of forms, spans are joined with what they become.
    Up to EACH forms are looked for where the texts are; more are joined with stretches of the texts.
    """
    base = docs.select(key, F.col(text).alias("text"))
    if isinstance(curated, DataFrame):
        forms = curated.select("form", "target", "source_id")
        known = None
    else:
        known = dict(curated)
        forms = base.sparkSession.createDataFrame([(k, n, i) for k, (n, i) in sorted(known.items())], "form string, target string, source_id string")
    spark = base.sparkSession
    own = [r["form"] for r in forms.select("form").where("form IS NOT NULL").limit(EACH + 1).collect()] if known is None else list(known)
    many = len(own) > EACH
    tables = spark.sparkContext.broadcast([FormTable.of(own)] if own and not many else [])
    kind = T.ArrayType(T.StructType(_SPAN.fields[:2]))
    texts = base.join(met_forms(base, forms, key), key, "left").withColumn("met", F.coalesce("met", F.array().cast(kind))) if many else base.withColumn("met", F.lit(None).cast(kind))

    @F.pandas_udf(_SPANS)
    def find(own_texts: pd.Series, met: pd.Series) -> pd.DataFrame:
        rows = [[[{"start": s, "end": e, "word": t[s:e]} for s, e in spans] for spans in spans_in(t, tables.value, m)] for t, m in zip((x or "" for x in own_texts), met, strict=True)]
        return pd.DataFrame(rows, columns=["curated", "words"])

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def words_of(own_texts: pa.Array, met: pa.Array) -> pa.Array:
        made = lambda own, places: [list({t[s:e].lower() for s, e in spans_in(t, tables.value, m)[1]}) for t, m in zip((x or "" for x in own.to_pylist()), places.to_pylist(), strict=True)]
        return ar.whole(pa.array(made(*part), pa.list_(pa.string())) for part in ar.stretches(own_texts, met))

    asked = texts.select(F.explode(words_of("text", "met")).alias("word")).distinct()
    answers = normalized_words(asked, vocabulary, rules, **options).select(F.col("word").alias("w"), F.col("normalized").alias("target"))
    few = answers.limit(MOST_ANSWERS + 1).collect() if known is not None and len(known) <= MOST_ANSWERS else None
    if few is not None and len(few) <= MOST_ANSWERS:
        shared = spark.sparkContext.broadcast(({r["w"]: r["target"] for r in few}, known))
        return base.withColumn("e", _edited(tables, shared)("text")).select(key, "text", "e.changes", F.when(F.col("text").isNotNull(), F.col("e.normalized")).alias("normalized")).withColumn("changes", F.when(F.size("changes") > 0, F.col("changes")))
    spans = texts.withColumn("s", find("text", "met"))
    of_forms = spans.select(key, F.inline("s.curated")).join(forms, tx.form_key("word") == F.col("form")).select(key, "start", "end", "word", "target", F.lit("curated_rule").alias("strategy"), "source_id")
    automatic = spans.select(key, F.inline("s.words")).join(answers, F.lower("word") == F.col("w")).select(key, "start", "end", "word", "target", F.lit("ngram_dld").alias("strategy"), F.lit(None).cast("string").alias("source_id"))
    edits = of_forms.unionByName(automatic).withColumn("suggestion", tx.with_case_of(F.col("word"), F.col("target"))).where("suggestion <> word")
    changes = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "word", "suggestion", "strategy", "source_id"))).alias("changes"))
    joined = base.join(changes, key, "left")
    return joined.withColumn("normalized", F.when(F.col("changes").isNull(), F.col("text")).otherwise(_spliced("text", "changes")))


def _put_in(text: str, changes: Sequence[Mapping]) -> str:
    parts, end = [], 0
    for c in changes:
        parts += [text[end : c["start"]], c["suggestion"]]
        end = c["end"]
    return "".join([*parts, text[end:]])


@F.pandas_udf(T.StringType())
def _spliced(texts: pd.Series, changes: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _put_in(t, c if c is not None else []) for t, c in zip(texts, changes, strict=True)], dtype=object)


def _edited(tables, shared):
    """A UDF from a text to the normalized text and its changes."""

    def edited(t: str) -> tuple[str, list[tuple]]:
        answers, forms = shared.value
        curated, plain = spans_in(t, tables.value)
        found = [(s, e, *forms[k], "curated_rule") for s, e in curated if (k := _form_key(t[s:e])) in forms]
        found += [(s, e, target, None, "ngram_dld") for s, e in plain if (target := answers.get(t[s:e].lower())) is not None]
        made = ((s, e, t[s:e], with_case_of(t[s:e], target), strategy, source) for s, e, target, source, strategy in sorted(found, key=lambda x: x[:2]))
        changes = [x for x in made if x[2] != x[3]]
        return _put_in(t, [{"start": s, "end": e, "suggestion": new} for s, e, _, new, *_ in changes]), changes

    @F.arrow_udf(_EDITED)
    def run(texts: pa.Array) -> pa.Array:
        def found(own: pa.Array) -> pa.Array:
            rows = [edited(t or "") for t in own.to_pylist()]
            columns = list(zip(*(c for _, changes in rows for c in changes), strict=True)) or [()] * len(_EDIT_KINDS)
            changes = ar.lists([len(c) for _, c in rows], ar.structs(_EDIT_KINDS, columns))
            return pa.StructArray.from_arrays([pa.array([t for t, _ in rows], pa.string()), changes], names=_EDITED.names)

        return ar.whole(found(own) for (own,) in ar.stretches(texts))

    return run


# Diagnosis


def explained(words: DataFrame, forms: DataFrame, answers: DataFrame, use_curated: bool = True) -> DataFrame:
    """word, strategy, source_id, output, curated_rule_status of words. forms as of curated_forms, answers as of normalized_words."""
    known = forms.select(F.col("key").alias("k"), "ambiguous", F.col("normalized").alias("form_target"), F.col("source_id").alias("form_id"))
    own = answers.select(F.col("word").alias("w"), F.col("normalized").alias("auto"))
    joined = words.select("word").join(known, tx.form_key("word") == F.col("k"), "left").join(own, F.lower("word") == F.col("w"), "left")
    usable = F.col("form_target").isNotNull()
    hit = usable & F.lit(use_curated)
    status = F.when(hit, "matched").when(F.col("ambiguous"), "ambiguous").when(usable, "available_disabled").otherwise("absent")
    target = F.when(hit, F.col("form_target")).otherwise(F.coalesce("auto", "word"))
    return joined.select("word", F.when(hit, "curated_rule").otherwise("ngram_dld").alias("strategy"), F.when(hit, F.col("form_id")).alias("source_id"), tx.with_case_of(F.col("word"), target).alias("output"), status.alias("curated_rule_status"))


def candidate_diagnostics(pairs: DataFrame, vocabulary: DataFrame, rules: Rules | DataFrame, longest: int = 2, cutoff: int = 100, max_distance: int | None = 2, top: int = 10) -> DataFrame:
    """pairs (source, expected, prediction and more) with what normalization had to choose from for each source:

    in_vocabulary, generated and survivors (numbers of candidates), expected_generated, expected_survives,
    expected_distance (of an expected form that survives), expected_status, top_candidates (the nearest, by distance and
    then as they came up) and failure (null where the prediction is as expected). Candidates are made and compared once
    for each distinct word, on the cluster.
    """
    keyed = pairs.withColumn("__w", F.lower("source")).withColumn("__e", F.lower("expected"))
    known = vocabulary.select(F.lower("word").alias("word")).distinct()
    words = keyed.select(F.col("__w").alias("word")).distinct()
    found = word_candidates(words.join(known, "word", "left_anti"), rules, longest, cutoff)
    alive = in_vocabulary(found, vocabulary).withColumn("distance", dld("word", "candidate"))
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("generated"))
    best = nearest(alive, ["word"], top).groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate", "distance"))), lambda x: F.struct(x["candidate"], x["distance"])).alias("top_candidates"))
    of_word = words.join(known.withColumn("in_vocabulary", F.lit(True)), "word", "left").join(by_merge(counts), "word", "left").join(by_merge(alive.groupBy("word").agg(F.count(F.lit(1)).alias("survivors"))), "word", "left").join(by_merge(best), "word", "left")
    forms = lambda df, name: df.select(F.col("word").alias("__w"), F.lower("candidate").alias("__e")).distinct().withColumn(name, F.lit(True))
    joined = keyed.join(by_merge(of_word.withColumnRenamed("word", "__w")), "__w", "left").join(by_merge(forms(found, "expected_generated")), ["__w", "__e"], "left").join(by_merge(forms(alive, "expected_survives")), ["__w", "__e"], "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_vocabulary", "expected_generated", "expected_survives")}).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("generated", "survivors")})
    filled = filled.withColumn("expected_distance", F.when(F.col("expected_survives"), dld("__w", "__e")))
    far = F.lit(False) if max_distance is None else F.col("expected_distance") > max_distance
    status = F.when(F.col("in_vocabulary") & (F.col("__e") == F.col("__w")), "input_in_vocabulary").when(~F.col("expected_generated"), "absent_from_generated_candidates").when(~F.col("expected_survives"), "filtered_by_vocabulary").when(far, "distance_gated").otherwise("available")
    why = failure_type(*[F.col(c) for c in ("source", "expected", "prediction", "in_vocabulary", "expected_generated", "expected_survives", "survivors", "expected_distance")], max_distance)
    return filled.withColumn("expected_status", status).withColumn("failure", why).drop("__w", "__e")


def failure_type(source: Column, expected: Column, prediction: Column, known: Column, generated: Column, survives: Column, survivors: Column, distance: Column, max_distance: int | None = 2) -> Column:
    """Why a prediction is not what was expected; null where it is. The first reason that fits counts.

    known: the source is in the vocabulary; generated, survives: the expected form is a candidate, and in the
    vocabulary; survivors: how many candidates are; distance: from source to expected.
    """
    gated = survives & (F.lit(False) if max_distance is None else distance > max_distance)
    spaced = F.contains(expected, F.lit(" ")) & ~generated
    same = prediction == source
    shared = F.when(gated, "expected_candidate_distance_gated").when(spaced, "multi_token_unsupported").when(generated & ~survives, "expected_candidate_filtered_out").when(~generated, "expected_candidate_not_generated").when(survivors == 0, "no_candidate")
    return (
        F.when(prediction == expected, F.lit(None).cast("string"))
        .when((F.lower(source) == F.lower(expected)) & ~same, "false_positive")
        .when(same & known, "input_already_in_vocabulary")
        .otherwise(F.coalesce(shared, F.when(same, "normalizer_made_no_change").otherwise("wrong_candidate_ranking")))
    )
