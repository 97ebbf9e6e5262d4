"""Scalar text functions as Catalyst expressions. Offsets are code points, from 0, ends excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Character classes and patterns of the text model.
# Word characters are letters, numbers of any kind and the underscore; \w means different things in different engines.
WORD_CHAR = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
URL = r"(?i:https?://|ftp://|www\.)\S+"
EMAIL = r"(?i)[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"
#: One correction token: a URL, a grouped or decimal number, a slashed form, a word with apostrophes and hyphens, a mark.
TOKEN = (
    r"""(?i:https?://)[^\s<>\[\]{}"“”]+"""
    r"|(?:\p{Nd}{1,3}(?:,\p{Nd}{3})+(?:\.\p{Nd}+)?|\p{Nd}+(?:[.,/]\p{Nd}+)+)"
    r"|[\p{L}\p{N}_]+(?:/[\p{L}\p{N}_]+)+"
    r"|[\p{L}\p{N}_]+(?:[’'][\p{L}\p{N}_]+)*(?:[-‐‑][\p{L}\p{N}_]+(?:[’'][\p{L}\p{N}_]+)*)*"
    r"|[^\p{L}\p{N}_\s]"
)
#: A word with apostrophes and hyphens; letters alone; a letter with what follows of letters and marks.
LEXICAL_WORD = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*(?:[-‐‑][\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*)*"
ALPHA_WORD = r"\p{L}+"
WORD_LETTERS = r"\p{L}[\p{L}\p{M}]*"
#: Function words that duplicate diagnostics set apart from content words.
FUNCTION_WORDS = (
    "ang ng sa na ay at mga si ni nina kina kay para upang kung kapag dahil pero ngunit o or na rin din pa raw daw ito iyon iyan "
    "dito diyan doon rito roon siya sila kami tayo kayo nila niya namin natin inyong kanilang with the a an of to in for on from "
    "by and is are was were be been being that this these those as than then but if while when where who whom whose which what "
    "not no yes its their his her our your my me him them we they he she it you i"
).split()


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def blank(text: Column | str) -> Column:
    """True for null and for text of white space alone."""
    return F.coalesce(F.length(F.regexp_replace(_c(text), r"(?U)\s+", "")) == 0, F.lit(True))


def collapsed(text: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def form_key(text: Column | str) -> Column:
    """The key of a whole form: collapsed and in lower case (lower case where case folding would differ for a few letters)."""
    return F.lower(collapsed(text))


def space_words(text: Column | str) -> Column:
    """The words between white space."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column | str) -> Column:
    return F.size(space_words(text)).cast("long")


def tokens(text: Column | str) -> Column:
    """The correction tokens; every character but white space lies in one."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(f"({TOKEN})"), 1)


def gaps(text: Column | str) -> Column:
    """The white space before each token; what follows the last token is trailing_gap."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(rf"(\s*)({TOKEN})"), 1)


def trailing_gap(text: Column | str) -> Column:
    """What follows the last token."""
    return F.regexp_extract(F.coalesce(_c(text), F.lit("")), r"(\s*)\z", 1)


def reconstruct(gap: Column, token: Column, trailing: Column) -> Column:
    """The text that tokens and gaps came from."""
    return F.concat(F.array_join(F.zip_with(gap, token, lambda g, t: F.concat(g, t)), ""), trailing)


def lexical_words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(f"({LEXICAL_WORD})"), 1)


def letter_words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(f"({WORD_LETTERS})"), 1)


def is_lexical(token: Column | str) -> Column:
    return _c(token).rlike(r"[\p{L}\p{N}]")


def is_function_word(token: Column | str) -> Column:
    return F.lower(_c(token)).isin(*FUNCTION_WORDS)


def has_adjacent_repeat(words: Column) -> Column:
    """Whether a word equals the one before it, case aside."""
    folded = F.transform(words, lambda w: F.lower(w))
    return F.when(F.size(folded) > 1, F.exists(F.zip_with(F.slice(folded, F.lit(1), F.size(folded) - 1), F.slice(folded, F.lit(2), F.size(folded) - 1), lambda a, b: a == b), lambda x: x)).otherwise(F.lit(False))


def with_case_of(source: Column, suggestion: Column) -> Column:
    """The suggestion in the case of the source: all upper, first upper, or as it is."""
    first = F.substr(source, F.lit(1), F.lit(1))
    upper_first = F.concat(F.upper(F.substr(suggestion, F.lit(1), F.lit(1))), F.substr(suggestion, F.lit(2)))
    all_upper = (source == F.upper(source)) & (source != F.lower(source))
    return F.when(all_upper, F.upper(suggestion)).when((first == F.upper(first)) & (first != F.lower(first)), upper_first).otherwise(suggestion)


def spliced(text: Column, edits: Column) -> Column:
    """The text with edits (start, end, replacement; sorted, none overlapping) put in from right to left."""
    return F.aggregate(F.reverse(edits), text, lambda t, e: F.concat(F.substr(t, F.lit(1), e["start"]), e["replacement"], F.substr(t, e["end"] + 1)))


def first_fitting(edits: Column) -> Column:
    """Of sorted edits those that neither overlap the one kept before nor start where it does."""
    kind = "array<struct<start:int,end:int,replacement:string>>"
    state = F.struct(F.array().cast(kind).alias("kept"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    return F.aggregate(
        edits,
        state,
        lambda a, e: F.when((e["start"] < a["end"]) | (e["start"] == a["start"]), a).otherwise(F.struct(F.concat(a["kept"], F.array(e)).alias("kept"), e["start"].alias("start"), e["end"].alias("end"))),
        lambda a: a["kept"],
    )


def percent_encoded(text: Column | str) -> Column:
    """Percent encoding that leaves letters, digits and -_.~ alone."""
    return F.replace(F.replace(F.replace(F.url_encode(_c(text)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decoded(text: Column | str) -> Column:
    """The way back; null for a malformed escape."""
    return F.try_url_decode(F.replace(_c(text), F.lit("+"), F.lit("%2B")))


def utf16_offset(text: Column, offset: Column) -> Column:
    """A code-point offset as an offset in UTF-16 units."""
    return (F.octet_length(F.encode(F.substr(text, F.lit(1), offset), "UTF-16BE")) / 2).cast("int")


def first_words(text: Column | str, limit: int) -> Column:
    """The text up to its limit-th word, and all of it if it has no more."""
    found = F.regexp_extract(_c(text), rf"(?U)\A(\s*(?:\S+\s+){{{limit - 1}}}\S+)", 1)
    return F.when(F.size(space_words(text)) > limit, found).otherwise(_c(text))


def with_duplicate(text: Column, start: Column, end: Column) -> Column:
    """The text with the token at (start, end) said twice."""
    token = F.substr(text, start + 1, end - start)
    return F.concat(F.substr(text, F.lit(1), end), F.lit(" "), token, F.substr(text, end + 1))


def length_bucket(n_words: Column) -> Column:
    """short up to 15 words, long from 25, null between."""
    return F.when(n_words <= 15, "short").when(n_words >= 25, "long")


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    """Whether (start, end) overlaps any of the spans."""
    return F.exists(spans, lambda s: (start < s["end"]) & (end > s["start"]))


def canonical_type(name: Column | str) -> Column:
    """A category name in lower case with underscores, without a plural s."""
    plain = F.regexp_replace(F.lower(collapsed(name)), r"[\s-]+", "_")
    return F.when(plain.endswith("s") & ~plain.endswith("ss") & (F.length(plain) > 3), F.substr(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain)


def alpha_words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(f"({ALPHA_WORD})"), 1)


def containing(start: Column, end: Column, spans: Column) -> Column:
    """The index of the first of the spans that holds (start, end) whole, from 0; null if none does."""
    at = F.array_position(F.transform(spans, lambda s: (start >= s["start"]) & (end <= s["end"])), True)
    return F.when(at > 0, (at - 1).cast("int"))


def with_row_key(df: DataFrame, name: str, keys: list[str], text: str, tasks: int | None = None) -> DataFrame:
    """df with a key of each row of its own, as JSON: the given keys, a hash of the text, and a number among rows that have both.

    So rows that share a key, and rows without one, are all there and told apart. With tasks the rows are dealt to so many
    for it, which is not reduced: texts are few bytes and much work.
    """
    tie = F.xxhash64(text)
    own = df.withColumn("__tie", tie)
    own = own if tasks is None else own.repartition(tasks, *keys, "__tie")
    number = F.row_number().over(Window.partitionBy(*keys, "__tie").orderBy("__tie"))
    return own.withColumn(name, F.to_json(F.struct(*keys, F.col("__tie").alias("tie"), number.alias("copy")))).drop("__tie")
