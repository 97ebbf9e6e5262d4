"""Edits of the older label set, as Catalyst expressions over arrays of tokens and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of the older set.
LOWER, UPPER, CAPITAL, CAPITAL_1 = (f"$TRANSFORM_CASE_{x}" for x in ("LOWER", "UPPER", "CAPITAL", "CAPITAL_1"))
PLURAL, SINGULAR = "$TRANSFORM_AGREEMENT_PLURAL", "$TRANSFORM_AGREEMENT_SINGULAR"
SPLIT_HYPHEN, VERB = "$TRANSFORM_SPLIT_HYPHEN", "$TRANSFORM_VERB_"
MERGE_HYPHEN, MERGE_SPACE, DELETE = "$MERGE_HYPHEN", "$MERGE_SPACE", "$DELETE"


def _after(tag: Column, prefix: str) -> Column:
    return F.substr(tag, F.lit(len(prefix) + 1))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def token_edit(token: Column, tag: Column, verbs: Column) -> Column:
    """What a tag makes of a token: a string whose spaces part tokens. Unknown tags and verbs leave it. verbs: map of token_form."""
    first = F.substr(token, F.lit(1), F.lit(1))
    made = (
        F.when(tag.startswith("$APPEND_"), F.concat(token, F.lit(" "), _after(tag, "$APPEND_")))
        .when(token == "$START", token)
        .when(tag.startswith("$REPLACE_"), _after(tag, "$REPLACE_"))
        .when(tag == DELETE, F.lit(DELETE))
        .when(tag.isin(MERGE_HYPHEN, MERGE_SPACE), F.concat(token, F.lit(" "), tag))
        .when(tag == LOWER, F.lower(token))
        .when(tag == UPPER, F.upper(token))
        .when(tag == CAPITAL, _capital(token))
        .when((tag == CAPITAL_1) & (F.length(token) > 1), F.concat(first, _capital(F.substr(token, F.lit(2)))))
        .when(tag == PLURAL, F.concat(token, F.lit("s")))
        .when(tag == SINGULAR, F.substr(token, F.lit(1), F.length(token) - 1))
        .when(tag == SPLIT_HYPHEN, F.replace(token, F.lit("-"), F.lit(" ")))
        .when(tag.startswith(VERB), F.try_element_at(verbs, F.concat(token, F.lit("_"), _after(tag, VERB))))
    )
    return F.coalesce(made, token)


def edited(tokens: Column, tags: Column, verbs: Column) -> Column:
    """The tokens after their tags; tokens without a tag stay. Merges and deletions act on the joined text."""
    text = F.array_join(F.zip_with(tokens, tags, lambda t, l: token_edit(t, l, verbs)), " ")
    for old, new in ((f" {MERGE_HYPHEN} ", "-"), (f" {MERGE_SPACE} ", ""), (f" {DELETE}", ""), (f"{DELETE} ", "")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.split(text, " ")
