"""Documents, their suggestions, and what users decide, as tables that are rewritten by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, word_count

UNTITLED = "Untitled"


def created(requests: DataFrame, first_id: int) -> DataFrame:
    """documents of requests (seq, title, content, at): ids from first_id in the order of seq."""
    order = F.row_number().over(Window.orderBy("seq"))  # one batch of requests
    content = F.coalesce("content", F.lit(""))
    return requests.select((order + first_id - 1).cast("long").alias("id"), F.coalesce("title", F.lit(UNTITLED)).alias("title"), content.alias("content"), word_count(content).alias("word_count"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"))


def updated(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """documents after changes (id, title, content, at; null where not given; one row an id), with analyze: the content was given."""
    c = changes.select(F.col("id").alias("c_id"), F.col("title").alias("c_title"), F.col("content").alias("c_content"), F.col("at").alias("c_at"))
    content = F.coalesce("c_content", "content")
    joined = documents.join(c, F.col("id") == F.col("c_id"), "left")
    return joined.select("id", F.coalesce("c_title", "title").alias("title"), content.alias("content"), F.when(F.col("c_content").isNotNull(), word_count(content)).otherwise(F.col("word_count")).alias("word_count"), "created_at", F.coalesce("c_at", "updated_at").alias("updated_at"), F.col("c_content").isNotNull().alias("analyze"))


def recent(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("updated_at"), F.desc("id"))


def suggestion_type(source: str = "source") -> F.Column:
    """How the store names a source: normalizations by category, the rest grammar."""
    return F.when(F.col(source) == "normalization", "normalization:spelling_variation").otherwise("grammar")


def replaced(suggestions: DataFrame, documents: DataFrame, fresh: DataFrame) -> DataFrame:
    """suggestions with those of documents (id, content) replaced by fresh ones; a blank document has none."""
    own = documents.select(F.col("id").alias("document_id"), blank("content").alias("blank"))
    kept = suggestions.join(own.select("document_id"), "document_id", "left_anti")
    new = fresh.join(own.where("NOT blank").select("document_id"), "document_id", "left_semi")
    return kept.unionByName(new)


def decided(suggestions: DataFrame, events: DataFrame) -> DataFrame:
    """suggestions (id, accepted, ignored) after events (seq, suggestion_id, action accept or ignore): the last one of each id counts. Events of unknown ids do nothing."""
    last = events.where(F.col("action").isin("accept", "ignore")).groupBy(F.col("suggestion_id").alias("s_id")).agg(F.max_by("action", "seq").alias("action"))
    joined = suggestions.join(last, F.col("id") == F.col("s_id"), "left")
    flag = lambda action, old: F.when(F.col("action").isNull(), F.col(old)).otherwise(F.col("action") == action)
    return joined.withColumn("accepted", flag("accept", "accepted")).withColumn("ignored", flag("ignore", "ignored")).drop("s_id", "action")


def analytics(suggestions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of suggestions (type, accepted, ignored) and the quality score, by keys or as one row."""
    normal, grammar = F.col("type").startswith("normalization"), F.col("type") == "grammar"
    kind = lambda name: F.count_if(F.col("type") == f"normalization:{name}")
    sums = suggestions.groupBy(*(keys or [])).agg(
        kind("slang").alias("slang"),
        kind("abbreviation").alias("abbreviation"),
        kind("spelling_variation").alias("spelling_variation"),
        F.count_if(normal).alias("normalization_total"),
        F.count_if(grammar).alias("grammar_found"),
        F.count_if(grammar & F.col("accepted")).alias("grammar_fixed"),
        F.count_if(grammar & F.col("ignored")).alias("grammar_ignored"),
        (F.count(F.lit(1)) - F.count_if((normal | grammar) & F.col("accepted")) - F.count_if((normal | grammar) & F.col("ignored"))).alias("unresolved"),
    )
    return sums.withColumn("quality_score", F.greatest(F.lit(0), 100 - 5 * F.col("unresolved")))


def session_counters(events: DataFrame) -> DataFrame:
    """session, shown, accepted and ignored counts of normalization and of all else, which counts as grammar. events: session, type, action."""
    normal = F.col("type") == "norm"
    return events.groupBy("session").agg(*[F.count_if(who & (F.col("action") == action)).alias(f"{name}_{action}") for name, who in (("normalization", normal), ("grammar", ~normal)) for action in ("show", "accept", "ignore")])


def legacy_view(analyzed: DataFrame) -> DataFrame:
    """analyzed (original, normalized, suggestions) with grammar: grammar suggestions only where normalization changed nothing."""
    return analyzed.withColumn("grammar", F.when(F.col("original") == F.col("normalized"), F.filter("suggestions", lambda s: s["source"] != "normalization")))


def deleted(documents: DataFrame, suggestions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents and suggestions without the documents of ids (id) and without suggestions that have no document."""
    left = documents.join(ids.select("id").distinct(), "id", "left_anti")
    return left, suggestions.join(left.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi")


def file_name(title: F.Column | str) -> F.Column:
    """The name under which a document is saved: its title without what file systems refuse."""
    named = F.when(blank(title), F.lit(UNTITLED)).otherwise(F.btrim(F.col(title) if isinstance(title, str) else title))
    plain = F.btrim(F.regexp_replace(named, r'[<>:"/\\|?*\x00-\x1F]', ""))
    return F.concat(F.when(plain == "", F.lit(UNTITLED)).otherwise(plain), F.lit(".txt"))
