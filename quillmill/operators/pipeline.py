"""The whole of it: normalize, correct in passes, and suggest edits on the raw text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as al
from ..functions import text as tx
from .decoding import LabelProvider, TokenProvider, corrected, corrected_rows
from .normalization import normalize_documents

LONGEST_TEXT = 5000


def accepted_texts(docs: DataFrame, text: str = "text", most: int = LONGEST_TEXT) -> tuple[DataFrame, DataFrame]:
    """Rows whose text may be analyzed, and the others."""
    fits = F.coalesce(F.length(text) <= most, F.lit(True))
    return docs.where(fits), docs.where(~fits)


def analyze(docs: DataFrame, vocabulary: DataFrame, rules: Mapping[str, Mapping[str, float]] | DataFrame, curated: Mapping[str, tuple[str, str]] | DataFrame, provider: LabelProvider, passes: int = 5, key: str = "doc_id", text: str = "text", cutoff: int = 100) -> DataFrame:
    """key, original, normalized, corrected, suggestions. Key is unique; a null text counts as empty. cutoff: of a suffix's candidates, in normalization."""
    base = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    normal = normalize_documents(base, vocabulary, rules, curated, key, cutoff=cutoff)
    joined = corrected_rows(normal, provider, passes, "normalized") if isinstance(provider, TokenProvider) else normal.join(corrected(normal, provider, passes, key, "normalized"), key)
    edits = F.transform(
        F.coalesce("changes", F.array().cast(normal.schema["changes"].dataType)),
        lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["word"].alias("original"), c["suggestion"].alias("replacement"), F.lit("NORMALIZATION").alias("tag"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("int").alias("iteration")),
    )
    joined = joined.withColumn("edits", edits)
    return joined.select(key, F.col("text").alias("original"), "normalized", "corrected", al.suggestions("text", "normalized", "corrected", "edits", "passes").alias("suggestions"))


def reproduces(analyzed: DataFrame) -> Column:
    """Whether all suggestions put into the original give the corrected text."""
    cuts = F.transform("suggestions", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("replacement")))
    return tx.spliced(F.col("original"), cuts) == F.col("corrected")


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans (keys, start, end) with island: spans that overlap or touch share one, numbered from 1 in order."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.coalesce(F.col("start") > upto, F.lit(True)), 1).otherwise(0)
    return spans.withColumn("__opens", opens).withColumn("island", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def numbered(rows: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
    """rows (start, end) with id: their source and a number that counts within it, `gec-2`."""
    n = F.row_number().over(Window.partitionBy(*keys, source).orderBy("start", "end"))
    return rows.withColumn("id", F.concat_ws("-", source, n.cast("string")))


def latest_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, iteration, confidence: the last iteration and the highest confidence within it."""
    return hits.groupBy(*keys).agg(F.max("iteration").alias("iteration"), F.max_by("confidence", F.struct("iteration", "confidence")).alias("confidence"))


def source_of(normalized: Column, corrected_too: Column) -> Column:
    return F.when(normalized & corrected_too, "combined").when(normalized, "normalization").when(corrected_too, "gec")
