"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts the hashed n-grams of all rows that may be learned from, per language, and sums the counts by language
and block of buckets, so that no task sees more than one block. The log-probability matrix (languages x buckets, a fixed
number of buckets) is broadcast in slices of LANGS_EACH languages, 16 MB each. Scoring turns a batch of texts into a
sparse count matrix in numpy (row, bucket, count), multiplies it with each slice and carries the best language and the
sum of all odds along, so that any number of languages is compared exactly; a worker keeps KEPT slices in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, hold, map_texts, table

ORDERS = (1, 2, 3)
BITS = 15
SMOOTHING = 0.5
#: Log odds per n-gram overstate what overlapping n-grams tell; the score spreads them over this many.
OVERLAP = 6.0
#: Languages in one slice of the model, and slices that a worker keeps.
LANGS_EACH, KEPT = 64, 4
#: Code points that are hashed at once.
CHUNK = 1 << 20
LETTERS = regex.compile(r"\P{L}+")
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"
BLOCK = 1 << 12


def chunks(texts: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """Groups of about CHUNK code points of (row, stretch, starts): n-grams begin in the first `starts` places of a stretch.

    Case is folded and what lies between letters becomes one space. A longer text is cut into stretches that overlap
    by what an n-gram needs, so that each of its n-grams begins in one of them.
    """
    group, held = [], 0
    for row, text in enumerate(texts):
        folded = " " + LETTERS.sub(" ", text.lower()).strip() + " "
        for start in range(0, len(folded), CHUNK):
            stretch = folded[start : start + CHUNK + max(ORDERS) - 1]
            if held and held + len(stretch) > CHUNK:
                yield group
                group, held = [], 0
            group.append((row, stretch, min(CHUNK, len(folded) - start)))
            held += len(stretch)
    if group:
        yield group


def buckets(group: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram of a group of chunks()."""
    lengths = np.array([len(x) for _, x, _ in group], np.int64)
    codes = np.frombuffer("".join(x for _, x, _ in group).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    stretch = np.repeat(np.arange(len(group)), lengths)
    place = np.arange(len(codes)) - (np.cumsum(lengths) - lengths)[stretch]
    may = place < np.array([n for _, _, n in group], np.int64)[stretch]
    left = lengths[stretch] - place
    rows = np.array([r for r, _, _ in group], np.int64)[stretch]
    out_rows, out = [], []
    hashed = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: len(codes) - n + 1] = codes[n - 1 :] if n <= len(codes) else 0
        hashed = (hashed + shifted + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
        if n in ORDERS:
            inside = may & (left >= n)
            out_rows.append(rows[inside])
            out.append(((hashed[inside] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out_rows), np.concatenate(out)


def learn(docs: DataFrame) -> list[tuple[list[str], np.ndarray]]:
    """Slices of the model: languages in order, and their log-probability matrix with the log priors as last column.

    docs: lang and text of the rows to learn from; rows with a null text or language teach nothing.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                own = totals.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                own[-1] += len(group)
                for chunk in chunks(group["text"].tolist()):
                    own[:-1] += np.bincount(buckets(chunk)[1], minlength=1 << BITS)
            if len(totals) > LANGS_EACH:
                yield from sums(totals)
                totals = {}
        yield from sums(totals)

    def sums(totals: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, own in totals.items():
            blocks = [own[i : i + BLOCK] for i in range(0, len(own), BLOCK)]
            yield pd.DataFrame({"lang": lang, "block": range(len(blocks)), "counts": blocks})

    parts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInPandas(count, "lang string, block int, counts array<long>")
    each = parts.select("lang", "block", F.posexplode("counts").alias("at", "n")).where("n > 0").groupBy("lang", "block", "at").agg(F.sum("n").alias("n"))
    cells = hold(each.select("lang", (F.col("block") * BLOCK + F.col("at")).alias("cell"), "n"))
    # The last cell counts a language's texts.
    texts = {r["lang"]: r["n"] for r in cells.where(F.col("cell") == 1 << BITS).select("lang", "n").collect()}
    langs, total = sorted(texts), sum(texts.values()) + len(texts)
    out = []
    for start in range(0, len(langs), LANGS_EACH):
        own = langs[start : start + LANGS_EACH]
        got = cells.where(F.col("lang").isin(own) & (F.col("cell") < 1 << BITS)).toArrow()
        counts = np.zeros((len(own), 1 << BITS))
        index = np.searchsorted(np.array(own, object), np.array(got.column("lang").to_pylist(), object)) if got.num_rows else np.zeros(0, np.int64)
        counts[index, got.column("cell").to_numpy()] = got.column("n").to_numpy()
        grams = counts + SMOOTHING
        priors = np.log((np.array([texts[x] for x in own], np.float64) + 1) / total)
        out.append((own, np.hstack([np.log(grams / grams.sum(axis=1, keepdims=True)), priors[:, None]])))
    return out


def predict(texts: list[str | None], model: Callable[[], Iterator[tuple[list[str], np.ndarray]]]) -> tuple[list[str], np.ndarray]:
    """The language of each text and its score: the posterior with the log odds spread over OVERLAP. model() gives the slices."""
    answers, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    cells = []
    for chunk in chunks([texts[i] for i in known]):
        rows, cols = buckets(chunk)
        cells.append(np.unique(rows << BITS | cols, return_counts=True))
    best, odds, named = np.full(len(known), -np.inf), np.zeros(len(known)), [UNDETERMINED] * len(known)
    for langs, matrix in model():
        logs = np.zeros((len(known), len(langs)))
        for cell, n in cells:
            rows, cols = cell >> BITS, cell & ((1 << BITS) - 1)
            for k in range(len(langs)):
                logs[:, k] += np.bincount(rows, weights=n * matrix[k, cols], minlength=len(known))
        logs = logs / OVERLAP + matrix[:, -1]
        at = logs.argmax(axis=1) if len(known) else np.zeros(0, np.int64)
        top = logs[np.arange(len(known)), at]
        higher = np.maximum(best, top)
        odds = odds * np.exp(best - higher) + np.exp(logs - higher[:, None]).sum(axis=1)
        for i in np.flatnonzero(top > best).tolist():
            named[i] = langs[at[i]]
        best = higher
    for i, lang, share in zip(known, named, odds.tolist(), strict=True):
        if share:
            answers[i], scores[i] = lang, 1 / share
    return answers, scores


def language_id(docs: DataFrame, train: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text; more columns are ignored): doc_id, lang_pred, score (0 to 1).

    train has text and lang; all of it is learned from. A text that is null or has no letter is `und` with score 0, and
    so is every text if nothing was learned. Ties go to the language that sorts first. Equal texts get equal answers, an
    empty table an empty result.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in learn(train)]

    def slices() -> Iterator[tuple[list[str], np.ndarray]]:
        for i, own in enumerate(shared):
            yield own.value
            if i >= KEPT:
                own.__dict__.pop("_value", None)  # read again from the executor's disk when its turn comes

    def run(texts: list[str | None]):
        answers, scores = predict(texts, slices)
        return None, {"lang_pred": answers, "score": scores}

    return map_texts(docs, ["doc_id"], {"lang_pred": "string", "score": "double"}, lambda: run)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id(docs, docs.where(~held_out("doc_id")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
