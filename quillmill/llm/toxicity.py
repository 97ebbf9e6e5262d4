"""Toxicity: a counterfactually regularised classifier.

A logistic regression over the words of a text and their beginnings, each counted once. Features enter scaled by their
log odds between the labels, shrunk towards the prior; what speaks for label 1 too weakly, or against it, is left out, so
that the many other words of a long text neither hide an insult nor add up to one. Besides fitting the labels, training
swaps the identity terms of labelled texts for each of the others of their kind and penalises the change of score: what
the model would learn from a group's name alone is pushed to be the same for every group and so to carry nothing, which
spares texts that merely mention one. The terms are a parameter, by language; texts without a term have no swaps, and
where no labelled text has one the model is a plain regression.

Training takes at most SAMPLE labelled rows of each label and SAMPLE_BYTES of their texts, those with the lowest hashes;
scoring covers every text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_texts, table, with_row

Kinds = tuple[tuple[str, ...], ...]
#: Identity terms by language and kind, in lower case; a term is swapped for the others of its kind.
IDENTITY: dict[str, Kinds] = {
    "en": (
        ("man", "woman", "boy", "girl"),
        ("men", "women", "boys", "girls"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "arab"),
        ("gay", "straight", "lesbian", "bisexual", "transgender"),
        ("immigrant", "native", "refugee", "foreigner"),
        ("immigrants", "natives", "refugees", "foreigners"),
    ),
    "de": (
        ("mann", "frau", "junge", "mädchen"),
        ("männer", "frauen", "jungen"),
        ("muslim", "christ", "jude", "hindu", "buddhist", "atheist"),
        ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
        ("schwarze", "weiße", "asiaten", "araber"),
        ("schwul", "lesbisch", "bisexuell", "transgender"),
        ("einwanderer", "einheimische", "flüchtling", "ausländer"),
    ),
    "fr": (
        ("homme", "femme", "garçon", "fille"),
        ("hommes", "femmes", "garçons", "filles"),
        ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
        ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
        ("noir", "blanc", "asiatique", "arabe"),
        ("gay", "lesbienne", "bisexuel", "transgenre"),
        ("immigré", "autochtone", "réfugié", "étranger"),
        ("immigrés", "autochtones", "réfugiés", "étrangers"),
    ),
    "es": (
        ("hombre", "mujer", "niño", "niña"),
        ("hombres", "mujeres", "niños", "niñas"),
        ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
        ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
        ("negro", "blanco", "asiático", "árabe"),
        ("gay", "lesbiana", "bisexual", "transgénero"),
        ("inmigrante", "nativo", "refugiado", "extranjero"),
        ("inmigrantes", "nativos", "refugiados", "extranjeros"),
    ),
}
BEGINNINGS = (4, 5)
TOKEN = re.compile(r"\w+")
SAMPLE = 4_000
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.7
#: Occurrences that the log odds are shrunk by, and how much of them is cut off.
PRIOR, CUT = 10.0, 0.7
EPOCHS = 200
RATE = 0.1
DECAY = 1e-3
#: Words that a worker remembers.
WORDS_KEPT = 200_000
#: Weight of the squared change of the log odds under a swap.
PENALTY = 1.0


def words_of(text: str | None) -> set[str]:
    """The distinct words, in lower case."""
    return set(TOKEN.findall(text.lower())) if text else set()


def features(word: str) -> list[str]:
    """The word and its beginnings, marked as such."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) >= k)]


def all_features(words: set[str]) -> set[str]:
    return {f for w in words for f in features(w)}


def swaps(identity: dict[str, Kinds]) -> dict[str, tuple[str, ...]]:
    """Each term and the others of its kind; a term of several languages has the others of all of them."""
    out: dict[str, tuple[str, ...]] = {}
    for kinds in identity.values():
        for kind in kinds:
            for i, term in enumerate(kind):
                out[term] = out.get(term, ()) + kind[i + 1 :] + kind[:i]
    return out


def swapped(words: set[str], others: dict[str, tuple[str, ...]]) -> list[set[str]]:
    """The words with every identity term replaced by the next of its kind, by the one after that, and so on."""
    terms = sorted(words & others.keys())
    rounds = max((len(others[t]) for t in terms), default=0)
    return [(words - others.keys()) | {others[t][k % len(others[t])] for t in terms} for k in range(rounds)]


def _sparse(rows: list[set[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.fromiter((x for r in rows for x in r), np.int64)


class Model:
    """Weights by feature, and the bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[str, ...]] = {}

    def of_word(self, word: str) -> tuple[str, ...]:
        """The features of the word that have a weight; remembered for WORDS_KEPT words."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            found = self.known[word] = tuple(f for f in features(word) if f in self.weights)
        return found

    def score(self, text: str | None) -> float:
        """The chance of label 1; a text without words has that of the bias."""
        found: set[str] = set()
        for own in map(self.of_word, words_of(text)):
            if own:
                found.update(own)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[str | None], labels: list[int], penalty: float = PENALTY, identity: dict[str, Kinds] = IDENTITY) -> Model:
    """The model of these rows. Both labels weigh alike. Full-batch steps, so the same rows give the same model.

    The loss is the mean over the labels of the mean log loss of their rows, plus DECAY / 2 times the mean square of the
    weights, plus penalty times the mean square of the change of the log odds over all swaps.
    """
    others = swaps(identity)
    y = np.array(labels, np.float64)
    ones, zeros = y.sum(), (1 - y).sum()
    if not ones or not zeros:
        return Model({}, -2.0 if zeros else 0.0)
    seen: dict[str, list[int]] = {}
    for text, label in zip(texts, labels, strict=True):
        for f in all_features(words_of(text)):
            seen.setdefault(f, [0, 0])[label] += 1
    share1, share0 = PRIOR * ones / len(y), PRIOR * zeros / len(y)
    odds = {f: float(np.log((n1 + share1) / share1 * share0 / (n0 + share0) * (zeros + PRIOR) / (ones + PRIOR) * ones / zeros)) for f, (n0, n1) in seen.items() if n0 + n1 > 2}
    scale = {f: x - CUT for f, x in sorted(odds.items()) if x > CUT}
    ids = {f: i for i, f in enumerate(scale)}
    x = np.array([*scale.values()])
    del seen, odds
    number = lambda words: {ids[f] for f in all_features(words) if f in ids}
    rows, pairs = [], []
    for text in texts:
        words = words_of(text)
        rows.append(number(words))
        pairs += [(rows[-1], number(other)) for other in swapped(words, others)]
    at, cols = _sparse(rows)
    plus_at, plus = _sparse([a - b for a, b in pairs])
    minus_at, minus = _sparse([b - a for a, b in pairs])
    share = np.where(y == 1, 0.5 / ones, 0.5 / zeros)
    w, bias = np.zeros(len(x)), 0.0
    squares, bias_squares = np.full(len(x), 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = np.bincount(at, weights=(w * x)[cols], minlength=len(y)) + bias
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = x * np.bincount(cols, weights=error[at], minlength=len(x)) + DECAY * w / max(1, len(x))
        if pairs:
            change = np.bincount(plus_at, weights=(w * x)[plus], minlength=len(pairs)) - np.bincount(minus_at, weights=(w * x)[minus], minlength=len(pairs))
            push = 2 * penalty * change / len(pairs)
            gradient += x * (np.bincount(plus, weights=push[plus_at], minlength=len(x)) - np.bincount(minus, weights=push[minus_at], minlength=len(x)))
        squares += gradient**2
        bias_squares += error.sum() ** 2
        w -= RATE * gradient / np.sqrt(squares)
        bias -= RATE * error.sum() / np.sqrt(bias_squares)
    return Model({f: float(v) for f, v in zip(ids, w * x, strict=True) if v}, float(bias))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> tuple[list[str | None], list[int]]:
    """Texts and labels to learn from: of each label the `sample` rows with the lowest hashes of their doc_id, but for
    those whose texts, in that order, do not fit what is left of half of `most` bytes.

    The sample is drawn from the labels before they meet the texts, so that its join is a broadcast of bounded size and
    no text is shuffled; lengths alone say what fits. Should doc_ids repeat, the same bounds hold after the join.
    """
    known = labels.where(~held_out("doc_id")).select(F.col("doc_id").alias("l_doc_id"), F.col("toxic").cast("int").alias("l_toxic"))
    drawn = [known.where(F.col("l_toxic") == label).orderBy(F.xxhash64("l_doc_id"), "l_doc_id").limit(sample) for label in (0, 1)]
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), F.col("doc_id") == F.col("l_doc_id"))
    sized = joined.withColumns({"tie": F.xxhash64("text"), "bytes": F.coalesce(F.octet_length("text"), F.lit(0))})
    order = [F.xxhash64("doc_id"), "doc_id", "tie"]
    light = sized.select("doc_id", "tie", "bytes", "l_toxic")
    first = [light.where(F.col("l_toxic") == label).orderBy(*order).limit(sample).collect() for label in (0, 1)]
    wanted = []
    for rows in first:
        held = 0
        for r in rows:
            # A text that does not fit costs itself alone; the rows after it still teach.
            if held + r["bytes"] <= most // 2:
                held += r["bytes"]
                wanted.append((r["doc_id"], r["tie"], r["l_toxic"]))
    if not wanted:
        return [], []
    chosen = F.broadcast(docs.sparkSession.createDataFrame(wanted, T.StructType([T.StructField("c_id", docs.schema["doc_id"].dataType), T.StructField("c_tie", T.LongType()), T.StructField("c_toxic", T.IntegerType())])).distinct())
    rows = sized.join(chosen, (F.col("doc_id") == F.col("c_id")) & (F.col("tie") == F.col("c_tie")) & (F.col("l_toxic") == F.col("c_toxic"))).orderBy("doc_id", "l_toxic", "tie").limit(2 * sample).select("text", "l_toxic").collect()
    return [r["text"] for r in rows], [r["l_toxic"] for r in rows]


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",), identity: dict[str, Kinds] = IDENTITY) -> DataFrame:
    """One row per row of docs (doc_id, text; more columns are ignored): the columns `keep`, score (0 to 1), predicted (1 from threshold on).

    labels has doc_id and toxic (0, 1; others are ignored); rows that are held out teach nothing. Null and empty texts
    score as the bias alone says. Equal texts score alike. Without labels of both kinds every text scores the same.
    Empty docs give an empty result.
    """
    model = fit(*sampled(docs, labels, sample), identity=identity)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def make():
        own = Model(*shared.value)

        def run(texts: list[str | None]):
            scores = [own.score(t) for t in texts]
            return None, {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return run

    return map_texts(docs, [*keep], {"score": "double", "predicted": "int"}, make)


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that toxicity does not predict to be toxic, with all their columns.

    Null and empty texts have no word that speaks for it and stay, repeated rows stay or go together, an empty table
    stays empty. Without labels of both kinds all rows stay.
    """
    return toxicity(with_row(docs, "doc_id", "text"), labels, keep=("__row",)).where("predicted = 0").select("__row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
