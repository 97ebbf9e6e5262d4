"""Texts of five megabytes, with and without spaces, through every operator."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmill.llm import bpe, chat_trees, fingerprints, language_id, ngram_join, packing, quality_rules, sharding, token_counts, toxicity

SIZE = 5_000_000


@pytest.fixture(scope="module")
def long(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(50_000)}" for _ in range(SIZE // 7)]
    spaced, unspaced = " ".join(words), "".join(r.choice("acgt") for _ in range(SIZE))
    rows = [(1, spaced, "en", "s"), (2, " ".join([*words[:-3], "x", "y", "z"]), "en", "s"), (3, unspaced, "de", "s"), (4, "a short text", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).cache()


def test_counts(long):
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(long).collect()}
    assert rows[1]["n_words"] == SIZE // 7 and rows[3]["n_words"] == 1 and rows[3]["word_chars"] == SIZE
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert {r["doc_id"]: r["n_words"] for r in token_counts.token_counts(long, path).collect()}[3] == 1
    assert {r["doc_id"]: r["size"] for r in sharding.shard_documents(long, sharding.even_tree(8), sharding.even_tree(9)).collect()}[3] == SIZE + 1


def test_ids(long):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = {r["doc_id"]: r["decoded_sha256"] for r in bpe.bpe_codec(long, path, public_tokenizers.PATTERN).collect()}
    assert decoded == {r["doc_id"]: r["s"] for r in long.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("s")).collect()}
    pieces = packing.pack_documents(long, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(pieces) == 4 and all(r["n"] == r["t"] for r in pieces)


def test_links_and_fingerprints(long):
    links = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.ngram_join(long).collect()}
    assert links == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    rows = {r["doc_id"]: r for r in fingerprints.document_fingerprints(long).collect()}
    assert rows[1]["near_next"] > 0.99 and abs(rows[3]["near_edited"] - 0.86) < 0.02 and rows[4]["near_next"] == 0


def test_models(spark, long):
    train = spark.createDataFrame([("the cat sat on the mat", "en"), ("acgt gtca", "de")], "text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(long, train).collect()}[3] == "de"
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, toxic int")
    assert toxicity.toxicity(long, labels).where("score BETWEEN 0 AND 1").count() == 4


def test_conversations(spark, long):
    """A turn of five megabytes, a conversation of many turns, and columns that bear the operator's names."""
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn <{i}>") for i in range(3000)]
    many = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    one = long.where("doc_id = 1").select(F.lit(2).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), "text")
    clash = many.unionByName(one).withColumns({c: F.lit("x") for c in ("node", "parent", "score", "leaf", "up", "branch", "position", "turns", "formatted", "loss_spans", "i")})
    read = {r["conv_id"]: r for r in chat_trees.read_back(chat_trees.format_trees(chat_trees.threads(clash))).collect()}
    assert [t["text"] for t in read[1]["turns"]] == [t[3] for t in turns]
    assert read[1]["loss_text"] == "".join(t[3] for t in turns if t[2] == "assistant")
    assert read[2]["loss_text"] == one.first()["text"]
