"""From documents to packed training sequences: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Its result is written as Parquet and read again as the
next stage's docs; all but the last return the columns of documents, also columns that bear names the operators use.
"""

from __future__ import annotations

import atexit
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.common import holding, remove_folder, shared_folder, table
from quillmill.llm.ngram_join import one_of_each
from quillmill.llm.packing import pack_documents
from quillmill.llm.quality_rules import keep_good
from quillmill.llm.toxicity import keep_civil


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the fences of their language and source let through.

    Null and empty texts go, as all texts under 20 words; equal rows stay or go together; no rows give no rows.
    """
    return keep_good(docs)


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not call toxic.

    Null and empty texts stay; equal texts stay or go together; without labels of both kinds, and without rows, all stay.
    """
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that links of 0.75 or more hold together.

    Null and empty texts and rows without doc_id link with nothing and stay; of rows with one doc_id and one text one
    stays, and of equal texts that with the smallest doc_id.
    """
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their places in sequences of 2048 ids.

    A null or empty text is one piece of one id; repeated rows are packed as often as they occur.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("toxicity", civility), ("near_duplicates", near_duplicates), ("packing", packing)]
#: A trained classifier and a tokenizer stand between documents and the result, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what lies between them is kept in the cluster's shared folder.

    A stage's folder is removed when the next has been written, and the last one, which the result reads, when the
    driver ends. What a stage held is let go of when it has been written.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    before = None
    for name, stage in STAGES[:-1]:
        with holding():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove_folder(spark, folder)
