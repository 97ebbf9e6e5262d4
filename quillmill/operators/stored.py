"""Tables of documents and suggestions that change a few documents at a time.

A table is Parquet, partitioned by a hash bucket of its document. A change reads and rewrites the buckets of the
documents it names, by Spark's dynamic partition overwrite; all others keep their files. What is written is staged first,
as a job can't overwrite what it reads, and a change that fails before its last step leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, word_count

BUCKET = "__bucket"


class Stored:
    """A table in a folder, its rows kept by the document that `key` names. Rows without a document share a bucket."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 256):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """The table anew; refused where there is one."""
        rows.withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(self.folder)
        # A bucket that never has rows says what columns there are when no other is left.
        rows.limit(0).write.parquet(f"{self.folder}/{BUCKET}=-1")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.folder).drop(BUCKET)

    def change(self, documents: DataFrame, fresh: DataFrame | None = None) -> None:
        """Takes out the rows of documents (a column named as the key) and puts in fresh ones, which belong to these
        documents or to new ones."""
        named = documents.select(self.key)
        named = (named if fresh is None else named.unionByName(fresh.select(self.key))).distinct()
        # At most as many numbers as there are buckets.
        touched = sorted(r[0] for r in named.select(self.bucket()).distinct().collect())
        if not touched:
            return
        whole = self.spark.read.parquet(self.folder)
        old = whole.where(F.col(BUCKET).isin(touched))
        gone = documents.select(F.col(self.key).alias("__gone")).distinct()
        kept = old.join(gone, F.col(self.key).eqNullSafe(F.col("__gone")), "left_anti")
        if fresh is not None:
            kept = kept.unionByName(fresh.withColumn(BUCKET, self.bucket()), allowMissingColumns=True)
        staged = f"{self.folder}.staged-{uuid.uuid4().hex}"
        try:
            kept.select(*whole.columns).repartition(BUCKET).write.partitionBy(BUCKET).parquet(staged)
            ready = self.spark.read.schema(whole.schema).parquet(staged)
            left = {r[0] for r in ready.select(BUCKET).distinct().collect()}
            ready.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.folder)
            for bucket in set(touched) - left:
                self._remove(f"{self.folder}/{BUCKET}={bucket}")
        finally:
            self._remove(staged)

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def put_documents(documents: Stored, suggestions: Stored, changed: DataFrame, fresh: DataFrame) -> None:
    """New or changed documents (id, title, content, updated_at) with their words counted anew, and their suggestions
    (document_id and more) in place of what they had; a blank document has none."""
    counted = changed.withColumn("word_count", word_count("content"))
    ids = changed.select("id").distinct()
    documents.change(ids, counted)
    own = changed.where(~blank("content")).select(F.col("id").alias("__own"))
    suggestions.change(ids.select(F.col("id").alias("document_id")), fresh.join(own, F.col("document_id") == F.col("__own"), "left_semi"))


def drop_documents(documents: Stored, suggestions: Stored, ids: DataFrame) -> None:
    """Documents (id) and their suggestions taken out."""
    documents.change(ids)
    suggestions.change(ids.select(F.col("id").alias("document_id")))
