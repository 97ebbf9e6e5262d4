"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z and nothing else.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: the session's spark.checkpoint.dir.

    Where that is unset, a folder of this machine is made if the session runs on this machine alone; on a cluster it is
    an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillmill-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns and `__row`, a struct of all of docs: what is computed beside it can't clash with a column's name."""
    return docs.select(*[F.col(c) for c in columns], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


#: Of each scope what lets go of what it holds, the outermost scope first.
_HELD: list[list[Callable[[], None]]] = [[]]


def hold(df: DataFrame) -> DataFrame:
    """df, kept on the executors' disks once it is computed, for what is read more than once.

    What a lost executor held is computed again from the source. What is held goes under a name of its own, so that no
    other query over the same path gets it, whatever the files there say by then. It is let go of at the end of the
    innermost holding(), or by release().
    """
    named = df.withColumn("__held", F.lit(uuid.uuid4().hex)).persist(StorageLevel.DISK_ONLY)
    _HELD[-1].append(named.unpersist)
    return named.drop("__held")


@contextmanager
def holding() -> Iterator[None]:
    """Lets go at its end of what was held or cut within it, and of nothing else; write results before that."""
    _HELD.append([])
    try:
        yield
    finally:
        _let_go(_HELD.pop())


def release() -> None:
    """Let go of what was held outside any holding(), or since the innermost one began. What comes of it can be computed
    again; what was cut there stays until Spark has no more use for it (see cut)."""
    _let_go(_HELD[-1])


def _let_go(held: list[Callable[[], None]]) -> None:
    while held:
        held.pop()()


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the cluster's shared folder, without what it came from: for loops.

    Within holding() its files go at the end of that. Outside, Spark's cleaner removes them once nothing refers to them,
    if the session was started with spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    spark = df.sparkSession
    shared_folder(spark)
    done = df.checkpoint()
    if len(_HELD) > 1:
        where = done._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if where.isDefined():
            folder = where.get()
            _HELD[-1].append(lambda: remove_folder(spark, folder))
    return done


def settled(df: DataFrame) -> DataFrame:
    """df if its rows come in one order whenever they are read, as those of files do; else cut, as what was shuffled may
    come in another order when a lost task runs again."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return cut(df) if re.search(r"\bExchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan) else df


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
_SPARK = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType()}


def slices(batch: pa.RecordBatch, rows: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of up to `rows` rows and about `most` bytes of text; a longer text is a part of its own."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + most, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(docs: DataFrame, keep: list[str], results: dict[str, str], make: Callable, rows: int = 512) -> DataFrame:
    """The columns `keep` as they are, and results (name: type) found from the texts, `rows` rows or a few MB at a time.

    make() is called once a task and gives a function from a list of texts (None for null) to (index, columns): the
    columns by name, and for each of their rows the index of its text, or None where text and row correspond. Ids
    never become Python numbers, so that nulls beside large ids cost no digits. Other columns of docs are ignored.
    """
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), *(T.StructField(n, _SPARK[k]) for n, k in results.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for batch in batches:
            for part in slices(batch, rows):
                index, found = own(part.column("text").to_pylist())
                kept = part if index is None else part.take(pa.array(index, pa.int64()))
                columns = [kept.column(c) for c in keep] + [pa.array(found[n], _ARROW[k]) for n, k in results.items()]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *results])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pieces_for(n: int, each: int, most: int = 1 << 20) -> int:
    """How many parts of about `each` rows n rows need."""
    return int(min(most, max(1, -(-int(n) // each))))


def ranked(df: DataFrame, keys: list[str], order: list, total: int, each: int = 50_000, name: str = "rank") -> DataFrame:
    """df with its rows numbered from 0 within each value of the keys, by any number of tasks.

    A hot key does not meet in one task: rows are dealt over blocks by a hash of the order columns (the leading 32 bits
    of a digest, so that other engines can say the same), numbered within (keys, block), and shifted by the counts of
    the blocks before. The order columns decide everything, so that a
    recomputed task gives the same numbers. df is read twice and should be cheap or cut.
    """
    blocks = pieces_for(total, each)
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]).cast("binary"))
    with_block = df.withColumn("__block", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int") if blocks > 1 else F.lit(0))
    from pyspark.sql import Window

    counts = with_block.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__block").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = with_block.withColumn("__at", F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(*order)) - 1)
    on = (inside["__block"] == shifts["__b"]) & _all(inside[k].eqNullSafe(shifts[f"__k_{k}"]) for k in keys)
    return inside.join(shifts, on).withColumn(name, (F.col("__shift") + F.col("__at")).cast("long")).drop("__block", "__at", "__b", "__shift", *[f"__k_{k}" for k in keys])


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def held_out(doc_id) -> "F.Column":
    """True for the third of the rows that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
