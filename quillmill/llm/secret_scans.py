"""Secret scans over every version of a corpus, with a ledger of what has been scanned.

A text is known by its content address, the SHA-256 of its UTF-8, whatever paths and versions carry it. The ledger is a
Parquet table in the cluster's shared folder with a row for each blob and scan: the rules that the scan applied, each
with its version, and what they found. A scan takes from the versions given only the pairs of blob and rule version that
no row of the ledger has: a copy, an old version or a rename costs nothing, and a rule of a new version is applied alone.
Findings are joined back from blobs to all the paths that carry them.

Addresses travel alone (a few dozen bytes a row) until it is known which row of each blob is to be read; only the texts
of those rows are joined, by address and row, so that no group of copies meets in one task.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, remove_folder, shared_folder, slices, table


class Rule(NamedTuple):
    """Matches are leftmost and do not overlap; those whose group has fewer than `least` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def either(word: str) -> str:
    """A pattern for an ASCII word in either case; the flag for that would let other scripts' letters pass."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
#: In the order in which findings of one start are listed. The first three are the base.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # A run of fewer characters can't hold a longer one, so that the bounds may stand in the patterns.
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url", r"://[^\x20\x09-\x0D/:@]{1,99}:[^\x20\x09-\x0D/@]{1,99}@"),
)
BASE = ("assign", "access", "hex")

LEDGER = "blob binary, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"
_FOUND = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def spans(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """(rule, start, end) of all that the rules find in a text, in code points, end exclusive."""
    return [(rule.name, m.start(), m.end()) for rule, pattern in rules for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class Ledger:
    """What has been scanned, in a folder of the cluster's shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        """All rows so far; none where the folder does not exist yet."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.folder)

    def due(self, blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """blob, place, rules: what to scan. blobs: blob, place, any number of rows of a blob, of which the one with the
        least place is to be read."""
        done = self.rows().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        wanted = F.array(*[F.lit(r.name) for r in rules])
        missing = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
        firsts = blobs.groupBy("blob").agg(F.min("place").alias("place"))
        return firsts.join(done, "blob", "left").select("blob", "place", missing.alias("rules")).where(F.size("rules") > 0)

    def scan(self, versions: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what the ledger does not have of versions (the columns `keys` and text) and gives the addresses of all
        rows (keys and blob), held.

        One append a scan: a job that fails leaves the ledger as it was, and what it would have scanned stays due.
        """
        place = F.xxhash64(*keys)
        paths = hold(versions.select(*keys, place.alias("place"), address(F.col("text")).alias("blob")))
        due = self.due(paths, rules).select(F.col("blob").alias("d_blob"), F.col("place").alias("d_place"), F.col("rules").alias("d_rules"))
        texts = versions.select(place.alias("place"), address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        found = texts.join(due, (F.col("blob") == F.col("d_blob")) & (F.col("place") == F.col("d_place"))).select("blob", F.col("d_rules").alias("rules"), "text").mapInArrow(_scanner(rules), LEDGER)
        # Rows that share keys and text share a place; one of them is enough.
        found.dropDuplicates(["blob"]).write.mode("append").parquet(self.folder)
        return paths.select(*keys, "blob")

    def findings(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """paths (with a column blob) and `findings`: kind, start, end of all that rules of these versions found in its
        blob, by start, then in the order of the rules."""
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
        each = self.rows().select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin([r.name for r in rules]))
        row = F.struct(F.col("f.start").alias("start"), order[F.col("f.rule")].alias("at"), F.split_part("f.rule", F.lit("@"), F.lit(1)).alias("kind"), F.col("f.end").alias("end"))
        by_blob = each.groupBy("blob").agg(F.array_sort(F.collect_set(row)).alias("found"))
        listed = F.transform(F.coalesce("found", F.array().cast("array<struct<start:int,at:int,kind:string,end:int>>")), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        return paths.join(by_blob, "blob", "left").withColumn("findings", listed).drop("found")


def _scanner(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {r.name: (r, re.compile(r.pattern)) for r in rules}
        for batch in batches:
            for part in slices(batch, 512):
                wanted = part.column("rules").to_pylist()
                found = [[{"rule": n, "start": a, "end": b} for n, a, b in spans(text, [own[x] for x in names])] for names, text in zip(wanted, part.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("blob"), part.column("rules"), pa.array(found, _FOUND)], names=["blob", "rules", "findings"])

    return run


def joined(findings: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scans(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs (doc_id, text; more columns are ignored): doc_id, findings and blob, after a scan of what
    the ledger in the folder does not have yet.

    Null texts count as empty and have no findings; equal texts have equal findings; repeated rows and rows without
    doc_id have a row each; an empty table gives an empty result.
    """
    ledger = Ledger(docs.sparkSession, folder)
    return ledger.findings(ledger.scan(docs.select("doc_id", "text"), ["doc_id"], rules), rules)


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    found = secret_scans(table(spark, sf_dir, "documents"), folder)
    of = lambda *kinds: F.filter("findings", lambda x: x["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(of(*BASE)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove_folder(spark, folder)


def _oracle() -> str:
    """Matches alternate with what lies between them, so that running lengths say where each begins."""
    each = []
    for at, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        each.append(f"SELECT k, {at} AS o, '{r.kind}' AS kind, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g, '{pattern}' AS p, {r.group} AS grp, {r.least} AS least FROM d")
    some = " UNION ALL ".join(f"SELECT k, o, kind, a, b FROM e WHERE o = {at} AND length(regexp_extract(x, '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.group})) >= {r.least}" for at, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(each)}),
e AS (SELECT k, o, kind, m[i] AS x, (list_sum(list_transform(g[:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[:i - 1], lambda y: length(y))), 0))::BIGINT AS a, a + length(m[i]) AS b FROM (SELECT k, o, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM m)),
s AS ({some}),
f AS (SELECT k, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
string_agg(concat_ws(':', kind, a, b), ',' ORDER BY a, o) FILTER (WHERE o < 3) AS base, string_agg(concat_ws(':', kind, a, b), ',' ORDER BY a, o) AS spans FROM s GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (k)
"""


QUERIES = {"op12_secret_scans": op12_secret_scans}
ORACLES = {"op12_secret_scans": _oracle()}
