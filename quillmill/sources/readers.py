"""Sources: strict CSV with named columns, word lists, artifacts, JSON lines, archives, uploads, and checked files.

What a header says, and whether files are what they claim, is settled on the driver; rows are read by Spark.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank, canonical_type

# Accepted column names of evaluation files.
ALIASES = {
    "input": ("input", "source", "source_text", "text", "noisy_text", "original"),
    "target": ("target", "target_text", "reference", "gold", "expected"),
    "correction": ("gec_correction", "correction", "correction_tag", "correction_tags", "gec_tag", "expected_gec_tag", "generation_tag", "error_type"),
    "type": ("unnormalized_type", "normalization_type", "noise_type", "informal_type", "category"),
}
REQUIRED = ("input", "target")
BOM = "﻿"
LARGEST_UPLOAD = 5000


class SourceError(ValueError):
    """A source that is not what it has to be."""


def resolve(headers: Sequence[str], field: str, override: str | None = None) -> str | None:
    """The header that stands for a field: the named one, or the only one that has one of its aliases. Never a guess."""
    wanted = {override.strip().casefold()} if override is not None else {a.casefold() for a in ALIASES[field]}
    found = [h for h in headers if h.strip().casefold() in wanted]
    if len(found) > 1 or override is not None and not found:
        raise SourceError(f"{field}: {'several columns fit' if found else 'no column is named ' + repr(override)}; there are {', '.join(headers)}")
    if not found and field in REQUIRED:
        raise SourceError(f"no column for {field}; there are {', '.join(headers)}")
    return found[0] if found else None


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in the first line of a CSV file, checked: none empty, none twice in another case."""
    lines = spark.read.text(path, wholetext=False).limit(1).collect()
    if not lines:
        raise SourceError(f"{path} is empty")
    names = next(csv.reader(io.StringIO(lines[0][0].removeprefix(BOM)), strict=True))
    if not all(n.strip() for n in names):
        raise SourceError("a column has no name")
    if len({n.strip().casefold() for n in names}) < len(names):
        raise SourceError("two columns have one name")
    return names


def read_csv(spark: SparkSession, path: str, names: Sequence[str], has_header: bool = True) -> DataFrame:
    """All columns as strings, empty cells as empty strings; a ragged row or an open quote fails the read."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    raw = spark.read.schema(schema).csv(path, header=has_header, mode="FAILFAST", multiLine=True, encoding="UTF-8", escape='"', enforceSchema=True, nullValue="\0")
    return raw.na.fill("")


def evaluation_rows(spark: SparkSession, path: str, limit: int | None = None, **columns: str | None) -> DataFrame:
    """row_id, input, target, gec_correction, unnormalized_type, types, metadata of an evaluation CSV.

    Every row is checked before any is used, also with a limit: input and target must say something, and a row has at
    most one type, which is not `overall`. Columns that stand for nothing go into metadata.
    """
    names = header(spark, path)
    fields = {f: resolve(names, f, columns.get(f)) for f in ALIASES}
    if len({v for v in fields.values() if v}) < sum(v is not None for v in fields.values()):
        raise SourceError("one column stands for two fields")
    raw = read_csv(spark, path, names)
    extra = [n for n in names if n not in fields.values()]
    own = lambda f: F.col(f"`{fields[f]}`") if fields[f] else F.lit(None).cast("string")
    meta = F.create_map(*[x for n in extra for x in (F.lit(n), F.col(f"`{n}`"))]) if extra else F.create_map().cast("map<string,string>")
    numbered = numbered_rows(raw.select(own("input").alias("input"), own("target").alias("target"), own("correction").alias("gec_correction"), own("type").alias("unnormalized_type"), meta.alias("metadata")), "row_id")
    kind = F.when(~blank("unnormalized_type"), canonical_type("unnormalized_type"))
    out = numbered.withColumn("types", F.array_compact(F.array(kind)))
    bad = out.where(blank("input") | blank("target") | F.contains(F.coalesce("unnormalized_type", F.lit("")), F.lit(";")) | (kind == "overall"))
    first = bad.orderBy("row_id").select("row_id").first()
    if first:
        raise SourceError(f"row {first[0]} has a blank input or target, or not one type")
    if out.isEmpty():
        raise SourceError(f"{path} has no rows")
    return out.where(F.col("row_id") <= limit) if limit is not None else out


def numbered_rows(df: DataFrame, name: str) -> DataFrame:
    """df with its rows numbered from 1 in the order in which they are read.

    df is a scan, of whose partitions each task numbers its own; how many rows come before a partition is a table of one
    row for each, which is broadcast.
    """
    # The number within a partition stands in the lower 33 bits, below the partition's.
    own = df.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy(F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    joined = own.join(F.broadcast(counts.select("__p", "__before")), F.col("__part") == F.col("__p"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__at") + 1).cast("long").alias(name))


def invalid_rows(rows: DataFrame) -> DataFrame:
    """Rows (row_id, input, target) with a reason: no or a repeated row_id, or a blank input or target."""
    n = F.count(F.lit(1)).over(Window.partitionBy("row_id"))
    reason = F.when(F.col("row_id").isNull(), "no row_id").when(n > 1, "repeated row_id").when(blank("input"), "blank input").when(blank("target"), "blank target")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL")


def gold_pairs(spark: SparkSession, path: str, input_column: int | str | None = None, expected_column: int | str | None = None, category_column: int | str | None = None) -> DataFrame:
    """row_number, source, expected, category of word pairs, with a header or without.

    Columns are named or counted from 0. Without either the header decides if the first row has known names, and the
    first two columns do if not.
    """
    first = next(csv.reader(io.StringIO(spark.read.text(path).first()[0].removeprefix(BOM))))
    folded = [c.strip().casefold() for c in first]
    known = {*ALIASES["input"], "informal", "wrong"}, {*ALIASES["target"], "normalized", "correct"}
    by_name = any(isinstance(c, str) for c in (input_column, expected_column))
    has_header = by_name or any(c in known[0] for c in folded) and any(c in known[1] for c in folded)

    def place(column: int | str | None, names: set[str], default: int | None) -> int | None:
        if isinstance(column, int):
            return column
        if isinstance(column, str):
            if column.strip().casefold() not in folded:
                raise SourceError(f"no column {column!r}")
            return folded.index(column.strip().casefold())
        return next((i for i, c in enumerate(folded) if has_header and c in names), default)

    at = [place(input_column, known[0], 0), place(expected_column, known[1], 1), place(category_column, {"category"}, None)]
    names = [f"c{i}" for i in range(len(first))]
    raw = read_csv(spark, path, names, has_header)
    pick = [F.btrim(names[i]).alias(n) if i is not None else F.lit(None).cast("string").alias(n) for i, n in zip(at, ("source", "expected", "category"), strict=True)]
    out = numbered_rows(raw.select(*pick), "row_number").select("row_number", "source", "expected", "category")
    if not out.where(blank("source") | blank("expected")).isEmpty():
        raise SourceError("a pair has a blank side")
    return out


def training_pairs(spark: SparkSession, path: str) -> DataFrame:
    """source, target of a file of exactly two columns, in lower case; a first row of known names is a header."""
    first = next(csv.reader(io.StringIO(spark.read.text(path).first()[0].removeprefix(BOM))))
    if len(first) != 2:
        raise SourceError("training pairs have two columns")
    has_header = first[0].strip().casefold() in {"input", "source", "wrong"}
    out = read_csv(spark, path, ["source", "target"], has_header).select(*[F.lower(F.btrim(c)).alias(c) for c in ("source", "target")])
    if not out.where(blank("source") | blank("target")).isEmpty():
        raise SourceError("a pair has a blank side")
    return out


def record_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """word of files whose lines are records with a 'word'; bytes that aren't UTF-8 are read as Latin-1."""
    return decoded_lines(spark, path).select(F.lower(F.btrim(F.regexp_extract("line", r"""['"]word['"]\s*:\s*['"]([^'"]*)['"]""", 1))).alias("word")).where("word <> ''").distinct()


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """line, word: one word a line, trimmed, without blank lines."""
    return numbered_rows(spark.read.text(path).select(F.btrim("value").alias("word")), "line").where("word <> ''").select("line", "word")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """word: the distinct words of a list, in lower case."""
    return word_list(spark, path).select(F.lower("word").alias("word")).distinct()


def decoded(content: F.Column) -> F.Column:
    """Bytes as text: UTF-8, without its mark, or else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), f"^{BOM}", "")).otherwise(F.decode(content, "ISO-8859-1"))


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line of whole files, each in its own encoding."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.explode(F.split(decoded(F.col("content")), "\r?\n")).alias("line"))


def rules_artifact(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """src, dst, weight, ord of a rules file, with max_ngram and candidate_cutoff; refused if its schema_version is another."""
    raw = spark.read.json(path, multiLine=True, schema="schema_version int, max_ngram int, candidate_cutoff int, rules map<string,map<string,double>>")
    if raw.first()["schema_version"] != version:
        raise SourceError(f"{path} is not of schema {version}")
    outer = raw.select("max_ngram", "candidate_cutoff", F.explode("rules").alias("src", "to"))
    return outer.select("max_ngram", "candidate_cutoff", "src", F.posexplode(F.map_entries("to")).alias("ord", "e")).select("src", "e.key", "e.value", "ord", "max_ngram", "candidate_cutoff").toDF("src", "dst", "weight", "ord", "max_ngram", "candidate_cutoff")


def curated_artifact(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """key, normalized, source_id, source_ids, ambiguous of a file of curated forms."""
    schema = "schema_version int, mappings map<string,struct<normalized:string,source_id:string,source_ids:array<string>,category:string>>, ambiguous map<string,array<struct<normalized:string,source_ids:array<string>>>>"
    raw = spark.read.json(path, multiLine=True, schema=schema)
    if raw.first()["schema_version"] != version:
        raise SourceError(f"{path} is not of schema {version}")
    plain = raw.select(F.explode("mappings").alias("key", "m")).select("key", "m.normalized", "m.source_id", "m.source_ids", F.lit(False).alias("ambiguous"))
    none = F.lit(None).cast("string")
    unclear = raw.select(F.explode("ambiguous").alias("key", "m")).select("key", none.alias("normalized"), none.alias("source_id"), F.flatten(F.transform("m", lambda x: x["source_ids"])).alias("source_ids"), F.lit(True).alias("ambiguous"))
    return plain.unionByName(unclear)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def checked_artifacts(spark: SparkSession, folder: str, metadata: str = "metadata.json") -> None:
    """SourceError unless each file that the metadata names has the digest that it records."""
    raw = spark.read.json(f"{folder}/{metadata}", multiLine=True, schema="schema_version int, artifacts map<string,struct<sha256:string>>").first()
    for name, entry in (raw["artifacts"] or {}).items():
        found = digests(spark, f"{folder}/{name}").first()
        if found is None or found["sha256"] != entry["sha256"]:
            raise SourceError(f"{name} is not the file that the metadata describes")


def pinned_parquet(spark: SparkSession, path: str, sha256: str | None = None, refuse: Sequence[str] = ("test",)) -> DataFrame:
    """A Parquet file, if its digest is the given one and its path does not name a split that must stay unseen."""
    parts = path.replace("\\", "/").casefold().replace(".", "/").replace("_", "/").split("/")
    if any(word in parts for word in refuse):
        raise SourceError(f"{path} is not to be read")
    if sha256 is not None and digests(spark, path).first()["sha256"] != sha256:
        raise SourceError(f"{path} has another digest")
    return spark.read.parquet(path)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line; a line that is none fails the read."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, mode="FAILFAST")


def zip_members(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """path, member, text of ZIP archives' members, or of the one named."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zipfile

        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for inside in z.namelist():
                        if not inside.endswith("/") and member in (None, inside):
                            raw = z.read(inside)
                            try:
                                text = raw.decode("utf-8-sig")
                            except UnicodeDecodeError:
                                text = raw.decode("latin-1")
                            rows.append((name, inside, text))
            yield pd.DataFrame(rows, columns=["path", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, text string")


def uploads(spark: SparkSession, path: str, most: int = LARGEST_UPLOAD) -> DataFrame:
    """path, text, status (200, 400 for other kinds of files, 413 for too long ones) of .txt and .docx files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import zipfile
        from xml.etree import ElementTree

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                text, status = None, 200
                if re.search(r"\.txt$", name, re.I):
                    text = bytes(content).decode("utf-8", "replace")
                elif re.search(r"\.docx$", name, re.I):
                    try:
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            body = ElementTree.fromstring(z.read("word/document.xml"))
                        text = "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in body.iter(f"{w}p"))
                    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                        status = 400
                else:
                    status = 400
                if text is not None and len(text) > most:
                    text, status = None, 413
                rows.append((name, text, status))
            yield pd.DataFrame(rows, columns=["path", "text", "status"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, status int")


def tagged_tokens(spark: SparkSession, path: str, split: str = "SEPL|||SEPR", several: str = "SEPL__SEPR") -> DataFrame:
    """tokens, tags of lines of token-tag pairs; of several tags of a token the first counts."""
    import re

    pairs = F.transform(F.split(F.btrim("value"), " "), lambda x: F.struct(F.split(x, re.escape(split))[0].alias("token"), F.split(F.split(x, re.escape(split))[1], re.escape(several))[0].alias("tag")))
    rows = spark.read.text(path).where(F.length(F.btrim("value")) > 0).select(pairs.alias("p"))
    return rows.select(F.transform("p", lambda x: x["token"]).alias("tokens"), F.transform("p", lambda x: x["tag"]).alias("tags"))


def verb_forms(spark: SparkSession, path: str) -> DataFrame:
    """source, target, tag of lines `from_to:tag1_tag2`; of lines that share from and tag the first counts."""
    lines = numbered_rows(spark.read.text(path), "line")
    words, tag = F.split(F.split("value", ":")[0], "_"), F.split("value", ":")[1]
    rows = lines.select("line", words[0].alias("source"), words[1].alias("target"), F.btrim(tag).alias("tag"))
    first = Window.partitionBy("source", "tag").orderBy("line")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").select("source", "target", "tag")


def label_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """label, id of a list of labels: <OOV> 0, $KEEP 1, the list from 2, <PAD> last; markers of padding and unknowns are left out."""
    lines = word_list(spark, path).where(~F.col("word").isin("@@PADDING@@", "@@UNKNOWN@@", "<OOV>", "$KEEP", "<PAD>"))
    own = lines.select(F.col("word").alias("label"), (F.row_number().over(Window.orderBy("line")) + 1).cast("int").alias("id"))  # a list of thousands
    ends = spark.createDataFrame([("<OOV>", 0), ("$KEEP", 1), ("<PAD>", own.count() + 2)], "label string, id int")
    return ends.unionByName(own)


def built_vocabulary(labels: DataFrame, most: int) -> DataFrame:
    """label, id of the most frequent labels (column label, order seen): as label_vocabulary, `most` entries in all."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("at")).where(F.col("label") != "$KEEP")
    top = counts.orderBy(F.desc("n"), "at").limit(max(0, most - 2))
    own = top.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "at")) + 1).cast("int").alias("id"))
    ends = labels.sparkSession.createDataFrame([("<OOV>", 0), ("$KEEP", 1)], "label string, id int")
    return ends.unionByName(own)


def table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a relational database, by JDBC; the driver's jar is the cluster's business."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def digests_in(json_text: F.Column) -> F.Column:
    """The distinct SHA-256 digests, in order, under any key of a JSON text that speaks of sha256, however deep."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(json_text), F.lit(r'"[^"]*sha256[^"]*"\s*:\s*"([0-9a-f]{64})"'), 1)))


def checked_labels(vocabulary_rows: DataFrame, keep: str = "$KEEP") -> None:
    """SourceError unless ids (label, id) run from 0 without gaps, each once, and $KEEP is among the labels."""
    r = vocabulary_rows.agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"), F.count_distinct("label").alias("l"), F.count_if(F.col("label") == keep).alias("k")).first()
    if (r["a"], r["z"], r["d"], r["l"], r["k"]) != (0, r["n"] - 1, r["n"], r["n"], 1):
        raise SourceError("label ids have gaps or repeat, or keep is missing")


def checked_manifest(manifest: dict, expected: dict, parent: str | None = None) -> None:
    """SourceError unless a model's manifest has the expected values (nested), and the parent's digest if one is named."""

    def compare(have, want, at: str) -> None:
        if isinstance(want, dict):
            if not isinstance(have, dict):
                raise SourceError(f"{at or 'the manifest'} is missing")
            for key, value in want.items():
                compare(have.get(key), value, f"{at}.{key}".lstrip("."))
        elif have != want or type(have) is not type(want):
            raise SourceError(f"{at} is {have!r}, not {want!r}")

    compare(manifest, expected, "")
    if parent is not None and manifest.get("hashes", {}).get("parent") != parent:
        raise SourceError("the manifest names another parent")
