"""Jobs for spark-submit or python -m quillmill: build, normalize, evaluate, gate. Errors end with status 2."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .artifacts import provenance
from .functions.text import letter_words
from .operators import evaluation, experiment, normalization
from .settings import Settings
from .sources import readers, writers


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rules, vocabulary and curated forms from pairs, a base vocabulary and a sheet, as Parquet tables."""
    pairs = readers.training_pairs(spark, a.pairs)
    order = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    rules = normalization.induced_rules(pairs, a.longest).withColumn("ord", F.row_number().over(order))
    learned = pairs.select(F.explode(letter_words(F.lower("target"))).alias("word"))
    base = readers.record_vocabulary(spark, a.base_vocabulary) if a.records else readers.vocabulary(spark, a.base_vocabulary)
    writers.write_parquet(rules, f"{a.output}/rules")
    writers.write_parquet(normalization.vocabulary_union(base, learned), f"{a.output}/vocabulary")
    if a.curated:
        sheet = readers.read_csv(spark, a.curated, readers.header(spark, a.curated))
        rows = readers.numbered_rows(sheet.toDF(*[c.strip().lower() for c in sheet.columns]).select("id", "informal", "normalized", "category"), "row")
        writers.write_parquet(normalization.curated_forms(rows), f"{a.output}/curated")


def artifacts(spark: SparkSession, folder: str):
    rules = normalization.rule_map(spark.read.parquet(f"{folder}/rules"))
    try:
        forms = normalization.form_map(spark.read.parquet(f"{folder}/curated"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        forms = {}
    return spark.read.parquet(f"{folder}/vocabulary"), rules, forms


def normalize(spark: SparkSession, a: argparse.Namespace) -> None:
    """Documents (Parquet: the key and text columns) normalized with built artifacts."""
    s = Settings.of(spark)
    docs = spark.read.parquet(a.input)
    done = normalization.normalize_documents(docs, *artifacts(spark, a.artifacts), key=a.key, text=a.text, longest=s.longest_ngram, cutoff=a.cutoff or s.candidate_cutoff, max_distance=a.max_distance if a.max_distance is not None else s.max_edit_distance)
    writers.write_parquet(done, a.output)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """An evaluation CSV scored with normalization off, on, or both; the output is what normalization makes, as no model is bundled."""
    rows = readers.evaluation_rows(spark, a.data, a.limit)
    base = rows.select("row_id", "input", "target", F.get("types", F.lit(0)).alias("grp"))
    modes = {"off": base.select("row_id", F.lit("off").alias("mode"), F.col("input").alias("normalized"), F.col("input").alias("output"))}
    if a.normalization != "off":
        done = normalization.normalize_documents(base, *artifacts(spark, a.artifacts), key="row_id", text="input")
        modes["on"] = done.select("row_id", F.lit("on").alias("mode"), "normalized", F.col("normalized").alias("output"))
    wanted = ["off", "on"] if a.normalization == "both" else [a.normalization]
    outputs = modes[wanted[0]] if len(wanted) == 1 else modes["off"].unionByName(modes["on"])
    metrics, predictions, comparison = evaluation.evaluated(base, outputs, a.group or [])
    writers.write_reports(a.output, metrics, predictions, comparison, metrics.where(F.col("grp") == evaluation.OVERALL), [a.data])
    settings = {"normalization": a.normalization, "limit": str(a.limit), "groups": ",".join(a.group or [])}
    writers.write_json_lines(provenance(spark, [a.data], settings), f"{a.output.rstrip('/')}/provenance")
    print(writers.console_table(metrics.orderBy("mode", "position").select("mode", "grp", "n", "precision", "recall", "f05", "error_reduction_rate")))


def gate(spark: SparkSession, a: argparse.Namespace) -> None:
    """The verdict on two models' metrics (JSON lines)."""
    print(experiment.gate_decision(readers.json_lines(spark, a.metrics)).first()["verdict"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmill")
    jobs = p.add_subparsers(dest="job", required=True)

    def job(f, *required: str, **optional):
        q = jobs.add_parser(f.__name__, help=f.__doc__.splitlines()[0])
        q.set_defaults(run=f)
        for name in required:
            q.add_argument(name)
        for name, kind in optional.items():
            q.add_argument(f"--{name.replace('_', '-')}", **kind)

    job(build, "pairs", "base_vocabulary", "output", curated={}, longest={"type": int, "default": 2}, records={"action": "store_true"})
    job(normalize, "artifacts", "input", "output", key={"default": "doc_id"}, text={"default": "text"}, cutoff={"type": int}, max_distance={"type": int})
    job(evaluate, "data", "output", artifacts={}, normalization={"choices": ["off", "on", "both"], "default": "off"}, limit={"type": int}, group={"action": "append"})
    job(gate, "metrics")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(spark or SparkSession.builder.appName("quillmill").getOrCreate(), a)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
