"""Sinks. Spark's commit makes each write whole or nothing; an existing output is refused unless told otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFUSE = "errorifexists"


def canonical_json(columns: Sequence[str]) -> Column:
    """The columns as JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = REFUSE) -> None:
    """The columns in their order, a header in each file; other columns are left out."""
    df.select(*columns).write.mode(mode).csv(path, header=True, escape='"', emptyValue="")


def write_json_lines(df: DataFrame, path: str, mode: str = REFUSE) -> None:
    """One object a line with sorted keys; NaN and infinity are refused."""
    floats = [c for c, k in df.dtypes if k in ("double", "float")]
    bad = F.lit(False)
    for c in floats:
        bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    checked = F.when(bad, F.raise_error(F.lit("a number that JSON has no word for"))).otherwise(canonical_json(df.columns))
    df.select(checked.alias("value")).write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, mode: str = REFUSE, by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_reports(folder: str, metrics: DataFrame, predictions: DataFrame, comparison: DataFrame, summary: DataFrame, inputs: Sequence[str] = ()) -> None:
    """Metrics and comparison as CSV, predictions and summary as JSON lines; refused where it would overwrite an input."""
    clean = folder.rstrip("/")
    if any(clean == i.rstrip("/") or i.startswith(clean + "/") for i in inputs):
        raise ValueError("the report would lie over its input")
    for name, df in (("metrics", metrics), ("comparison", comparison)):
        write_csv(df, f"{clean}/{name}", df.columns)
    for name, df in (("predictions", predictions), ("summary", summary)):
        write_json_lines(df, f"{clean}/{name}")


def rendered(df: DataFrame, percents: Sequence[str] = (), decimals: int = 4) -> DataFrame:
    """df as strings for a console: numbers with decimals or as per cent, N/A for null."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in percents:
            c = F.concat(F.format_number(c * 100, 2), F.lit(" %"))
        elif kind in ("double", "float"):
            c = F.format_number(c, decimals)
        out.append(F.coalesce(c.cast("string"), F.lit("N/A")).alias(name))
    return df.select(*out)


def console_table(df: DataFrame, most: int = 1000) -> str:
    """A report's rows as aligned text."""
    rows = [df.columns, *[[*r] for r in rendered(df).limit(most).collect()]]
    widths = [max(len(str(r[i])) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(str(x).ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def write_table(df: DataFrame, url: str, name: str, mode: str = REFUSE, **options: str) -> None:
    """A table of a relational database, by JDBC."""
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()
