"""A tagger of two heads over whole conversations, and the same in SQL over the same weights."""

from __future__ import annotations

import io
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import inference as inf
from ..session import read

LABELS = ("$KEEP", "$DELETE", "$TRANSFORM_CASE_CAPITAL", "$TRANSFORM_CASE_LOWER", "$ADD_PUNC_PERIOD")
BUCKETS, WIDTH, LETTERS = 97, 6, 4


def rule_weights() -> dict[str, np.ndarray]:
    """Weights by a rule, in eighths, so that sums are exact in any order."""
    grid = lambda rows, columns, a, b, n: ((np.arange(rows)[:, None] * a + np.arange(columns) * b) % n - n // 2) / 8
    return {
        "embedding": grid(BUCKETS, WIDTH, 7, 13, 17),
        "correction": grid(WIDTH, len(LABELS), 5, 3, 11),
        "correction_bias": grid(1, len(LABELS), 0, 2, 3)[0],
        "detection": grid(WIDTH, 2, 3, 4, 7),
        "detection_bias": grid(1, 2, 0, 1, 2)[0],
    }


def rule_snapshot(folder: str, **settings) -> inf.Snapshot:
    out = io.BytesIO()
    np.savez(out, **rule_weights())
    return inf.write_snapshot(folder, {"weights": out.getvalue()}, LABELS, **settings)


def tagged_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and error chances of every turn's tokens."""
    snapshot = rule_snapshot(tempfile.mkdtemp(prefix="quillmill-snapshot-"))  # the driver's own; Spark serves the files
    snapshot.ship(spark)
    turns = read(spark, sf, "conversations").select("conv_id", "turn", tx.tokens("text").alias("tokens"))
    found = turns.withColumn("p", inf.tagged(F.col("tokens"), snapshot))
    return found.select("conv_id", "turn", F.size("tokens").cast("long").alias("tokens"), F.array_join("p.labels", " ").alias("labels"), F.round(F.aggregate("p.chances", F.lit(0.0), lambda a, x: a + x), 6).alias("error_mass"))


QUERIES = {"tagged_sentences": tagged_sentences}


def _oracle() -> str:
    token = tx.TOKEN.replace("'", "''")
    names = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
    head = lambda n, a, b, m, c, k: "[" + ", ".join(f"list_sum(list_transform(h, lambda x, d: x * ((((d - 1) * {a} + {j} * {b}) % {m}) - {m // 2}) / 8.0)) + ((({j} * {c}) % {k}) - {k // 2}) / 8.0" for j in range(n)) + "]"
    soft = lambda c: f"list_transform({c}, lambda x: exp(x - list_max({c})) / list_sum(list_transform({c}, lambda y: exp(y - list_max({c})))))"
    return f"""
WITH t AS (SELECT row_number() OVER () AS k, conv_id, turn, regexp_extract_all(coalesce(text, ''), '{token}') AS w FROM conversations),
e AS (SELECT k, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
p AS (SELECT k, i, j, list_sum(list_transform(string_split(substr(word, j * {LETTERS} + 1, {LETTERS}), ''), lambda c: unicode(c)))::BIGINT % {BUCKETS} AS id FROM (SELECT k, i, word, unnest(range((length(word) + {LETTERS - 1}) // {LETTERS})) AS j FROM e)),
v AS (SELECT id, list_transform(range({WIDTH}), lambda d: ((id * 7 + d * 13) % 17 - 8) / 8.0) AS x FROM range({BUCKETS}) r(id)),
b AS (SELECT k, i, j, x, lag(x) OVER (PARTITION BY k ORDER BY i, j) AS y FROM p JOIN v USING (id)),
h AS (SELECT k, i, list_transform(x, lambda z, d: greatest(z + coalesce(y[d], 0) / 2, 0)) AS h FROM b WHERE j = 0),
l AS (SELECT k, i, {head(len(LABELS), 5, 3, 11, 2, 3)} AS c, {head(2, 3, 4, 7, 1, 2)} AS d FROM h),
s AS (SELECT k, i, list_transform({soft("c")}, lambda x, n: CASE WHEN n = 1 THEN x + {inf.KEEP_BIAS} ELSE x END) AS c, {soft("d")}[2] AS chance FROM l),
o AS (SELECT k, string_agg(CASE WHEN chance >= {inf.ERROR_GATE} THEN {names}[list_position(c, list_max(c))] ELSE '{LABELS[0]}' END, ' ' ORDER BY i) AS labels, round(sum(chance), 6) AS error_mass FROM s GROUP BY k)
SELECT conv_id, turn, len(w)::BIGINT AS tokens, coalesce(labels, '') AS labels, coalesce(error_mass, 0.0) AS error_mass FROM t LEFT JOIN o USING (k)
"""


ORACLES = {"tagged_sentences": _oracle()}
