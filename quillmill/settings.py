"""Settings of a run, from the session's configuration under quillmill.*, or the defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    passes: int = 5
    longest_text: int = 5000
    longest_ngram: int = 2
    candidate_cutoff: int = 100
    max_edit_distance: int = 2
    keep_bias: float = 0.2
    error_gate: float = 0.5
    seed: int = 20260928

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """The settings that the session names, in their types; ValueError for a value that is none."""
        given = {f.name: spark.conf.get(f"quillmill.{f.name}", None) for f in fields(cls)}
        return cls(**{n: type(getattr(cls, n))(v) for n, v in given.items() if v is not None})
