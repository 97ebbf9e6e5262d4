"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_trees, conversation_repair, fingerprints, language_id, ngram_join, packing, quality_rules, secret_scans, sharding, spelling_variants, token_counts, toxicity
from .common import release

_MODULES = [quality_rules, sharding, bpe, token_counts, ngram_join, toxicity, language_id, chat_trees, fingerprints, packing, conversation_repair, secret_scans, spelling_variants]


def _alone(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, before which the session lets go of what earlier ones held; their results are computed again if read."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        release()
        return query(spark, sf_dir)

    return run


QUERIES = {name: _alone(query) for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
