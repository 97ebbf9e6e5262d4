"""Every query of the engine itself runs, and equals its SQL where it has one."""

import pytest

from quillmill.plans import scoring_queries, tagging_queries, text_queries
from tests.compare import SF, rows_of, views

MODULES = (text_queries, scoring_queries, tagging_queries)
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLES = {n: s for m in MODULES for n, s in m.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    got = rows_of(QUERIES[name](spark, SF).toPandas())
    want = rows_of(views().execute(ORACLES[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_round_trips(spark):
    for name in ("sentence_counts", "percent_payloads"):
        assert QUERIES[name](spark, SF).where("NOT same").isEmpty()
    assert QUERIES["suggestion_replay"](spark, SF).where("NOT reproduces").isEmpty()
