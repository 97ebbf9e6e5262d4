"""Plans against each other, and reports as text."""

import pytest

from quillmill import reports
from quillmill.operators import experiment as ex
from quillmill.operators import normalization as nm

RULES = {"nm": {"nam": 0.5, "nm": 0.5}, "mn": {"man": 0.7}, "aq": {"ako": 0.9}}


def test_two_ways_to_rank(spark):
    """The broadcast and the relational way to normalize words give the same rows, whichever is faster."""
    words = spark.createDataFrame([(w,) for w in ("nmn", "aq", "ako", "xx", "nmn")], "word string")
    vocabulary = spark.createDataFrame([(w,) for w in ("naman", "ako", "po")], "word string")
    plans = {"broadcast": lambda: nm.normalized_words(words, vocabulary, RULES), "relational": lambda: nm.normalized_words(words, vocabulary, RULES, relational=True)}
    found = reports.ab(plans, 1)
    assert found["parity"] and found["rows"] == 1 and set(found["seconds"]) == set(plans) and found["chosen"] in plans
    with pytest.raises(ValueError, match="wrong"):
        reports.ab(plans | {"wrong": lambda: plans["broadcast"]().limit(0)}, 1)


def test_drift_and_markdown(spark):
    passes = spark.createDataFrame([("a", 1, 2, 2), ("b", 1, 2, 3), ("a", 2, 2, 5), ("b|c", 2, 2, 1)], "case_id string, pass int, initial_slots int, fresh_slots int")
    assert sorted(map(tuple, ex.segmentation_drift(passes).collect())) == [(1, 1, 1), (2, 3, 1)]
    assert sorted(map(tuple, ex.drifted_cases(passes).collect())) == [(1, "b", 1), (2, "a", 3)]
    text = reports.markdown("Doubled words", {"drift": ex.segmentation_drift(passes).orderBy("pass"), "cases": passes.orderBy("pass", "case_id")}, most=3)
    assert text.startswith("# Doubled words\n\n## drift\n\n| pass | added | cases |\n| --- | --- | --- |\n| 1 | 1 | 1 |\n| 2 | 3 | 1 |\n")
    assert text.endswith("| a | 2 | 2 | 5 |\n\n1 rows more.\n")
    assert "| b\\|c |" in reports.markdown("x", {"y": passes.where("pass = 2")})
