"""Spans of texts and their joins against plain loops."""

import random
import re

import pytest

from quillmill.operators import intervals as iv

SPANS = "k long, start int, end int"


def test_matches_are_where_they_stand(spark):
    texts = ["ab1c, déf🙂gh", "", None, "xx", "1x2", " a b ", "🙂🙂a"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = sorted((r["k"], r["start"], r["end"], r["match"], r["before"], r["after"]) for r in iv.matches(df, ["k"], "t", "[a-zé]+").collect())
    want = [(k, m.start(), m.end(), m[0], t[m.start() - 1 : m.start()] if m.start() else "", t[m.end() : m.end() + 1]) for k, t in enumerate(texts) for m in re.finditer("[a-zé]+", t or "")]
    assert got == want


@pytest.mark.parametrize("width", [1, 4, 256])
def test_joins(spark, width):
    """Every pair once, whatever the bins; keys may be null."""
    r = random.Random(width)
    side = lambda n: sorted({(r.choice([None, 1, 2]), a := r.randint(0, 40), a + r.choice([0, 1, 2, 9, 60])) for _ in range(n)}, key=str)
    a, b = side(60), side(40)
    left, right = spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS)
    got = sorted((str((x["k"], x["start"], x["end"])), str((x["o_k"], x["o_start"], x["o_end"]))) for x in iv.overlapping(left, right, ["k"], width).collect())
    meet = lambda x, y: x[0] == y[0] and x[1] < y[2] and x[2] > y[1]
    assert got == sorted((str(x), str(y)) for x in a for y in b if meet(x, y))
    free = sorted(str(tuple(x)) for x in iv.apart(left, right, ["k"], width).collect())
    assert free == sorted(str(x) for x in a if not any(meet(x, y) for y in b))
    none = left.limit(0)
    assert iv.overlapping(none, right, ["k"], width).isEmpty() and iv.apart(left, none, ["k"], width).count() == len(a)


def test_no_python_on_the_way(spark):
    df = spark.createDataFrame([(1, "a b")], "k long, t string")
    words = iv.matches(df, ["k"], "t", "[a-z]").select("k", "start", "end")
    plan = iv.apart(words, words, ["k"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
