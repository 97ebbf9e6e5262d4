"""The functions in SQL against the ones they register."""

import pytest

from quillmill import sql
from quillmill.functions import edits, labels, segmentation
from quillmill.functions.candidates import candidates
from quillmill.operators import normalization as nm

PAIRS = [("aq", "ako"), ("nmn", "naman"), ("tlga", "talaga"), ("d", "hindi"), (None, "x"), ("x", None), ("", ""), ("nmn", "naman"), ("ok", "ok")]
RULES = {"nm": {"nam": 0.5, "nm": 0.5}, "mn": {"man": 0.7}, "q": {"ko": 0.9}}


@pytest.fixture(scope="module")
def named(spark):
    sql.register(spark, RULES, 2, 50)
    spark.createDataFrame(PAIRS, "source string, target string").createOrReplaceTempView("pairs")
    spark.createDataFrame([(1, "Dr. Cruz came. Did he? Yes!  Ok"), (2, ""), (3, None)], "id long, text string").createOrReplaceTempView("texts")
    return spark


def test_scalars(named):
    assert named.sql("SELECT dld('ca', 'abc') AS d, dld(NULL, 'a') AS n").first() == (2, None)
    for r in named.sql("SELECT text, tokenize_spans(text) AS t, segment_sentences(text) AS s FROM texts WHERE text IS NOT NULL").collect():
        assert [(x["text"], x["start"], x["end"], x["gap_before"]) for x in r["t"]] == segmentation.token_spans(r["text"])
        assert (r["s"]["sentences"], r["s"]["gaps"]) == segmentation.segments(r["text"])
    got = named.sql("SELECT replay_labels('ang bata', array('$KEEP', '$TRANSFORM_CASE_CAPITAL'), array(0.1D, 0.9D)).output AS o").first()[0]
    assert got == labels.replay("ang bata", ["$KEEP", "$TRANSFORM_CASE_CAPITAL"])[0] == "ang Bata"
    assert [tuple(e) for e in named.sql("SELECT edit_set('ang bata', 'ang batang lalaki') AS e").first()[0]] == edits.text_edits("ang bata", "ang batang lalaki")
    assert {c["candidate"]: c["weight"] for c in named.sql("SELECT ngram_candidates('nmn') AS c").first()[0]} == candidates("nmn", RULES, 2, 50)


def counted(rows):
    return {(r["src"], r["dst"]): r["n"] for r in rows}


def test_collected_rules(named):
    """A lateral join, and a table in partitions, give the counts that the operator's weights stand on."""
    lateral = counted(named.sql("SELECT src, dst, sum(n) AS n FROM pairs, LATERAL collect_rules(source, target, 3) GROUP BY src, dst").collect())
    table = counted(named.sql("SELECT src, dst, sum(n) AS n FROM collect_rules(TABLE(pairs) PARTITION BY (substr(source, 1, 1)), 3) GROUP BY src, dst").collect())
    assert lateral == table and lateral
    # The operator counts each n-gram once more as itself.
    operator = counted(nm.induced_rules(named.table("pairs").where("source IS NOT NULL AND target IS NOT NULL"), 3).collect())
    sources = {src for src, _ in lateral}
    assert operator == {k: lateral.get(k, 0) + (k[0] == k[1]) for k in {*lateral, *((s, s) for s in sources)}}


def test_counts_are_passed_on(named, monkeypatch):
    whole = CollectRulesOf(PAIRS)
    monkeypatch.setattr(sql, "COUNTED", 2)
    assert CollectRulesOf(PAIRS) == whole


def CollectRulesOf(pairs):
    from collections import Counter

    from pyspark.sql import Row

    f, out = sql.CollectRules(), Counter()
    for s, t in pairs:
        for src, dst, n in f.eval(Row(source=s, target=t), 2):
            out[src, dst] += n
    for src, dst, n in f.terminate():
        out[src, dst] += n
    return out


@pytest.mark.parametrize("call", ["collect_rules('a', 'b')", "collect_rules('a', 'b', 1)", "collect_rules(TABLE(texts), 2)", "collect_rules(1, 'b', 2)"])
def test_bad_calls_are_refused(named, call):
    with pytest.raises(Exception, match="collect_rules takes|longest is|the table needs|are strings"):
        named.sql(f"SELECT * FROM {call}").collect()
