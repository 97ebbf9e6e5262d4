"""What may not grow faster than a row, or be held for a whole batch: long texts, and batches of many tokens."""

import random
import subprocess
import sys
import time

from pyspark.sql import functions as F

from quillmill.functions import edits as ed
from quillmill.functions import labels as lb
from quillmill.functions import segmentation as sg
from quillmill.operators import decoding as dc
from quillmill.operators import experiment as ex
from quillmill.operators import normalization as nm


def test_doubled_tokens_of_a_long_text(spark):
    """A row's tokens share what they share, and take no copy of the row's tokens with them."""
    n = 12_000
    rows = spark.createDataFrame([("k", "c", " ".join(["bata", "ang", ","] * (n // 3)))], "key string, clean_id string, text string")
    began = time.monotonic()
    got = {(r["stratum"], r["bucket"]): r["count"] for r in ex.corruption_candidates(rows).groupBy("stratum", "bucket").count().collect()}
    assert time.monotonic() - began < 30
    assert got == {k: v for k, v in {("initial_content", "long"): 1, ("final_function", "long"): 1, ("punctuation_content", "long"): n // 3 - 1, ("punctuation_function", "long"): n // 3 - 1}.items() if k[0] in ex.QUOTAS}


def grown(body, rows):
    """MB by which the most that this process has ever taken grew while body went over the rows' columns; in a process of its own."""
    code = f"import resource, pyarrow as pa\nfrom quillmill.functions import labels as lb, segmentation as sg\n{rows}\nsize = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024\nbefore = size()\n{body}\nprint(size() - before)"
    return float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)


def test_a_batch_of_many_tokens_is_no_heap_of_objects():
    """4.5 MB of text, 900,000 tokens: labels, chances and changes are not all objects at once."""
    rows = """
n = 600
text = pa.array(["bata " * n] * 1500)
labels = pa.array([["$TRANSFORM_CASE_CAPITAL"] * n]).take(pa.array([0] * 1500))
chances = pa.array([[0.5] * n]).take(pa.array([0] * 1500))
"""
    assert grown("r = lb._replay.func(text, labels, chances)\nassert len(r) == 1500 and r[1499]['output'].as_py() == 'Bata ' * n and len(r[1499]['changes']) == n", rows) < 300
    assert grown("r = sg._token_offsets.func(text)\nassert len(r) == 1500 and len(r[7]['start']) == n\nr = sg._segments.func(text)", rows) < 100


def test_rows_of_arrow_functions(spark):
    """Nulls, rows of no tokens, labels that don't fit and texts of many stretches keep their places."""
    texts = [None, "", " ", "Ang bata. ", "x " * 200_000, None, "sila"]
    rows = spark.createDataFrame([(i, t, [lb.DELETE] * (1 if i == 6 else 2), [0.5, None]) for i, t in enumerate(texts)], "i int, t string, l array<string>, c array<double>")
    got = rows.select("i", sg.token_spans_of("t").alias("s"), sg.token_texts_of("t").alias("x"), sg.token_offsets_of("t").alias("o"), sg.segments_of("t").alias("p"), lb.replayed("t", "l", "c").alias("r")).orderBy("i").collect()
    for t, r in zip(texts, got, strict=True):
        spans = sg.token_spans(t or "")
        assert (r["s"], r["x"]) == ((None, None) if t is None else ([*map(tuple, spans)], [x for x, *_ in spans])) or [tuple(x) for x in r["s"]] == spans
        assert (r["o"]["start"], r["o"]["end"]) == ([s[1] for s in spans], [s[2] for s in spans])
        assert (r["p"]["sentences"], r["p"]["gaps"]) == sg.segments(t or "")
    assert [(r["r"]["output"], r["r"]["error"] is None) for r in got] == [(None, False)] * 3 + [(None, False)] * 3 + [("", True)]


def test_edits_of_long_texts():
    """6,000 tokens: cell by cell the table has 29 million cells."""
    a = [str(i % 83) for i in range(6000)]
    b = [t for i, t in enumerate(a) if i % 5 != 4]
    began = time.process_time()
    found = ed.token_edits(a, b)
    assert time.process_time() - began < 2
    assert len(found) == 1200 and {op for _, op, _, _ in found} == {"delete"}


def test_edits_are_those_of_the_table():
    """The list that a walk back over the whole table gives, preferences included."""

    def plain(x, y):
        table = [[max(i, j) if not i or not j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                table[i][j] = min(table[i - 1][j - 1] + (x[i - 1] != y[j - 1]), table[i - 1][j] + 1, table[i][j - 1] + 1)
        out, i, j = [], len(x), len(y)
        while i or j:
            if i and j and x[i - 1] == y[j - 1] and table[i - 1][j - 1] == table[i][j]:
                i, j = i - 1, j - 1
            elif i and j and table[i - 1][j - 1] + 1 == table[i][j]:
                i, j = i - 1, j - 1
                out.append((i, "substitute", x[i], y[j]))
            elif i and table[i - 1][j] + 1 == table[i][j]:
                i -= 1
                out.append((i, "delete", x[i], None))
            else:
                j -= 1
                out.append((i, "insert", None, y[j]))
        return out[::-1]

    r = random.Random(4)
    for _ in range(3000):
        # What both begin and end with is left out first; so other letters stand at the ends.
        x, y = ([*e[0], *(r.choice("abc") for _ in range(r.randint(0, 8))), *e[1]] for e in ("pq", "rs"))
        assert ed.token_edits(x, y) == plain(x, y)


def test_passes_by_tokens_stay_in_rows(spark):
    """What labels by tokens alone give is what a provider of rows gives, without a shuffle."""
    given = dc.TokenProvider(
        lambda tokens: F.transform(tokens, lambda t, i: F.when(i == 0, "$TRANSFORM_CASE_CAPITAL").when(t == "x", "$MERGE_SPACE@").when(i % 3 == 2, lb.DELETE).otherwise("$ADD_PUNC_EMARK")),
        lambda tokens: F.transform(tokens, lambda t, i: (i % 5) / 5.0),
    )
    texts = [None, "", "  ", "ang bata. siya ay  kumain!\n sila x", "a b c d e. 🙂 f g h i", "x. x y"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    in_rows = dc.corrected(docs, given, 3)
    assert sorted(in_rows.collect()) == sorted(dc.corrected(docs, lambda slots: given(slots), 3).collect())
    assert "Exchange" not in in_rows._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_not_sent_through_the_driver(spark):
    """Of the joins of diagnosis only those with the vocabulary may be by broadcast, however small tables look."""
    pairs = spark.createDataFrame([("aq", "ako", "aq"), ("x", "y", "z")], "source string, expected string, prediction string")
    vocabulary = spark.createDataFrame([("ako",), ("po",)], "word string")
    found = nm.candidate_diagnostics(pairs, vocabulary, {"aq": {"ako": 1.0}})
    found.collect()
    lines = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    assert not [line for line in lines if "BroadcastHashJoin" in line and ("__w" in line or "candidate" in line)]
