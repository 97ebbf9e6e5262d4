"""Text functions, labels, alignment and candidates against plain definitions and known answers."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import alignment as al
from quillmill.functions import candidates as ca
from quillmill.functions import labels as lb
from quillmill.functions import legacy
from quillmill.functions import segmentation as sg
from quillmill.functions import text as tx
from quillmill.functions.distance import damerau_levenshtein
from quillmill.functions.edits import edit_counts, token_edits

TEXTS = ["", "   ", "Aq, po! 🙂 nmn.", "etc. atbp. dr. santos. U.S. news.", "a.b 3.5, 1,000.25 x/y http://a.b/c?d. “Oo” é o'clock mag-aral—ka", "\r\n Ano?! (Oo.) Sige\n\nna", "a" * 2000]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def brute_distance(a, b):
    """Damerau-Levenshtein from its definition, by memoized recursion over prefixes."""
    from functools import lru_cache

    @lru_cache(None)
    def d(i, j):
        if min(i, j) == 0:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        for k in range(1, i):
            for m in range(1, j):
                if a[k - 1] == b[j - 1] and a[i - 1] == b[m - 1]:
                    best = min(best, d(k - 1, m - 1) + (i - k - 1) + 1 + (j - m - 1))
        return best

    return d(len(a), len(b))


def test_distance():
    assert damerau_levenshtein("ca", "abc") == 2
    r = random.Random(3)
    for _ in range(400):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(2))
        assert damerau_levenshtein(a, b) == brute_distance(a, b)


@pytest.mark.parametrize("text", TEXTS)
def test_tokens(spark, text):
    spans = sg.token_spans(text)
    assert "".join(g + t for t, _, _, g in spans) + text[spans[-1][2] if spans else 0 :] == text
    assert all(text[s:e] == t for t, s, e, _ in spans)
    row = spark.createDataFrame([(text,)], "t string").select(tx.tokens("t").alias("k"), tx.reconstruct(tx.gaps("t"), tx.tokens("t"), tx.trailing_gap("t")).alias("again")).first()
    assert row["k"] == [s[0] for s in spans]
    assert row["again"] == text


@pytest.mark.parametrize("text", TEXTS)
def test_sentences(text):
    sentences, gaps = sg.segments(text)
    assert sg.joined(sentences, gaps) == text
    assert all(s == s.strip() and s for s in sentences)


def test_sentence_answers():
    assert sg.segments("etc. atbp. dr. santos. U.S. news.")[0] == ["etc. atbp. dr. santos.", "U.S. news."]
    assert sg.segments("Bayad 3.5 na.\nOo")[0] == ["Bayad 3.5 na.", "Oo"]
    assert sg.segments('"Ano?" sabi niya!! Sige')[0] == ['"Ano?"', "sabi niya!!", "Sige"]


REPLAYS = [
    ("A    B C", ["$ADD_PUNC_EMARK@gap:%20,", "$DELETE", "$KEEP"], "A !C"),
    ("Sya po.", ["$REPLACE_siya", "$DELETE", "$CHANGE_PUNC_EMARK"], "siya!"),
    ("mag aral ka", ["$MERGE_HYPHEN@2", "$DELETE", "$ADD_PUNC_PERIOD"], "mag-aral ka."),
    ("nag aral", ["$MERGE_SPACE@2", "$DELETE"], "nagaral"),
    ("kumain-ako", ["$TRANSFORM_SPLIT_HYPHEN"], "kumain ako"),
    ("magaral", ["$TRANSFORM_INSERT_HYPHEN@3"], "mag-aral"),
    ("x y z", ["$DELETE", "$DELETE", "$KEEP"], "z"),
    ("x y z", ["$KEEP", "$DELETE", "$DELETE"], "x"),
    ("ako ito", ["$TRANSFORM_CASE_CAPITAL", "$APPEND_nga%20po"], "Ako ito nga po"),
    ("  ako", ["$REPLACE_Ikaw@gaps:,"], "Ikaw"),
    ("nasaan", ["$TRANSFORM_SPLIT_SPACE@nasa%20an"], "nasa an"),
    ("kain", ["$TRANSFORM_VERB_COMPACT@kumain"], "kumain"),
]


@pytest.mark.parametrize(("text", "labels", "want"), REPLAYS)
def test_replay(text, labels, want):
    assert lb.replay(text, labels)[0] == want


@pytest.mark.parametrize("label", ["", "$NONE", "$APPEND_t1", "$APPEND_", "$REPLACE_%ZZ", "$REPLACE_%FF", "$MERGE_SPACE@1", "$MERGE_SPACE@x", "$ADD_PUNC_COMMA", "$ADD_PUNC_PERIOD@gap:x", "$TRANSFORM_INSERT_HYPHEN@0", "$TRANSFORM_SPLIT_SPACE@one", "$TRANSFORM_VERB_BASE@a%20b", "$REPLACE_a@b"])
def test_malformed(label):
    with pytest.raises(lb.LabelError):
        lb.parse(label)


def test_derived_labels_make_their_words():
    for token, words in [("a", ("a",)), ("a", ()), ("ako", ("Ako",)), ("AKO", ("ako",)), ("sya", ("siya",)), (",", (".",)), ("magaral", ("mag-aral",)), ("mag-aral", ("magaral",)), ("a", ("a", "?")), ("a", ("a", "-")), ("a", ("a", "t1")), ("x-y", ("x", "y")), ("a", ("b", "c"))]:
        assert lb.output(token, lb.parse(lb.derive(token, words))) == words


def test_replay_column(spark):
    df = spark.createDataFrame([("a b", ["$KEEP", "$DELETE"], [0.1, 0.8]), ("a b", ["$KEEP"], None), (None, [], None)], "t string, l array<string>, p array<double>")
    rows = [r["r"] for r in df.select(lb.replayed("t", "l", "p").alias("r")).collect()]
    assert rows[0]["output"] == "a" and rows[0]["changes"][0]["confidence"] == 0.8
    assert rows[1]["output"] is None and "labels" in rows[1]["error"]
    assert rows[2]["output"] == ""


def test_families(spark):
    assert len(lb.FAMILY_OF) == 39
    assert one(spark, lb.family(F.lit("$TRANSFORM_VERB_BASE@kain"))) == "morphology"
    assert one(spark, lb.family(F.lit("$NONE"))) is None


def test_edits():
    assert edit_counts("I go", "I went", "I go") == (0, 0, 1, 1, 0)
    assert edit_counts("We see", "We saw", "We sees") == (0, 1, 1, 1, 1)
    assert edit_counts("I go", "we leave", "I go")[3] == 2
    assert edit_counts("si si a", "si a", "si a") == (1, 0, 0, 1, 1)
    assert edit_counts("Oo.", "Oo..", "Oo..") == (1, 0, 0, 1, 1)
    assert edit_counts(None, "", "a") == (0, 1, 0, 0, 1)
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.choice("xyz") for _ in range(r.randint(0, 6))] for _ in range(2))
        out, shift = list(a), 0
        for at, op, _, new in token_edits(a, b):
            if op == "insert":
                out.insert(at + shift, new)
                shift += 1
            elif op == "delete":
                del out[at + shift]
                shift -= 1
            else:
                out[at + shift] = new
        assert out == b


def test_candidates():
    assert ca.candidates("", {}, 2, 5) == {"": 1.0}
    assert ca.candidates("x", {}, 2, 5) == {"x": 1.0, "": 1.0}
    rules = {"aq": {"ako": 0.6, "aq": 0.4}, "q": {"k": 1.0}}
    assert list(ca.candidates("aq", rules, 2, 100).items()) == [("akok", 0.6), ("ako", 0.6), ("aq", 0.4)]
    assert list(ca.candidates("aq", rules, 2, 1)) == ["akok", "ako"]  # ties stay
    assert ca.pair_rules("aq", "ako", 2) == [("aq", "ak"), ("q", "o")]


def change(start, end, old, new, **more):
    return al.Change(start, end, old, new, **more)


def test_compose():
    found = al.compose("aq po", "ako po", "Ako po.", [change(0, 2, "aq", "ako")], [("ako po", "Ako po.", [change(0, 3, "ako", "Ako", tag="$CAP", confidence=0.8, iteration=1), change(6, 6, "", ".", tag="$ADD", confidence=0.7, iteration=1)])])
    assert [(x["id"], x["start"], x["end"], x["replacement"]) for x in found] == [("combined-1", 0, 2, "Ako"), ("gec-1", 5, 5, ".")]
    assert al.applied("aq po", found) == "Ako po."
    broken = al.compose("aq", "ako", "Ako", [change(0, 2, "aq", "ako")], [("???", "Ako", [])])
    assert [x["source"] for x in broken] == ["normalization"]
    assert al.compose("aq", "ako", "ako", [change(0, 2, "xx", "ako")], []) == []
    undone = al.compose("a b", "a b", "a b", [], [("a b", "a", [change(1, 3, " b", "")]), ("a", "a b", [change(1, 1, "", " b")])])
    assert undone == []


def test_random_traces_reproduce():
    r = random.Random(11)
    for _ in range(300):
        text = "".join(r.choice("ab c") for _ in range(r.randint(0, 9)))
        start, passes, at = text, [], text
        for i in range(r.randint(0, 3)):
            changes, p = [], 0
            while p < len(at):
                e = min(len(at), p + r.randint(1, 2))
                if r.random() < 0.3:
                    changes.append(change(p, e, at[p:e], r.choice(["", "x", "yy"]), iteration=i))
                p = e + 1
            after = al.Trace(at).after(changes)[0].text
            passes.append((at, after, changes))
            at = after
        found = al.compose(start, start, at, [], passes)
        assert al.applied(start, found) == at


def test_admission():
    rows = [{"id": "a", "start": 0, "end": 2, "original": "ab", "replacement": "x"}, {"id": "a", "start": 2, "end": 3, "original": "c", "replacement": "y"}, {"id": "b", "start": 1, "end": 3, "original": "bc", "replacement": ""}, {"id": "c", "start": 3, "end": 4, "original": "?", "replacement": ""}]
    assert [r["id"] for r in al.admitted(rows, "abcd")] == ["a", "a-2"]
    assert al.segmented("abcd", rows) == [("ab", "a"), ("c", "a-2"), ("d", None)]
    assert al.applied("abcd", rows[:1] + rows[2:3]) is None


def test_case(spark):
    pairs = [("AQ", "ako", "AKO"), ("Naol", "sana all", "Sana all"), ("aq", "ako", "ako"), ("1", "x", "x")]
    df = spark.createDataFrame(pairs, "s string, n string, want string")
    assert df.where(tx.with_case_of(F.col("s"), F.col("n")) != F.col("want")).isEmpty()


def test_scalars(spark):
    assert one(spark, tx.utf16_offset(F.lit("🙂aq"), F.lit(2))) == 3
    assert one(spark, tx.percent_encoded(F.lit("Ang “+*~"))) == "Ang%20%E2%80%9C%2B%2A~"
    assert one(spark, tx.percent_decoded(F.lit("%ZZ"))) is None
    assert one(spark, tx.first_words(F.lit("a b  c d"), 3)) == "a b  c"
    assert one(spark, tx.with_duplicate(F.lit("ang bata"), F.lit(0), F.lit(3))) == "ang ang bata"
    assert one(spark, tx.canonical_type(F.lit(" Spelling-Variations "))) == "spelling_variation"
    assert one(spark, tx.blank(F.lit(" \n"))) and one(spark, tx.blank(F.lit(None).cast("string")))
    for words, want in (([], False), (["a"], False), (["a", "A"], True), (["a", "b", "a"], False)):
        assert one(spark, tx.has_adjacent_repeat(F.array(*map(F.lit, words)).cast("array<string>"))) is want


def test_legacy(spark):
    tokens, tags = ["$START", "MAG", "aral", "bata", "x", "kain"], ["$APPEND_Si", "$TRANSFORM_CASE_LOWER", "$MERGE_HYPHEN", "$TRANSFORM_AGREEMENT_PLURAL", "$DELETE", "$TRANSFORM_VERB_A_B"]
    verbs = F.create_map(F.lit("kain_A_B"), F.lit("kumain"))
    got = one(spark, legacy.edited(F.array(*map(F.lit, tokens)), F.array(*map(F.lit, tags)), verbs))
    assert got == ["$START", "Si", "mag", "aral-batas", "kumain"]
