"""Operators against small brute-force versions, and their behaviour at the edges."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillmill.functions import candidates as ca
from quillmill.functions.distance import damerau_levenshtein
from quillmill.operators import decoding as dc
from quillmill.operators import evaluation as ev
from quillmill.operators import experiment as ex
from quillmill.operators import normalization as nm
from quillmill.operators import pipeline as pl
from quillmill.operators import store as st

VOCABULARY = ["ako", "po", "naman", "talaga", "sana", "all", "bata", "parang", "ka"]
RULES = {"aq": {"ako": 0.5, "aq": 0.5}, "nm": {"na": 0.6, "nm": 0.4}, "mn": {"man": 0.7, "mn": 0.3}, "tl": {"ta": 0.5, "tl": 0.5}, "lg": {"la": 0.5, "lg": 0.5}}


def words(spark, ws):
    return spark.createDataFrame([(w,) for w in ws], "word string")


def brute_word(word, most=2):
    low = word.lower()
    if not 2 <= len(low) <= 128 or low in VOCABULARY:
        return None
    known = [c for c in ca.candidates(low, RULES, 2, 100) if c.strip() and all(p in VOCABULARY for p in c.split())]
    if not known:
        return None
    best = min(known, key=lambda c: damerau_levenshtein(low, c))
    return None if best == low or damerau_levenshtein(low, best) > most else best.strip()


def test_normalized_words(spark):
    ws = ["aq", "nmn", "tlga", "ako", "x", "", "qzxv", "AQ", "a" * 130]
    got = {r["word"]: r["normalized"] for r in nm.normalized_words(words(spark, ws), words(spark, VOCABULARY), RULES).collect()}
    assert got == {w.lower(): b for w in ws if (b := brute_word(w))}


def test_normalize_documents(spark):
    curated = {"naol": ("sana all", "7"), "g ka": ("game ka", "8")}
    texts = ["AQ po, nmn! Naol? g  ka", "http://aq.ph/nmn aq@nmn.ph aq1 _aq aq", "naol-naol naol's ok", "", None, "iPhone 🙂 aq"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in nm.normalize_documents(docs, words(spark, VOCABULARY), RULES, curated).collect()}
    assert rows[0]["normalized"] == "AKO po, naman! Sana all? game ka"
    assert rows[1]["normalized"] == "http://aq.ph/nmn aq@nmn.ph aq1 _aq ako"
    assert rows[2]["normalized"] == texts[2]
    assert rows[3]["normalized"] == "" and rows[4]["normalized"] is None
    assert rows[5]["normalized"] == "iPhone 🙂 ako"
    for r in rows.values():
        for c in r["changes"] or []:
            assert r["text"][c["start"] : c["end"]] == c["word"]
    assert {c["strategy"] for c in rows[0]["changes"]} == {"curated_rule", "ngram_dld"}


@pytest.mark.parametrize("kind", ["answers", "forms", "many_forms", "rules", "relational"])
def test_large_tables_give_the_same(spark, monkeypatch, kind):
    """Answers, forms, rules and vocabulary beyond what travels with a UDF: joined, with the same result."""
    curated = {"naol": ("sana all", "7"), "g ka": ("game ka", "8")}
    texts = ["AQ po, nmn! Naol? g  ka", "http://aq.ph/nmn aq@nmn.ph aq1 _aq aq", "tlga NMN Naol naol g\tka", "", None, "iPhone 🙂 aq " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = words(spark, VOCABULARY)
    want = {r["doc_id"]: r for r in nm.normalize_documents(docs, vocabulary, RULES, curated).collect()}
    rules = spark.createDataFrame([(src, dst, w, i) for src, own in RULES.items() for i, (dst, w) in enumerate(own.items())], "src string, dst string, weight double, ord int")
    forms = spark.createDataFrame([(k, n, i) for k, (n, i) in curated.items()], "form string, target string, source_id string")
    options = {}
    if kind == "answers":
        monkeypatch.setattr(nm, "MOST_ANSWERS", 2)
    elif kind == "relational":
        options["relational"] = True
    elif kind == "many_forms":
        monkeypatch.setattr(nm, "EACH", 1)
    got = nm.normalize_documents(docs, vocabulary, rules if kind in ("rules", "relational") else RULES, forms if "forms" in kind else curated, **options)
    assert {r["doc_id"]: r for r in got.select(*want[0].asDict()).collect()} == want
    monkeypatch.setattr(nm, "MOST_RULES", 1)
    assert sorted(nm.rule_map(rules).collect()) == sorted(rules.select("src", "dst", "weight", F.col("ord").cast("long")).collect())


def test_explained(spark):
    rows = spark.createDataFrame([(1, "1", "Naol", "sana all", "slang"), (2, "2", "g", "go", "slang"), (3, "3", "G", "game", "slang"), (4, "4", "x", "y", "abbreviation")], "row int, id string, informal string, normalized string, category string")
    forms = nm.curated_forms(rows)
    assert nm.conflict_summary(forms).first()["summary"] == "g: 2, 3"
    ask = words(spark, ["naol", "g", "aq", "po"])
    answers = nm.normalized_words(ask, words(spark, VOCABULARY), RULES)
    got = {r["word"]: (r["strategy"], r["output"], r["curated_rule_status"]) for r in nm.explained(ask, forms, answers).collect()}
    assert got == {"naol": ("curated_rule", "sana all", "matched"), "g": ("ngram_dld", "g", "ambiguous"), "aq": ("ngram_dld", "ako", "absent"), "po": ("ngram_dld", "po", "absent")}
    off = {r["word"]: r["curated_rule_status"] for r in nm.explained(ask, forms, answers, use_curated=False).collect()}
    assert off["naol"] == "available_disabled"


def test_dense_groups_of_nothing(spark):
    rows = spark.createDataFrame([(1, "off", "b", 1, 1, 0, 2, 1, 0), (2, "off", " ", 0, 0, 0, 0, 0, 0), (3, "off", "a", 0, 0, 3, 1, 2, 2)], "row_id long, mode string, grp string, tp long, fp long, fn long, errors_before long, errors_after long, final_errors_after long")
    got = ev.dense_groups(rows, ["z"]).orderBy("position").collect()
    assert [(r["grp"], r["n"]) for r in got] == [("overall", 3), ("z", 0), ("b", 1), ("a", 1)]
    assert got[1]["precision"] == 0.0 and got[1]["error_reduction_rate"] is None
    assert got[3]["error_reduction_rate"] == -100.0


def test_pair_metrics_undefined(spark):
    pairs = spark.createDataFrame([("a", "a", "a")], "source string, expected string, prediction string")
    r = ev.pair_metrics(pairs).first()
    assert r["changed_precision"] is None and r["changed_f1"] is None and r["exact_rate"] == 1.0


def test_matched(spark):
    a = spark.createDataFrame([(1,), (2,)], "case_id long")
    assert ev.matched(a, a, ["case_id"]).count() == 2
    with pytest.raises(ValueError, match="differ"):
        ev.matched(a, a.limit(1), ["case_id"])


def test_hash_split(spark):
    pairs = [(i, f"s{i}", f"e{i}") for i in range(98)]
    df = spark.createDataFrame(pairs, "row_number long, source string, expected string")
    test = {r["row_number"] for r in ev.hash_split(df, 5, 0.2).where("is_test").collect()}
    ranked = sorted(pairs, key=lambda p: hashlib.sha256("\0".join(["5", *map(str, p)]).encode()).hexdigest())
    assert test == {p[0] for p in ranked[:20]}
    with pytest.raises(ValueError):
        ev.hash_split(df.limit(1), 5, 0.2)


def test_decode(spark):
    rows = [([1.0, 1.1, 0.0], [0.0, 3.0]), ([1.0, 9.0, 9.0], [0.0, 3.0]), ([1.0, 9.0, 0.0], [3.0, 0.0]), ([0.0, 5.0], [1.0, 1.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, correction array<double>, detection array<double>")
    assert [r["label_id"] for r in dc.decoded(df).orderBy("i").collect()] == [0, 1, 0, 1]


def test_pieces(spark):
    r = spark.range(1).select(dc.piece_labels(F.array(*[F.lit(x).cast("int") for x in (None, 0, 0, 1, None)]), F.array(F.lit(7), F.lit(9))).alias("x")).first()["x"]
    assert r == [-100, 7, -100, 9, -100]


def provider(slots):
    return slots.select("doc_id", "slot", F.transform("tokens", lambda t, i: F.when(i == F.size("tokens") - 1, "$ADD_PUNC_EMARK").otherwise("$KEEP")).alias("labels"), F.transform("tokens", lambda t: F.lit(0.5)).alias("chances"))


def test_passes_keep_their_slots(spark):
    docs = spark.createDataFrame([(1, "Umalis siya"), (2, ""), (3, "  "), (4, "A. B"), (5, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in dc.corrected(docs, provider, 3).collect()}
    assert rows[1]["corrected"] == "Umalis siya!!!"
    assert rows[2]["corrected"] == "" and rows[2]["passes"] == [] and rows[5]["passes"] == []
    assert rows[3]["corrected"] == "  " and len(rows[3]["passes"]) == 3
    assert rows[4]["corrected"] == "A.!!! B!!!"
    for r in rows.values():
        for p in r["passes"]:
            for c in p["changes"]:
                assert p["input"][c["start"] : c["end"]] == c["original"]


def test_analyze(spark):
    docs = spark.createDataFrame([(1, "AQ po"), (2, "ako. nmn"), (3, "")], "doc_id long, text string")
    done = pl.analyze(docs, words(spark, VOCABULARY), RULES, {}, provider, 2)
    rows = {r["doc_id"]: r for r in done.withColumn("same", pl.reproduces(done)).collect()}
    assert rows[1]["corrected"] == "AKO po!!" and rows[2]["corrected"] == "ako.!! naman!!"
    assert all(r["same"] for r in rows.values())
    assert {s["source"] for s in rows[1]["suggestions"]} == {"normalization", "gec"}


def test_quota_sample_excludes_across_strata(spark):
    pool = spark.createDataFrame([(f"{s}{i}", str(i), s, "short") for s in "ab" for i in range(3)], "key string, clean_id string, stratum string, bucket string")
    got = ex.quota_sample(pool, {"a": {"short": 2}, "b": {"short": 1}}, 1).collect()
    assert len({r["clean_id"] for r in got}) == 3
    with pytest.raises(ValueError, match="wanted"):
        ex.quota_sample(pool, {"a": {"short": 2}, "b": {"short": 2}}, 1)


def gate(spark, **changes):
    rows = []
    for model in ("baseline", "candidate"):
        for number in (1, 5):
            groups = [("stress", g) for g in ("duplicate_corruptions", "duplicate_token_coverage=unseen", "target_class=content", "target_class=function", "identity_controls")]
            groups += [("official", g) for g in ("official_stage3_dev", "historical_duplicate_dev", "identity_controls", "natural_repetition_identity", "family:x")]
            for suite, group in groups:
                r = {"model": model, "suite": suite, "pass": number, "grp": group, "n": 100, "precision": 0.97, "recall": 0.7, "f0_5": 0.8, "exact_rate": 0.5, "err": 0.4, "fp": 2, "delete_fp": 0}
                if model == "candidate":
                    r["recall"] += 0.1
                    r |= changes.get(group.replace(":", "_").replace("=", "_"), {})
                rows.append(r)
    schema = "model string, suite string, pass int, grp string, n long, precision double, recall double, f0_5 double, exact_rate double, err double, fp long, delete_fp long"
    return ex.gate_decision(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).first()["verdict"]


def test_gate(spark):
    assert gate(spark) == ex.GO
    assert gate(spark, duplicate_corruptions={"recall": 0.7}) == ex.AGAIN
    assert gate(spark, identity_controls={"fp": 6}) == ex.STOP
    assert gate(spark, family_x={"f0_5": 0.7}) == ex.STOP
    assert gate(spark, family_x={"f0_5": 0.78}) == ex.AGAIN


def test_store(spark):
    docs = st.created(spark.createDataFrame([(1, None, "a b  c", "2024-01-01"), (2, "T", None, "2024-01-02")], "seq int, title string, content string, at string"), 10)
    assert [(r["id"], r["title"], r["word_count"]) for r in docs.orderBy("id").collect()] == [(10, "Untitled", 3), (11, "T", 0)]
    change = spark.createDataFrame([(10, None, "x", "2024-02-01")], "id long, title string, content string, at string")
    after = {r["id"]: r for r in st.updated(docs, change).collect()}
    assert after[10]["word_count"] == 1 and after[10]["analyze"] and after[11]["updated_at"] == "2024-01-02"
    old = spark.createDataFrame([(1, 10, "grammar"), (2, 11, "grammar")], "id long, document_id long, type string")
    fresh = spark.createDataFrame([(3, 10, "grammar"), (4, 11, "grammar")], "id long, document_id long, type string")
    assert sorted(r["id"] for r in st.replaced(old, docs, fresh).collect()) == [3]
    s = spark.createDataFrame([(1, False, False), (2, True, False)], "id long, accepted boolean, ignored boolean")
    e = spark.createDataFrame([(1, 1, "accept"), (2, 1, "ignore"), (3, 99, "accept")], "seq long, suggestion_id long, action string")
    assert sorted(map(tuple, st.decided(s, e).collect())) == [(1, False, True), (2, True, False)]


def test_islands(spark):
    spans = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 5, 9), (1, 8, 8), (1, 11, 12)], "k int, start int, end int")
    assert [r["island"] for r in pl.islands(spans, ["k"]).orderBy("start").collect()] == [1, 1, 2, 2, 3]


def test_both_ways_to_normalize_agree(spark):
    ws = words(spark, ["aq", "nmn", "tlga", "nm", "mn", "zz", "aqaq", "tlg"])
    v = words(spark, [*VOCABULARY, "na", "ta"])
    both = [sorted(map(tuple, nm.normalized_words(ws, v, RULES, relational=r).collect())) for r in (False, True)]
    assert both[0] == both[1] and both[0]


def test_evaluated(spark):
    rows = spark.createDataFrame([(1, "I go", "I went", "x"), (2, "We see", "We saw", "y"), (3, "ok na", "ok na", None)], "row_id long, input string, target string, grp string")
    outputs = spark.createDataFrame([(1, "off", "I go", "I went"), (2, "off", "We see", "We sees"), (3, "off", "ok na", "ok na po")], "row_id long, mode string, normalized string, output string")
    metrics, _, _ = ev.evaluated(rows, outputs, [])
    r = metrics.where("grp = 'overall'").first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 1)
    assert (round(r["precision"], 9), r["recall"], round(r["f05"], 9)) == (round(1 / 3, 9), 0.5, round(5 / 14, 9))
    assert r["errors_before"] == 2 and r["final_system_error_reduction_rate"] == 0.0


def test_stress_set(spark):
    texts = [f"ang bata ay masaya, {i} dahil kumain siya ng marami kahapon sa bahay" for i in range(40)] + ["po po ito nga", "oo"]
    rows = spark.createDataFrame([(str(i), str(i), t) for i, t in enumerate(texts)], "key string, clean_id string, text string")
    cases = ex.prepared_cases(rows, 1, {"interior_content": {"short": 5}, "initial_function": {"short": 3}}, 1)
    cases = cases.cache()
    assert cases.groupBy("case_type").count().count() == 3 and cases.select("case_id").distinct().count() == cases.count() == 10
    assert cases.select("clean_id").distinct().count() == 10
    assert ex.audit(cases, ex.prepared_cases(rows, 1, {"interior_content": {"short": 5}, "initial_function": {"short": 3}}, 1)).first().asDict() == {"only_recorded": 0, "only_recomputed": 0}
    fixed = cases.select("case_id", F.lit(1).alias("pass"), F.col("target_text").alias("output"))
    s = {r["grp"]: r for r in ex.stress_summary(cases, fixed.unionByName(cases.select("case_id", F.lit(5).alias("pass"), F.col("source_text").alias("output")))).collect() if r["pass"] == 1}
    assert s["duplicate_corruptions"]["recall"] == 1.0 and s["duplicate_corruptions"]["delete_tp"] == 8 and s["identity_controls"]["fp"] == 0
    with pytest.raises(ValueError, match="differ"):
        ex.matched_cases(cases, fixed.limit(3))


def test_word_report(spark):
    gold = spark.createDataFrame([(i, w, e, "slang ") for i, (w, e) in enumerate([("aq", "ako"), ("nmn", "naman"), ("po", "po"), ("tlga", "talaga"), ("zz", "oo")])], "row_number long, source string, expected string, category string")
    training = spark.createDataFrame([("ZZ", "x")], "source string, expected string")
    answers = nm.normalized_words(gold.select(F.col("source").alias("word")), words(spark, VOCABULARY), RULES)
    report = ev.word_report(gold, training, answers, 1, 0.25)
    assert report["overlap"].first()["source_overlap"] == 1
    assert {r["split"]: r["pair_count"] for r in report["metrics"].collect()} == {"test": 1, "validation": 3}
    assert all(r["exact_rate"] == 1.0 for r in report["metrics"].collect())
    assert {r["category"] for r in report["categories"].collect()} == {"slang"}
    own = answers.select(F.col("word").alias("w"), "normalized")
    pairs = gold.join(own, F.lower("source") == F.col("w"), "left").withColumn("prediction", F.coalesce("normalized", "source"))
    facts = nm.candidate_diagnostics(pairs.select("source", "expected", "prediction"), words(spark, VOCABULARY), RULES)
    valid = spark.createDataFrame([(1, "po"), (2, "zz"), (3, "nmn")], "line long, word string")
    whole = ev.word_report(gold.withColumn("expected", F.when(F.col("source") == "nmn", "xx").otherwise(F.col("expected"))), training, answers, 1, 0.25, facts.unionByName(facts.where("source = 'nmn'").withColumns({"expected": F.lit("xx"), "failure": F.lit("expected_candidate_not_generated")})), valid)
    assert sorted(whole) == ["candidates", "categories", "failures", "metrics", "overlap", "valid_words"]
    assert [(r["failure"], r["n"]) for r in whole["failures"].collect()] == [("expected_candidate_not_generated", 1)]
    assert sum(r["n"] for r in whole["candidates"].collect()) == 4
    rates = whole["valid_words"].first()
    assert (rates["excluded"], rates["evaluated"], rates["changed"], rates["examples"]) == (1, 2, 1, ["zz"])


def test_providers(spark):
    docs = spark.createDataFrame([(1, "sya po")], "doc_id long, text string")
    vocabulary = spark.createDataFrame([("$KEEP", 0), ("$REPLACE_siya", 1)], "label string, id int")
    logits = spark.createDataFrame([(1, 0, "sya po", 0, [0.0, 5.0], [0.0, 3.0]), (1, 0, "sya po", 1, [0.0, 5.0], [3.0, 0.0])], "doc_id long, slot int, sentence string, token_index int, correction array<double>, detection array<double>")
    done = dc.corrected(docs, dc.logits_provider(logits, vocabulary), 2).first()
    assert done["corrected"] == "siya po" and done["passes"][1]["changes"] == []
    view = dc.pass_view(dc.corrected(docs, dc.model_provider(lambda rows: [[("$KEEP", 0.1)] * len(r) for r in rows]), 1)).first()["view"]
    assert view.startswith("1   0    sya po")


def test_small_checks(spark):
    cases = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "case_id string, case_type string")
    assert ex.suite_shape(cases, {"x": 2, "y": 1}).isEmpty()
    assert [r["case_type"] for r in ex.suite_shape(cases, {"x": 3, "y": 1}).collect()] == ["x"]
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string")
    assert ex.provenance_block(files, {"seed": "1"}).first()["files"] == {"a": "1", "b": "2"}
    from quillmill import reports

    one = {"metric": "m", "unit": "sec", "sf": "0.1", "queries": {"q": 2.0}}
    assert reports.compared(one, one | {"queries": {"q": 1.0}})["q"]["change"] == -0.5
    with pytest.raises(reports.ReportError):
        reports.compared(one, one | {"sf": "1"})


def test_metrics_agree(spark):
    """Pooled metrics and the bundle by memberships say the same of the same rows."""
    rows = [(i, "off", "g", i % 3, i % 2, i % 4, i % 5, 0, 0) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id long, mode string, grp string, tp long, fp long, fn long, errors_before long, errors_after long, final_errors_after long")
    a = ev.pooled(df, ["grp"]).first()
    more = df.withColumns({"delete_tp": F.col("tp"), "delete_fp": F.col("fp"), "delete_fn": F.col("fn"), "initial": F.col("errors_before"), "residual": F.col("errors_after"), "exact": F.lit(False)})
    b = ev.by_memberships(more, F.array("grp"), []).first()
    assert all(a[c] == b[c] for c in ("n", "tp", "fp", "fn", "precision", "recall", "f05"))


def test_shortened_words_miss_nothing():
    import random

    r = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(2))
        for k in (1, 2):
            if damerau_levenshtein(a, b) <= k:
                assert not nm.shortened(a, k).isdisjoint(nm.shortened(b, k))


def test_normalize_corpus_runs_with_the_production_cutoff(spark, monkeypatch):
    from quillmill.plans import text_queries as tq

    seen = {}
    real = nm.normalize_documents
    monkeypatch.setattr(tq.nm, "normalize_documents", lambda *a, **b: seen.update(b) or real(*a, **b))
    tq.normalize_corpus(spark, "/root/testdata/sf0.001")
    assert seen["cutoff"] == 100


def test_close_words_are_all_found(spark):
    """Changes in the first letters, accents, short, long and spaceless words: as brute force finds them."""
    from quillmill.functions import near_words as nw

    new = ["xello", "ehllo", "señor", "a", "ab", "straße", "b" * 23, "c" * 24, "d" * 27, "e" * 300 + "f", "wrold", "lowrd", "qqqqqqq"]
    known = ["hello", "world", "senor", "abc", "strasse", "b" * 26, "c" * 25, "d" * 24, "e" * 300, "kalligraphie"]
    got = nw.near_pairs(spark.createDataFrame([(w,) for w in new], "word string"), spark.createDataFrame([(w,) for w in known], "candidate string")).collect()
    want = sorted((a, b, damerau_levenshtein(a, b)) for a in new for b in known if damerau_levenshtein(a, b) <= 3)
    assert sorted(map(tuple, got)) == want


def test_queries_run_the_production_number_of_passes(spark, monkeypatch):
    from quillmill.plans import scoring_queries as sq

    seen = []
    corrected, analyze = dc.corrected, pl.analyze
    monkeypatch.setattr(sq.dc, "corrected", lambda *a: seen.append(a[2]) or corrected(*a))
    sq.passes_trace(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(sq.dc, "corrected", corrected)
    monkeypatch.setattr(sq.pl, "analyze", lambda *a: seen.append(a[5]) or analyze(*a))
    sq.suggestion_replay(spark, "/root/testdata/sf0.001")
    assert seen == [5, 5]


def test_suggestion_replay_normalizes_words(spark, monkeypatch):
    """Automatic normalization changes words that the passes then start from, and its edits are among the suggestions."""
    from quillmill.plans import scoring_queries as sq

    seen = {}
    normalize, analyze = pl.normalize_documents, pl.analyze
    monkeypatch.setattr(pl, "normalize_documents", lambda *a, **b: seen.update(b, normal=normalize(*a, **b)) or seen["normal"])
    monkeypatch.setattr(sq.pl, "analyze", lambda *a: seen.update(done=analyze(*a)) or seen["done"])
    sq.suggestion_replay(spark, "/root/testdata/sf0.001")
    made = seen["normal"].select(F.explode("changes").alias("c")).where("c.strategy = 'ngram_dld'")
    assert not made.isEmpty()
    assert seen["cutoff"] == 100
    assert not seen["done"].select(F.explode("suggestions").alias("s")).where("s.source = 'normalization' AND lower(s.original) <> 'the'").isEmpty()


def test_candidates_are_made_where_a_known_word_can_be_among_them(monkeypatch):
    """Answers are those of all candidates, which are made for no other word."""
    import random

    import pandas as pd

    from quillmill.functions.candidates import candidates

    r, asked = random.Random(3), []
    monkeypatch.setattr(nm, "candidates", lambda w, *a: asked.append(w) or candidates(w, *a))
    text = lambda low, high: "".join(r.choice("abcd") for _ in range(r.randint(low, high)))
    for _ in range(120):
        rules = {text(1, 2): {text(0, 3): r.choice([0.2, 0.3, 0.5, 1.0]) for _ in range(r.randint(0, 3))} for _ in range(r.randint(0, 12))}
        known = frozenset(text(1, 6) for _ in range(50))
        words = sorted({text(2, 7) for _ in range(30)} - known)
        cutoff, most = r.choice([1, 3, 100]), r.choice([1, 2])
        del asked[:]
        got = nm.nearest_known(rules, known, 2, cutoff, most).func(pd.Series(words))
        for w, g in zip(words, got, strict=True):
            alive = [(damerau_levenshtein(w, c), i, c) for i, c in enumerate(candidates(w, rules, 2, cutoff)) if c in known]
            best = min(alive, default=None)
            assert g == ([{"normalized": best[2], "distance": best[0]}] if best and best[0] <= most and best[2] != w else [])
            uncut = candidates(w, rules, 2, 10**9)
            assert (w in asked) == any(c in known and damerau_levenshtein(w, c) <= most for c in uncut)


def test_sentences_of_a_text_are_replayed_as_each_alone():
    """Also without labels, with labels that don't fit, and in rows without any."""
    import pyarrow as pa

    from quillmill.functions import labels as lb
    from quillmill.functions import segmentation as sg

    texts = ["Ako po. Ikaw ba? Sila!", "", "Ang bata.\nWala", "Oo nga. Hindi"]
    parts = [sg.segments(t) for t in texts]
    labels = [[["$DELETE", lb.KEEP, "$APPEND_po"], None, ["$KEEP"]], [], None, [[lb.KEEP, "$TRANSFORM_CASE_CAPITAL", None], ["$TRANSFORM_CASE_LOWER"]]]
    chances = [[[0.1, 0.2, None], None, [0.5]], [], None, [None, [0.75]]]
    got = lb.slots_replayed(pa.array([s for s, _ in parts], pa.list_(pa.string())), pa.array([g for _, g in parts], pa.list_(pa.string())), pa.array(labels, pa.list_(pa.list_(pa.string()))), pa.array(chances, pa.list_(pa.list_(pa.float64()))), 3).to_pylist()
    for row, (slots, gaps), own, sure in zip(got, parts, labels, chances, strict=True):
        new, moved, at = [], [], 0
        for k, (sentence, gap) in enumerate(zip(slots, gaps, strict=False)):
            at += len(gap)
            try:
                p = (sure or [None] * 9)[k]
                out, changes = lb.replay(sentence, (own or [None] * 9)[k] or [], p and [float("nan") if x is None else x for x in p])
            except ValueError:
                out, changes = sentence, []
            new.append(out)
            moved += [(a + at, b + at, x, y, label, None if c is None or c != c else c, 3) for x, y, a, b, label, c in changes]
            at += len(sentence)
        assert (row["slots"], row["output"]) == (new, sg.joined(new, gaps))
        assert [tuple(c.values()) for c in row["changes"]] == moved
    assert got[0]["changes"] and got[3]["changes"]


def test_turns_are_dealt_to_all_tasks(spark):
    """A small table of long work is not one task's, whatever its bytes."""
    from quillmill.plans import scoring_queries as sq

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks > 1 and sq.suggestion_replay(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == tasks


def test_rows_that_share_a_key_are_all_normalized(spark):
    """Rows with one key and different texts, repeated rows and rows without a key are all there, told apart."""
    from quillmill.functions import text as tx

    rows = [(1, "aq po"), (1, "aq na"), (1, "aq po"), (None, "aq"), (None, None), (2, None)]
    keyed = tx.with_row_key(spark.createDataFrame(rows, "doc_id long, text string"), "row_key", ["doc_id"], "text")
    assert keyed.select("row_key").distinct().count() == len(rows)
    back = keyed.select(F.get_json_object("row_key", "$.doc_id").cast("long").alias("d"), "text").collect()
    assert sorted(map(str, back)) == sorted(map(str, [type(back[0])(d=d, text=t) for d, t in rows]))


def test_content_hash_is_of_the_rows(spark):
    from quillmill.operators import experiment as ex

    rows = [(i, f"text {i % 7}") for i in range(200)] + [(5, "text 5")]
    digest = lambda own: ex.content_hash(spark.createDataFrame(own, "i long, t string"), ["i", "t"]).first()["sha256"]
    assert digest(rows) == digest(rows[::-1]) != digest(rows[:-1])
    assert digest(rows) != digest([*rows[:-1], (5, "text 6")])


def test_candidate_diagnostics(spark):
    """Flags, distances and failure types against plain loops over the candidates of each word."""
    from quillmill.functions.candidates import candidates
    from quillmill.functions.distance import damerau_levenshtein
    from quillmill.operators import normalization as nm

    rules = {"a": {"a": 0.6, "e": 0.4}, "q": {"q": 0.5, "ko": 0.5}, "t": {"t": 1.0}, "x": {"x": 0.5, "a b": 0.5}}
    vocabulary = {"ako", "eko", "tata", "a", "b", "tete"}
    pairs = [("aq", "ako", "aq"), ("aq", "ako", "ako"), ("aq", "zzz", "aq"), ("tat", "tata", "tat"), ("AKO", "ako", "Ako"), ("ako", "eko", "ako"), ("x", "a b", "x"), ("xq", "a b ko", "xq"), ("tq", "tko", "tq"), ("aqaq", "akoako", "tete"), ("aq", "eko", "ako"), ("ta", "o o", "ta")]
    rows = nm.candidate_diagnostics(spark.createDataFrame(pairs, "source string, expected string, prediction string"), spark.createDataFrame([(w,) for w in vocabulary], "word string"), rules).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        word, expected = r["source"].lower(), r["expected"].lower()
        known = word in vocabulary
        made = [] if known or not 1 < len(word) <= 128 else list(candidates(word, rules, 2, 100))
        alive = [c for c in made if c.strip() and all(p.lower() in vocabulary for p in c.split())]
        assert (r["in_vocabulary"], r["generated"], r["survivors"]) == (known, len(made), len(alive))
        assert r["expected_generated"] == (expected in map(str.lower, made)) and r["expected_survives"] == (expected in map(str.lower, alive))
        best = sorted((damerau_levenshtein(word, c), i, c) for i, c in enumerate(alive))[:10]
        assert [(x["candidate"], x["distance"]) for x in r["top_candidates"] or []] == [(c, d) for d, _, c in best]
    kinds = {(r["source"], r["expected"], r["prediction"]): r["failure"] for r in rows}
    assert kinds["aq", "ako", "ako"] is None and kinds["AKO", "ako", "Ako"] == "false_positive" and kinds["ako", "eko", "ako"] == "input_already_in_vocabulary"
    assert kinds["aq", "zzz", "aq"] == "expected_candidate_not_generated" and kinds["tq", "tko", "tq"] == "expected_candidate_filtered_out" and kinds["ta", "o o", "ta"] == "multi_token_unsupported"


def test_deleted_documents_take_their_suggestions(spark):
    from quillmill.operators import store as st

    documents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, title string")
    suggestions = spark.createDataFrame([(10, 1), (11, 2), (12, 9), (13, 2)], "id long, document_id long")
    left, kept = st.deleted(documents, suggestions, spark.createDataFrame([(1,), (7,), (1,)], "id long"))
    assert sorted(r["id"] for r in left.collect()) == [2, 3] and sorted(r["id"] for r in kept.collect()) == [11, 13]
    titles = spark.createDataFrame([('a/b:c "d"',), ("  ",), (None,), ("<>",), ("x\\y\x01 ",)], "t string")
    assert [r["f"] for r in titles.select(st.file_name("t").alias("f")).collect()] == ["abc d.txt", "Untitled.txt", "Untitled.txt", "Untitled.txt", "xy.txt"]


def test_strategy_of_least_time():
    from quillmill import reports

    rows = reports.matrix(lambda kind, size: sum(range(size)), sizes=(1, 10), times=2)
    assert [(r["kind"], r["size"]) for r in rows] == [("word", 1), ("word", 10), ("sentence", 1), ("sentence", 10)]
    slow = [r | {"median": r["median"] + 1} for r in rows]
    assert reports.chosen({"slow": slow, "fast": rows})["strategy"] == "fast"
    with pytest.raises(reports.ReportError):
        reports.chosen({"a": rows, "b": rows[:1]})
