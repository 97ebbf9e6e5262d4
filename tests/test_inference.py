"""Batched inference through a pinned snapshot."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import decoding as dc
from quillmill.operators import inference as inf
from quillmill.plans.tagging_queries import LABELS, rule_snapshot, rule_weights

TEXT = " ".join(f"{a}{b} {b}{a}?" for a in ("the", "on", "ing", "Mahal", "ko") for b in ("ha", "erea", "st", "ly", "tion")) + ". Masaya siya!"
SENTENCES = [["Kumusta", "po", "kayo", "?"], [], ["a"], ["mahabang-mahabang", "salita", "🙂", "."], ["x"] * 40]


def test_one_at_a_time_is_the_same(tmp_path):
    snapshot = rule_snapshot(str(tmp_path))
    tagger = inf.WindowTagger({"weights": os.path.join(snapshot.folder, snapshot.manifest["files"]["weights"])})
    together = inf.predict(tagger, SENTENCES, 0, 0.2, 0.5, None)
    for s, x in zip(SENTENCES, together, strict=True):
        alone = inf.predict(tagger, [s], 0, 0.2, 0.5, None)[0]
        assert alone["label_ids"] == x["label_ids"] and np.allclose(alone["chances"], x["chances"], rtol=0, atol=1e-12)
        assert len(x["label_ids"]) == len(s)
    assert len({i for x in together for i in x["label_ids"]}) > 1


def test_batches_and_decoding(spark, tmp_path):
    """Batch sizes agree, through Spark, and the labels are those that native decoding makes of the same logits."""
    snapshot = rule_snapshot(str(tmp_path))
    snapshot.ship(spark)
    df = spark.createDataFrame(list(enumerate(SENTENCES)) + [(9, None)], "i long, tokens array<string>").repartition(2)
    got = {n: {r["i"]: r["p"] for r in df.select("i", inf.tagged(F.col("tokens"), snapshot, batch=n).alias("p")).collect()} for n in (1, 3, 32)}
    for n in (1, 3):
        for i, x in got[32].items():
            assert x["labels"] == got[n][i]["labels"] and np.allclose(x["chances"], got[n][i]["chances"], rtol=0, atol=1e-12)
    assert got[32][1]["labels"] == got[32][9]["labels"] == []
    w, tagger = rule_weights(), inf.WindowTagger({"weights": os.path.join(snapshot.folder, snapshot.manifest["files"]["weights"])})
    assert np.array_equal(w["embedding"], tagger.embedding)
    rows = []
    for i, s in enumerate(SENTENCES):
        if s:
            ids, of = tagger.pieces(s)
            c, d = tagger.forward(np.array([ids]), np.ones((1, len(ids))))
            rows += [(i, k, c[0, p].tolist(), d[0, p].tolist()) for k, p in enumerate(inf.first_places(of, len(s)))]
    native = dc.decoded(spark.createDataFrame(rows, "i long, k int, correction array<double>, detection array<double>")).orderBy("i", "k").collect()
    assert [LABELS[r["label_id"]] for r in native] == [x for i in sorted(got[32]) for x in got[32][i]["labels"]]


def test_wrong_files_are_refused(spark, tmp_path):
    snapshot = rule_snapshot(str(tmp_path / "a"), most_pieces=99)
    assert rule_snapshot(str(tmp_path / "b"), most_pieces=99).digest == snapshot.digest != rule_snapshot(str(tmp_path / "b"), most_pieces=98).digest
    weights = os.path.join(snapshot.folder, snapshot.manifest["files"]["weights"])
    with open(weights, "ab") as f:
        f.write(b" ")
    # The name says what should be in it, so another file of that name can't have been shipped before.
    os.rename(weights, weights + "x")
    manifest = os.path.join(snapshot.folder, f"{snapshot.digest}.json")
    with open(weights + "x", "rb") as f:
        content = f.read()
    bad = inf.write_snapshot(str(tmp_path / "c"), {"weights": content}, LABELS)
    path = os.path.join(bad.folder, bad.manifest["files"]["weights"])
    with open(path, "ab") as f:
        f.write(b"more")
    bad.ship(spark)
    df = spark.createDataFrame([(["a", "b"],)], "tokens array<string>")
    with pytest.raises(Exception, match="weights is not"):
        df.select(inf.tagged(F.col("tokens"), bad)).collect()
    with open(manifest, "ab") as f:
        f.write(b" ")
    with pytest.raises(inf.SnapshotError):
        inf.tagged(F.col("tokens"), snapshot)
    with pytest.raises(inf.SnapshotError):
        inf.tagged(F.col("tokens"), bad, device="cuda")
    with pytest.raises(inf.SnapshotError):
        inf.write_snapshot(str(tmp_path), {}, ["$DELETE", "$DELETE"])


def test_long_sentences_are_not_cut(spark, tmp_path):
    snapshot = rule_snapshot(str(tmp_path), most_pieces=10)
    provide = inf.tagger_provider(spark, snapshot, strict=False)
    slots = spark.createDataFrame([(1, 0, ["ab"] * 10), (1, 1, ["ab"] * 11), (1, 2, ["a" * 41])], "doc_id long, slot int, tokens array<string>")
    assert [r["slot"] for r in provide(slots).collect()] == [0]
    with pytest.raises(Exception, match="11 pieces, at most 10"):
        inf.tagger_provider(spark, snapshot)(slots.where("slot < 2")).collect()


def test_passes_with_a_tagger(spark, tmp_path):
    """Five passes of the tagger over documents; each pass's output is the next one's input."""
    docs = spark.createDataFrame([(1, TEXT), (2, ""), (3, "   \n"), (4, None)], "doc_id long, text string")
    done = {r["doc_id"]: r for r in dc.corrected(docs, inf.tagger_provider(spark, rule_snapshot(str(tmp_path))), passes=5).collect()}
    assert [len(done[i]["passes"]) for i in (1, 2, 3, 4)] == [5, 0, 5, 0]
    for a, b in zip(done[1]["passes"], done[1]["passes"][1:], strict=False):
        assert a["output"] == b["input"]
    assert done[1]["passes"][0]["changes"] and all(p["output"] == "   \n" for p in done[3]["passes"])
