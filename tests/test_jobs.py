"""Jobs from files to files."""

import json

from quillmill.__main__ import main
from quillmill.functions.edits import labels_between
from quillmill.functions.labels import replayed_tokens
from quillmill.functions.segmentation import TOKEN
from quillmill.settings import Settings


def test_build_normalize_evaluate(spark, tmp_path, capsys):
    (tmp_path / "pairs.csv").write_text("wrong,right\naq,ako\nnmn,naman\n")
    (tmp_path / "words.txt").write_text("po\nako\n")
    (tmp_path / "sheet.csv").write_text("ID,Informal,Normalized,Category\n1,naol,sana all,slang\n")
    out = str(tmp_path / "a")
    assert main(["build", str(tmp_path / "pairs.csv"), str(tmp_path / "words.txt"), out, "--curated", str(tmp_path / "sheet.csv")], spark) == 0
    spark.createDataFrame([(1, "Naol po")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    assert main(["normalize", out, str(tmp_path / "docs"), str(tmp_path / "done")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "done")).first()["normalized"] == "Sana all po"
    (tmp_path / "eval.csv").write_text("input,target,category\nnaol po,sana all po,slang\n")
    assert main(["evaluate", str(tmp_path / "eval.csv"), str(tmp_path / "report"), "--artifacts", out, "--normalization", "both"], spark) == 0
    assert "overall" in capsys.readouterr().out
    told = json.loads(spark.read.text(str(tmp_path / "report" / "provenance")).first()[0])
    assert told["settings"]["normalization"] == "both" and len(told["files"]) == 1 and len(told["code"]["code_sha256"]) == 64
    assert main(["evaluate", str(tmp_path / "sheet.csv"), str(tmp_path / "r2")], spark) == 2


def test_settings(spark):
    spark.conf.set("quillmill.passes", "3")
    assert Settings.of(spark).passes == 3 and Settings.of(spark).keep_bias == 0.2
    spark.conf.unset("quillmill.passes")


def test_labels_between():
    for a, b in [("ako ako po", "ako po"), ("a b", "a, b."), ("a", "x y z"), ("mag aral", "mag-aral"), ("a b c", "c"), ("", "")]:
        labels = labels_between(a, b)
        assert list(replayed_tokens(TOKEN.findall(a), labels)) == TOKEN.findall(b)
    assert labels_between("b", "a b") is None
