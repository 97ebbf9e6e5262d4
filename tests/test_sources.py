"""Readers refuse what they must; writers keep their order."""

import hashlib
import json
import zipfile

import pytest

from quillmill.sources import readers as rd
from quillmill.sources import writers as wr


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_evaluation_rows(spark, tmp_path):
    path = put(tmp_path / "a.csv", '﻿Source,Reference,Category,Extra\n"a, b",c,Slangs,1\nd,e,,2\n')
    rows = rd.evaluation_rows(spark, path).orderBy("row_id").collect()
    assert [(r["row_id"], r["input"], r["types"], r["metadata"]) for r in rows] == [(1, "a, b", ["slang"], {"Extra": "1"}), (2, "d", [], {"Extra": "2"})]
    assert rd.evaluation_rows(spark, path, limit=1).count() == 1
    assert rd.evaluation_rows(spark, path, target="extra").first()["target"] == "1"


@pytest.mark.parametrize("text", ["input,target\n", "input,INPUT\na,b\n", "input,\na,b\n", "input,target\na,\n", "input,source,target\na,b,c\n", "x,y\na,b\n", "input,target,category\na,b,p;q\n", "input,target,category\na,b,Overall\n"])
def test_refused(spark, tmp_path, text):
    with pytest.raises(rd.SourceError):
        rd.evaluation_rows(spark, put(tmp_path / "a.csv", text))


def test_pairs_and_words(spark, tmp_path):
    got = rd.gold_pairs(spark, put(tmp_path / "g.csv", "ID,Informal,Normalized,Category\n1,aq,ako,slang\n")).collect()
    assert [tuple(r) for r in got] == [(1, "aq", "ako", "slang")]
    assert rd.gold_pairs(spark, put(tmp_path / "h.csv", "aq,ako\nnmn,naman\n")).count() == 2
    assert sorted(map(tuple, rd.training_pairs(spark, put(tmp_path / "t.csv", "wrong,right\nAQ, Ako \n")).collect())) == [("aq", "ako")]
    assert [r["word"] for r in rd.vocabulary(spark, put(tmp_path / "v.txt", "Ako\n\n ako \n")).collect()] == ["ako"]
    latin = rd.record_vocabulary(spark, put(tmp_path / "l.txt", "{'word': 'peña'}\n", "latin-1")).collect()
    assert [r["word"] for r in latin] == ["peña"]


def test_artifacts(spark, tmp_path):
    rules = put(tmp_path / "rules.json", json.dumps({"schema_version": 1, "max_ngram": 2, "candidate_cutoff": 9, "rules": {"aq": {"ako": 0.5, "aq": 0.5}}}))
    assert [(r["dst"], r["ord"]) for r in rd.rules_artifact(spark, rules).orderBy("ord").collect()] == [("ako", 0), ("aq", 1)]
    with pytest.raises(rd.SourceError):
        rd.rules_artifact(spark, rules, version=2)
    digest = hashlib.sha256((tmp_path / "rules.json").read_bytes()).hexdigest()
    put(tmp_path / "metadata.json", json.dumps({"schema_version": 2, "artifacts": {"rules.json": {"sha256": digest}}}))
    rd.checked_artifacts(spark, str(tmp_path))
    put(tmp_path / "metadata.json", json.dumps({"schema_version": 2, "artifacts": {"rules.json": {"sha256": "0"}}}))
    with pytest.raises(rd.SourceError):
        rd.checked_artifacts(spark, str(tmp_path))


def test_archives_and_uploads(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "a,b")
        z.writestr("y.txt", "ü".encode("latin-1"))
    assert sorted((r["member"], r["text"]) for r in rd.zip_members(spark, str(tmp_path / "a.zip")).collect()) == [("x.csv", "a,b"), ("y.txt", "ü")]
    folder = tmp_path / "up"
    folder.mkdir()
    put(folder / "a.txt", "oo")
    put(folder / "b.txt", "x" * 6000)
    put(folder / "c.pdf", "?")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(folder / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>A</w:t></w:r></w:p><w:p><w:r><w:t>B</w:t></w:r></w:p></w:body></w:document>')
    got = {r["path"][-5:]: (r["text"], r["status"]) for r in rd.uploads(spark, str(folder)).collect()}
    assert got == {"a.txt": ("oo", 200), "b.txt": (None, 413), "c.pdf": (None, 400), ".docx": ("A\nB", 200)}


def test_tag_files(spark, tmp_path):
    r = rd.tagged_tokens(spark, put(tmp_path / "t.txt", "$STARTSEPL|||SEPR$KEEP aSEPL|||SEPR$APPEND_bSEPL__SEPR$DELETE\n")).first()
    assert (r["tokens"], r["tags"]) == (["$START", "a"], ["$KEEP", "$APPEND_b"])
    forms = rd.verb_forms(spark, put(tmp_path / "v.txt", "go_went:VB_VBD\ngo_wend:VB_VBD\n")).collect()
    assert [tuple(f) for f in forms] == [("go", "went", "VB_VBD")]
    labels = rd.label_vocabulary(spark, put(tmp_path / "l.txt", "$KEEP\n$DELETE\n@@PADDING@@\n$X\n")).orderBy("id").collect()
    assert [r["label"] for r in labels] == ["<OOV>", "$KEEP", "$DELETE", "$X", "<PAD>"]


def test_parquet_guards(spark, tmp_path):
    path = str(tmp_path / "rows_test.parquet")
    spark.range(2).write.parquet(path)
    with pytest.raises(rd.SourceError):
        rd.pinned_parquet(spark, path)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0.5)], "b long, a string, c double")
    wr.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":null,"b":1,"c":0.5}'
    with pytest.raises(Exception, match="(?i)exists"):
        wr.write_json_lines(df, str(tmp_path / "j"))
    wr.write_csv(df, str(tmp_path / "c"), ["b", "c"])
    assert sorted({r[0] for r in spark.read.text(str(tmp_path / "c")).collect()}) == ["1,0.5", "b,c"]
    assert "N/A" in wr.console_table(df)
    with pytest.raises(Exception, match="no word for"):
        wr.write_json_lines(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "n"))
    with pytest.raises(ValueError, match="over its input"):
        wr.write_reports(str(tmp_path), df, df, df, df, [str(tmp_path / "in.csv")])
