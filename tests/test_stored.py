"""Tables that change a document at a time."""

import os

from pyspark.sql import functions as F

from quillmill.operators.stored import Stored, drop_documents, put_documents

DOCUMENTS = "id long, title string, content string, updated_at long"


def files(folder):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(folder) for n in names if n.startswith("part-")}


def test_changes_rewrite_their_buckets_alone(spark, tmp_path):
    documents, suggestions = Stored(spark, f"{tmp_path}/d", "id", 8), Stored(spark, f"{tmp_path}/s", "document_id", 8)
    rows = spark.createDataFrame([(i, f"t{i}", "isa dalawa", 0) for i in range(40)], DOCUMENTS)
    documents.create(rows.withColumn("word_count", F.lit(2).cast("long")))
    suggestions.create(spark.createDataFrame([(i, i * 10 + k, "aq") for i in range(40) for k in range(2)], "document_id long, id long, original string"))
    before = files(tmp_path / "d"), files(tmp_path / "s")
    put_documents(documents, suggestions, spark.createDataFrame([(3, "new", "isa dalawa tatlo", 5)], DOCUMENTS), spark.createDataFrame([(3, 999, "po"), (4, 998, "x")], "document_id long, id long, original string"))
    after = files(tmp_path / "d"), files(tmp_path / "s")
    for old, new in zip(before, after, strict=True):
        gone = {os.path.dirname(f) for f in old if new.get(f) != old[f]}
        assert len(gone) == 1 and all(os.path.dirname(f) in gone for f in new if f not in old)
    found = {r["id"]: r for r in documents.rows().collect()}
    assert len(found) == 40 and (found[3]["title"], found[3]["word_count"]) == ("new", 3) and found[4]["title"] == "t4"
    own = {}
    for r in suggestions.rows().collect():
        own.setdefault(r["document_id"], []).append(r["id"])
    # A suggestion of a document that did not change is not put in.
    assert own[3] == [999] and sorted(own[4]) == [40, 41] and len(own) == 40


def test_new_blank_and_dropped_documents(spark, tmp_path):
    documents, suggestions = Stored(spark, f"{tmp_path}/d", "id", 64), Stored(spark, f"{tmp_path}/s", "document_id", 64)
    documents.create(spark.createDataFrame([(1, "a", "x y", 0, 2)], DOCUMENTS + ", word_count long"))
    suggestions.create(spark.createDataFrame([(1, 5, "x")], "document_id long, id long, original string"))
    put_documents(documents, suggestions, spark.createDataFrame([(2, "b", "po", 1), (1, "a", "  ", 1)], DOCUMENTS), spark.createDataFrame([(1, 6, "x"), (2, 7, "po")], "document_id long, id long, original string"))
    assert {(r["id"], r["word_count"]) for r in documents.rows().collect()} == {(1, 0), (2, 1)}
    assert [tuple(r) for r in suggestions.rows().select("document_id", "id").collect()] == [(2, 7)]
    drop_documents(documents, suggestions, spark.createDataFrame([(2,), (9,)], "id long"))
    assert [r["id"] for r in documents.rows().collect()] == [1] and suggestions.rows().isEmpty()
    assert [n for n in os.listdir(tmp_path) if "staged" in n] == []
