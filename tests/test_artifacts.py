"""Artifacts that are checked, kept to, and told of."""

import hashlib
import json

import pytest

from quillmill import artifacts as ar
from quillmill.sources.readers import SourceError


def folder_of(path, **files):
    path.mkdir()
    for name, content in files.items():
        (path / f"{name}.json").write_text(content)
    digest = lambda c: hashlib.sha256(c.encode()).hexdigest()
    (path / "metadata.json").write_text(json.dumps({"schema_version": 2, "artifacts": {f"{n}.json": {"sha256": digest(c)} for n, c in files.items()}}))
    return str(path)


def test_load_and_conflict(spark, tmp_path):
    one, two = folder_of(tmp_path / "one", rules="{}", curated="[]"), folder_of(tmp_path / "two", rules="{ }")
    first = ar.load(spark, "rules-a", one, ("rules.json",))
    assert ar.load(spark, "rules-a", one) is first and dict(first.files)["rules.json"] == hashlib.sha256(b"{}").hexdigest()
    with pytest.raises(ar.Conflict):
        ar.load(spark, "rules-a", two)
    ar.unload(spark, "rules-a")
    assert ar.load(spark, "rules-a", two).folder == two
    ar.unload(spark, "rules-a")


def test_nothing_unchecked_is_loaded(spark, tmp_path):
    good, bad, none = folder_of(tmp_path / "good", rules="{}"), folder_of(tmp_path / "bad", rules="{}", more="x"), folder_of(tmp_path / "none")
    (tmp_path / "bad" / "more.json").write_text("y")
    with pytest.raises(SourceError, match="more.json"):
        ar.load(spark, "b", bad)
    with pytest.raises(SourceError, match="any artifact"):
        ar.load(spark, "n", none)
    with pytest.raises(SourceError, match="curated.json"):
        ar.load(spark, "g", good, ("rules.json", "curated.json"))
    state = ar.readiness(spark, {"g": good, "b": bad, "gone": str(tmp_path / "gone")})
    assert state["g"] == "ready" and state["b"].startswith("SourceError") and state["gone"] != "ready"
    ar.unload(spark, "g")


def test_provenance(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n")
    loaded = ar.load(spark, "p", folder_of(tmp_path / "p", rules="{}"))
    row = ar.provenance(spark, [str(tmp_path / "in.csv")], {"passes": 5}, (loaded,)).first()
    assert list(row["files"].values()) == [hashlib.sha256(b"a,b\n").hexdigest()] and row["settings"] == {"passes": "5"}
    assert list(row["artifacts"]) == ["p/rules.json"] and len(row["code"]["code_sha256"]) == 64
    assert ar.provenance(spark, [], {}).first()["files"] == {}
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.py").write_text("x = 1\n")
    before = ar.code_state(str(tmp_path / "code"))["code_sha256"]
    (tmp_path / "code" / "a.py").write_text("x = 2\n")
    assert ar.code_state(str(tmp_path / "code"))["code_sha256"] != before
    ar.unload(spark, "p")
