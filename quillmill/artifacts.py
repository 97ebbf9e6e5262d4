"""Loaded artifacts: checked before use, one set a session, and what a run was made with.

A session that has loaded artifacts under a name keeps to them: the same folder and digests again give the same tables,
anything else under that name is a conflict. What is missing, unnamed or of another digest is never loaded.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.readers import SourceError, digests

METADATA = "schema_version int, artifacts map<string,struct<sha256:string>>"


class Conflict(SourceError):
    """Other artifacts than those that the session has loaded."""


@dataclass(frozen=True)
class Loaded:
    """What stands under a name: the folder, the digest of each file, and that of the metadata."""

    name: str
    folder: str
    files: tuple[tuple[str, str], ...]
    metadata: str


_LOADED: dict[tuple[str, str], Loaded] = {}


def load(spark: SparkSession, name: str, folder: str, required: tuple[str, ...] = (), metadata: str = "metadata.json") -> Loaded:
    """The artifacts of a folder, each of the digest that its metadata records. SourceError if a file is missing or
    another one, or if the metadata names none or not all that are required; Conflict if others are loaded under the name."""
    raw = spark.read.json(f"{folder}/{metadata}", multiLine=True, schema=METADATA).first()
    recorded = {k: v["sha256"] for k, v in ((raw["artifacts"] if raw else None) or {}).items() if v is not None}
    if not recorded or set(required) - set(recorded):
        raise SourceError(f"{metadata} does not record {', '.join(sorted(set(required) - set(recorded))) or 'any artifact'}")
    found = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in digests(spark, [f"{folder}/{n}" for n in (*sorted(recorded), metadata)]).collect()}
    wrong = sorted(n for n, digest in recorded.items() if found.get(n) != digest)
    if wrong:
        raise SourceError(f"{', '.join(wrong)}: not the files that the metadata describes")
    mine = Loaded(name, folder.rstrip("/"), tuple(sorted(recorded.items())), found[metadata])
    known = _LOADED.setdefault((spark.sparkContext.applicationId, name), mine)
    if known != mine:
        raise Conflict(f"{name} has been loaded from {known.folder} with metadata {known.metadata}, not from {mine.folder} with {mine.metadata}")
    return known


def unload(spark: SparkSession, name: str) -> None:
    _LOADED.pop((spark.sparkContext.applicationId, name), None)


def readiness(spark: SparkSession, wanted: dict[str, str]) -> dict[str, str]:
    """name -> `ready`, or why not, of artifacts by name and folder. Nothing is ready that would not load."""
    out = {}
    for name, folder in wanted.items():
        try:
            load(spark, name, folder)
            out[name] = "ready"
        except Exception as e:  # whatever the store says counts as not ready
            out[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return out


def code_state(root: str | None = None) -> dict[str, str]:
    """The code that runs: a digest of the package's sources by path, and where it is a checkout the commit and whether
    it has changes."""
    root = root or os.path.dirname(os.path.abspath(__file__))
    whole = hashlib.sha256()
    for folder, folders, names in os.walk(root):
        folders.sort()
        for n in sorted(names):
            if n.endswith(".py"):
                path = os.path.join(folder, n)
                with open(path, "rb") as f:
                    own = hashlib.file_digest(f, "sha256").hexdigest()
                whole.update(f"{os.path.relpath(path, root)}:{own}\n".encode())
    state = {"code_sha256": whole.hexdigest()}
    ask = lambda *args: subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=20)
    try:
        commit = ask("rev-parse", "HEAD")
        if commit.returncode == 0:
            state["git_commit"] = commit.stdout.strip()
            state["git_changes"] = str(bool(ask("status", "--porcelain", "--", root).stdout.strip())).lower()
    except OSError:
        pass  # no git here: the digest says what ran
    return state


def provenance(spark: SparkSession, inputs: list[str], settings: dict[str, str], loaded: tuple[Loaded, ...] = ()) -> DataFrame:
    """One row: files (path -> digest) of the inputs, artifacts (name/file -> digest), settings, and code (as of code_state)."""
    text = lambda pairs: F.create_map(*[F.lit(x) for k, v in sorted(pairs.items()) for x in (k, str(v))]) if pairs else F.create_map().cast("map<string,string>")
    files = digests(spark, inputs).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha256")))).alias("files")) if inputs else spark.range(1).select(text({}).alias("files"))
    own = {f"{x.name}/{n}": digest for x in loaded for n, digest in x.files}
    return files.withColumns({"artifacts": text(own), "settings": text(settings), "code": text(code_state())})
