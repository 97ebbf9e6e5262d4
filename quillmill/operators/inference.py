"""Batched model inference: labels and error chances of tokenized sentences by a tagger that executors load once a worker.

A snapshot is a set of files named by their SHA-256 and a manifest that lists them, with the labels, the gates and the
length limit that belong to them. A model is asked for by the digest of its manifest. Spark carries the files to the
executors, and each worker checks every digest before it loads anything, so that no other file can take part.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark import SparkFiles
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decoding import ERROR_GATE, KEEP_BIAS, LabelProvider

BATCH = 32
#: Tokens hold no white space, so that a sentence can travel as one string.
BETWEEN = "\n"


class SnapshotError(ValueError):
    """Files or settings that are not those the snapshot was pinned to."""


def sha256_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@dataclass(frozen=True)
class Snapshot:
    """The folder of a snapshot on the driver, and the digest of its manifest."""

    folder: str
    digest: str

    @property
    def manifest(self) -> dict:
        path = os.path.join(self.folder, f"{self.digest}.json")
        if not os.path.isfile(path) or sha256_of(path) != self.digest:
            raise SnapshotError(f"no manifest {self.digest} in {self.folder}")
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def ship(self, spark: SparkSession) -> None:
        """Hands the files to Spark, which brings them to every executor, also to those that come later."""
        manifest = self.manifest
        for name in [*manifest["files"].values(), f"{self.digest}.json"]:
            spark.sparkContext.addFile(os.path.join(self.folder, name))


def write_snapshot(folder: str, files: Mapping[str, bytes], labels: Sequence[str], most_pieces: int | None = None, keep: str = "$KEEP", bias: float = KEEP_BIAS, gate: float = ERROR_GATE) -> Snapshot:
    """Stores files (by the name that the tagger asks for) and settings; the same content gives the same digest."""
    if len(set(labels)) != len(labels) or keep not in labels or len(labels) < 2:
        raise SnapshotError("labels are distinct, two at least, and have the one that keeps a token")
    os.makedirs(folder, exist_ok=True)
    names = {}
    for name, content in sorted(files.items()):
        names[name] = hashlib.sha256(content).hexdigest()
        _written(os.path.join(folder, names[name]), content)
    manifest = json.dumps({"files": names, "labels": list(labels), "keep": keep, "bias": bias, "gate": gate, "most_pieces": most_pieces}, sort_keys=True, ensure_ascii=False).encode()
    digest = hashlib.sha256(manifest).hexdigest()
    _written(os.path.join(folder, f"{digest}.json"), manifest)
    return Snapshot(folder, digest)


def _written(path: str, content: bytes) -> None:
    with open(f"{path}.part", "wb") as f:
        f.write(content)
    os.replace(f"{path}.part", path)


def shipped_files(digest: str) -> tuple[dict, dict[str, str]]:
    """The manifest, and the path of each of its files on this worker; SnapshotError unless all digests are right."""
    path = SparkFiles.get(f"{digest}.json")
    if not os.path.isfile(path) or sha256_of(path) != digest:
        raise SnapshotError(f"the manifest is not {digest}")
    with open(path, encoding="utf-8") as f:
        manifest = json.load(f)
    paths = {name: SparkFiles.get(own) for name, own in manifest["files"].items()}
    for name, own in manifest["files"].items():
        if not os.path.isfile(paths[name]) or sha256_of(paths[name]) != own:
            raise SnapshotError(f"{name} is not {own}")
    return manifest, paths


class Tagger(Protocol):
    """A model with two heads. `devices` lists where it can run, the best first."""

    devices: tuple[str, ...]

    def pieces(self, words: Sequence[str]) -> tuple[list[int], list[int | None]]:
        """The ids of a sentence's pieces, and for each the number of its word, None for special pieces."""
        ...

    def forward(self, ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of labels (sentences, pieces, labels) and of right and wrong (sentences, pieces, 2) of padded ids."""
        ...


def device_for(wanted: str, devices: Sequence[str]) -> str:
    """The device to use: the best there is for `auto`, else the one named; SnapshotError if the model can't run there."""
    if wanted == "auto":
        return devices[0]
    if wanted not in devices:
        raise SnapshotError(f"no device {wanted}; there is {', '.join(devices)}")
    return wanted


class WindowTagger:
    """A small tagger in numpy: pieces of a few letters, hashed into an embedding, mixed with the piece before, and two
    linear heads. Its file `weights` is an npz of embedding, correction, correction_bias, detection, detection_bias."""

    devices = ("cpu",)

    def __init__(self, paths: Mapping[str, str], device: str = "cpu", letters: int = 4):
        self.device, self.letters = device, letters
        with np.load(paths["weights"]) as w:
            self.embedding, self.correction, self.correction_bias, self.detection, self.detection_bias = (w[k] for k in ("embedding", "correction", "correction_bias", "detection", "detection_bias"))

    def pieces(self, words: Sequence[str]) -> tuple[list[int], list[int | None]]:
        ids, of = [], []
        for i, word in enumerate(words):
            for at in range(0, len(word), self.letters):
                ids.append(sum(map(ord, word[at : at + self.letters])) % len(self.embedding))
                of.append(i)
        return ids, of

    def forward(self, ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.embedding[ids] * mask[..., None]
        before = np.zeros_like(own)
        before[:, 1:] = own[:, :-1]
        hidden = np.maximum(own + before / 2, 0)
        return hidden @ self.correction + self.correction_bias, hidden @ self.detection + self.detection_bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def first_places(of: Sequence[int | None], words: int) -> list[int]:
    """The place of each word's first piece; ValueError unless every word has one."""
    first: dict[int, int] = {}
    for place, word in enumerate(of):
        if word is not None:
            first.setdefault(word, place)
    if sorted(first) != list(range(words)):
        raise ValueError("the pieces don't have every token exactly once")
    return [first[i] for i in range(words)]


def predict(tagger: Tagger, sentences: Sequence[Sequence[str]], keep: int, bias: float, gate: float, most_pieces: int | None) -> list[dict]:
    """label_ids, chances, problem of each sentence, all of them in one padded batch.

    A sentence of more pieces than most_pieces is not cut: it gets a problem and no labels. One without tokens never
    reaches the model.
    """
    out = [{"label_ids": [], "chances": [], "problem": None} for _ in sentences]
    taken, encoded = [], []
    for i, words in enumerate(sentences):
        if words:
            ids, of = tagger.pieces(words)
            if most_pieces is not None and len(ids) > most_pieces:
                out[i]["problem"] = f"{len(ids)} pieces, at most {most_pieces}"
                continue
            taken.append((i, first_places(of, len(words))))
            encoded.append(ids)
    if not taken:
        return out
    longest = max(map(len, encoded))
    padded, mask = np.zeros((len(taken), longest), np.int64), np.zeros((len(taken), longest))
    for row, ids in enumerate(encoded):
        padded[row, : len(ids)], mask[row, : len(ids)] = ids, 1
    correction, detection = tagger.forward(padded, mask)
    chances = _softmax(detection)[..., 1]
    own = _softmax(correction)
    own[..., keep] += bias
    best = own.argmax(-1)
    for row, (i, places) in enumerate(taken):
        wrong = chances[row, places]
        out[i]["chances"] = wrong.tolist()
        out[i]["label_ids"] = np.where(wrong >= gate, best[row, places], keep).tolist()
    return out


ANSWER = T.StructType([T.StructField("label_ids", T.ArrayType(T.IntegerType())), T.StructField("chances", T.ArrayType(T.DoubleType())), T.StructField("problem", T.StringType())])


def tagged(tokens: Column, snapshot: Snapshot, tagger: Callable[..., Tagger] = WindowTagger, batch: int = BATCH, device: str = "auto") -> Column:
    """labels, chances, problem of an array of tokens; null gives empty labels. `batch` sentences go through the model
    at once; the answers don't depend on it. snapshot.ship() comes first."""
    digest, manifest = snapshot.digest, snapshot.manifest
    if batch < 1:
        raise ValueError("a batch has one sentence at least")
    device_for(device, tagger.devices)

    def load():
        own, paths = shipped_files(digest)
        model = tagger(paths, device=device_for(device, tagger.devices))
        keep = own["labels"].index(own["keep"])

        def run(sentences):
            found = predict(model, [s.split(BETWEEN) if s else [] for s in sentences], keep, own["bias"], own["gate"], own["most_pieces"])
            return [{"label_ids": np.array(x["label_ids"], np.int32), "chances": np.array(x["chances"], np.float64), "problem": x["problem"] or ""} for x in found]

        return run

    found = predict_batch_udf(load, return_type=ANSWER, batch_size=batch)(F.coalesce(F.array_join(tokens, BETWEEN), F.lit("")))
    names = F.array(*[F.lit(x) for x in manifest["labels"]])
    return F.transform(F.array(found), lambda p: F.struct(F.transform(p["label_ids"], lambda i: F.get(names, i)).alias("labels"), p["chances"].alias("chances"), F.nullif(p["problem"], F.lit("")).alias("problem")))[0]


def tagger_provider(spark: SparkSession, snapshot: Snapshot, key: str = "doc_id", strict: bool = True, **options) -> LabelProvider:
    """A label provider for correction passes. A sentence that the model can't take fails the job, or stays as it is
    unless strict."""
    snapshot.ship(spark)

    def provide(slots: DataFrame) -> DataFrame:
        found = slots.select(key, "slot", tagged(F.col("tokens"), snapshot, **options).alias("p"))
        if strict:
            labels = F.when(F.col("p.problem").isNotNull(), F.raise_error(F.concat(F.lit("a sentence has "), F.col("p.problem")))).otherwise(F.col("p.labels"))
            return found.select(key, "slot", labels.alias("labels"), "p.chances")
        return found.where("p.problem IS NULL").select(key, "slot", "p.labels", "p.chances")

    return provide
