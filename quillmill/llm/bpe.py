"""Byte-level BPE encoding and decoding over numpy matrices.

A text is cut by the tokenizer's pattern. The distinct matches that a worker has not met before are encoded together:
they are sorted into buckets by length, each bucket is a padded matrix of token ids, one row a match, and in each round
every row merges its leftmost pair of least rank. Pair ranks come from an open-addressing hash table in three numpy
arrays. After a merge, rows move left over the freed column, and rows without a mergeable pair leave the matrix.

A round costs a row as many steps as the row is long, so that matrices are for matches of up to `LONG` bytes. A longer
match (letters without a space between them, encoded data) is merged alone, in the same order, by a heap of pairs over
a linked list, in n log n steps.

What a worker remembers is bounded: the table of encoded matches is emptied when it holds `CACHE` entries, and matches
longer than `LONG` characters are never remembered.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

CACHE = 400_000
LONG = 512
#: Cells of one matrix at most; a bucket with more is done in parts.
CELLS = 1 << 22
NONE = np.int64(1) << np.int64(40)
#: A vocabulary file may be broadcast up to this size.
FILE_BYTES = 32 << 20


def rust_spaces(pattern: str) -> str:
    r"""The pattern with \s and \S as the Unicode property White_Space, which they mean in the reference library."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Pairs:
    """(left id, right id) -> merged id, by linear probing. The merged id is the rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int64)
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slot(keys)
        values = merged.astype(np.int64)
        while len(keys):
            free = self.keys[slots] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(np.where(free, slots, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            keys, values, slots = keys[~put], values[~put], (slots[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, NONE where there is none or either side is padding (-1)."""
        out = np.full(left.shape, NONE, np.int64)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        flat = out.ravel()
        keys = (left.ravel()[at].astype(np.int64) << 32) | right.ravel()[at]
        slots = self._slot(keys)
        while len(at):
            held = self.keys[slots]
            hit = held == keys
            flat[at[hit]] = self.values[slots[hit]]
            go = ~hit & (held >= 0)
            at, keys, slots = at[go], keys[go], (slots[go] + 1) & self.mask
        return out


class ByteBPE:
    """Encoder and decoder for one rank file (bytes in base64, then the rank, on each line) and one pattern."""

    def __init__(self, file: bytes, pattern: str):
        lines = (line.split() for line in file.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(rust_spaces(pattern)).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        self.pairs = Pairs(left, right, merged)
        self.cache: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece, by rounds over length-bucketed matrices."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            known = self.ranks.get(p)
            if known is not None:
                out[i] = np.array([known], np.int64)
            elif not p:
                out[i] = np.zeros(0, np.int64)
            elif len(p) > LONG:
                out[i] = self._alone(p)
            else:
                todo.append(i)
        todo.sort(key=lambda i: len(pieces[i]))
        start = 0
        while start < len(todo):
            width = max(8, 1 << (len(pieces[todo[start]]) - 1).bit_length())
            stop = start
            while stop < len(todo) and len(pieces[todo[stop]]) <= width and (stop == start or (stop - start + 1) * width <= CELLS):
                stop += 1
            self._bucket(pieces, todo[start:stop], width, out)
            start = stop
        return out

    def _alone(self, piece: bytes) -> np.ndarray:
        """The ids of one long piece: the leftmost pair of least rank is merged until there is none.

        The heap holds rank * length + place of each pair; an entry whose pair has changed since is passed over.
        """
        n = len(piece)
        first = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.rank(first[:-1], first[1:])
        ids, rank = first.tolist(), [*ranks.tolist(), int(NONE)]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        at = np.flatnonzero(ranks != NONE)
        heap = np.sort(ranks[at] * n + at).tolist()
        known: dict[tuple[int, int], int] = {}

        def pair_rank(left: int, right: int) -> int:
            found = known.get((left, right))
            if found is None:
                found = known[left, right] = int(self.pairs.rank(np.array([left]), np.array([right]))[0])
            return found

        none = int(NONE)
        while heap:
            best, i = divmod(heapq.heappop(heap), n)
            if rank[i] != best:
                continue
            j = after[i]
            ids[i], rank[j] = best, none
            k = after[i] = after[j]
            rank[i] = none
            if k >= 0:
                before[k] = i
                rank[i] = pair_rank(best, ids[k])
                if rank[i] != none:
                    heapq.heappush(heap, rank[i] * n + i)
            h = before[i]
            if h >= 0:
                rank[h] = pair_rank(ids[h], best)
                if rank[h] != none:
                    heapq.heappush(heap, rank[h] * n + h)
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return np.array(out, np.int64)

    def _bucket(self, pieces: list[bytes], rows: list[int], width: int, out: list) -> None:
        lengths = np.array([len(pieces[i]) for i in rows], np.int64)
        raw = np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)
        ids = np.full((len(rows), width), -1, np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[raw]
        rank = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(rows))
        while len(live):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), at]
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[live[k]]] = ids[k, : lengths[k]].copy()
                go = ~done
                live, ids, rank, lengths, at, best = live[go], ids[go], rank[go], lengths[go], at[go], best[go]
                if not len(live):
                    return
                most = int(lengths.max())
                if most <= ids.shape[1] // 2:
                    ids, rank = np.ascontiguousarray(ids[:, :most]), np.ascontiguousarray(rank[:, : most - 1])
            n, width = ids.shape
            every = np.arange(n)
            ids[every, at] = best
            # Each row closes the gap right of its merge.
            columns = np.arange(width - 1)
            ids[:, :-1] = np.where(columns > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            if width > 2:
                rank[:, :-1] = np.where(columns[:-1] > at[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            lengths = lengths - 1
            for column in (at - 1, at):
                inside = (column >= 0) & (column < width - 1)
                r, c = every[inside], column[inside]
                rank[r, c] = self.pairs.rank(ids[r, c], ids[r, c + 1])

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of each distinct piece as little-endian unsigned 32-bit integers; long pieces aren't remembered."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(pieces)
        coded = {p: ids.astype("<u4").tobytes() for p, ids in zip(new, self.merge([p.encode() for p in new]), strict=True)}
        long = {p: c for p, c in coded.items() if len(p) > LONG}
        self.cache.update((p, c) for p, c in coded.items() if len(p) <= LONG)
        return long

    def encode(self, text: str | None) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers; none for None."""
        if not text:
            return b""
        pieces = self.split(text)
        long = self.learn(set(pieces))
        if not long:
            return b"".join(map(self.cache.__getitem__, pieces))
        return b"".join(self.cache[p] if p in self.cache else long[p] for p in pieces)

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """encode() of each text; new pieces of many texts share their matrices."""
        group, held = [], 0
        for text in texts:
            group.append(text)
            held += len(text or "")
            if held > 1 << 20:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str | None]) -> Iterator[bytes]:
        cut = [self.split(t) if t else [] for t in texts]
        long = self.learn(set().union(*cut)) if cut else {}
        cache = self.cache
        for pieces in cut:
            yield b"".join([cache[p] if p in cache else long[p] for p in pieces] if long else map(cache.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(file: bytes, pattern: str) -> ByteBPE:
    """One codec a worker and vocabulary; the tables are built once."""
    return ByteBPE(file, pattern)


def read_vocabulary(path: str) -> bytes:
    """The file's bytes, read on the driver to be broadcast; refused above FILE_BYTES."""
    with open(path, "rb") as f:
        data = f.read(FILE_BYTES + 1)
    if len(data) > FILE_BYTES:
        raise ValueError(f"{path} is larger than {FILE_BYTES} bytes")
    return data


def bpe_codec(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text; more columns are ignored): doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids (binary, little-endian unsigned 32-bit integers).

    Special tokens are never made: their strings are ordinary text. A null text counts as empty and has no ids; both
    digests are then those of no bytes. Equal rows give equal results, an empty table an empty result. The decoded
    bytes come from the ids alone.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    results = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "binary"} if keep_ids else {})

    def make():
        own = codec(file.value, pattern)

        def run(texts: list[str | None]):
            ids = list(own.encode_batch(texts))
            return None, {"ids": ids, "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]}

        return run

    return map_texts(docs, ["doc_id"], results, make)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_codec(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op3_bpe_codec": op3_bpe_codec}
ORACLES: dict[str, str] = {}
