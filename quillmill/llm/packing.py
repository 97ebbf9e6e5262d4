"""Packing of token sequences: shortest-pack-first over the histogram of lengths.

Documents become ids and are cut into pieces of at most `width` ids: full pieces, then the rest. All that the packing
looks at is the histogram of piece lengths, of `width` bins at most, so it fits the driver at any corpus size. Lengths
are placed longest first: the pieces of one length go on top of the fullest-room (shortest) open packs, whole counts at
a time, so that a few thousand packing patterns describe all sequences. Pieces are then numbered within their length,
by any number of tasks, and joined with the patterns by that rank.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import LONG, read_vocabulary, rust_spaces
from .common import hold, map_texts, ranked, table

WIDTH = 2048
#: Pieces that a worker remembers, about 200 bytes each.
CACHE = 800_000
#: What a byte-level pre-tokenizer with a pattern of its own cuts at: a fixed value of the format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The rank path's regular expressions run out of stack on longer white space.
SPACES = regex.compile(r"\s{8192}")
#: Pieces in one call of the library.
ROW = 10_000
END = 1


class WholeTokenizer:
    """Ids by the tokenizers library, a whole text at a time. Strings of the file's added tokens in a text are those tokens."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode())

    def encode_group(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cut_pattern(file: dict) -> str | None:
    """The pattern whose matches the file's pre-tokenizer encodes alone, or None if it has another way."""
    cutter, model = file.get("pre_tokenizer") or {}, file["model"]
    if file.get("normalizer") or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    if cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space"):
        return BYTE_LEVEL
    return None


class PieceTokenizer:
    """The same ids, looked up by pre-token.

    A byte-level tokenizer encodes each match of its pattern alone, so the library is asked once for each distinct
    match, and a text's ids are those of its matches in a row. What a worker remembers is bounded as in bpe.py. A text
    that has the string of an added token goes to the library whole.
    """

    def __init__(self, file: bytes, pattern: str):
        parsed = json.loads(file)
        if cut_pattern(parsed) != pattern:
            raise ValueError("the file's pre-tokenizer does not cut at this pattern")
        self.whole = WholeTokenizer(file)
        self.tokenizer = self.whole.tokenizer
        added = [t["content"] for t in parsed.get("added_tokens", [])]
        self.added = regex.compile("|".join(map(regex.escape, added))).search if added else lambda text: None
        self.split = regex.compile(rust_spaces(pattern)).findall
        self.cache: dict[str, bytes] = {}

    def encode_pieces(self, new: list[str]) -> dict[str, bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers.

        Pieces of a space and something else still part where they did when they are put in a row, which saves a call
        for each; should a row part otherwise, its pieces are encoded one by one.
        """
        coded: dict[str, bytes] = {}
        spaced = [p for p in new if len(p) > 1 and p[0] == " " and not p[1].isspace()]
        alone = [p for p in new if not (len(p) > 1 and p[0] == " " and not p[1].isspace())]
        for start in range(0, len(spaced), ROW):
            row = spaced[start : start + ROW]
            found = self.tokenizer.encode("".join(row), add_special_tokens=False)
            words = np.array(found.word_ids, np.int64)
            if len(words) and words[-1] == len(row) - 1:
                raw = np.array(found.ids, "<u4").tobytes()
                cuts = (4 * np.searchsorted(words, np.arange(len(row) + 1))).tolist()
                coded.update(zip(row, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
            else:
                alone += row
        coded.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True))
        return coded

    def encode_group(self, texts: list[str]) -> Iterator[bytes]:
        plain = [not self.added(t) for t in texts]
        coded = self.encode_plain([t for t, p in zip(texts, plain, strict=True) if p])
        for text, p in zip(texts, plain, strict=True):
            yield next(coded) if p else next(self.whole.encode_group([text]))

    def encode_plain(self, texts: list[str]) -> Iterator[bytes]:
        cut_texts = [self.split(t) if t else [] for t in texts]
        wanted = set().union(*cut_texts)
        new = sorted(p for p in wanted if p not in self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = sorted(wanted)
        coded = self.encode_pieces(new)
        long = {p: c for p, c in coded.items() if len(p) > LONG}
        self.cache.update((p, c) for p, c in coded.items() if len(p) <= LONG) if long else self.cache.update(coded)
        cache = self.cache
        for pieces in cut_texts:
            yield b"".join([cache[p] if p in cache else long[p] for p in pieces] if long else map(cache.__getitem__, pieces))


class RankTokenizer:
    """The same ids, sooner, where the file's merges are ordered by id: by ranks, with the tiktoken library.

    Texts with the string of an added token, or with white space that its regular expressions run out of stack on, go
    to the tokenizers library whole.
    """

    def __init__(self, file: bytes, pattern: str):
        import tiktoken

        model = json.loads(file)["model"]
        plain = {c: b for b, c in _byte_names().items()}
        tokens = [*plain, *(a + b for a, b in _merges(model))]
        ranks = {bytes(plain[c] for c in t): model["vocab"][t] for t in tokens}
        self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = PieceTokenizer(file, pattern)

    def encode_group(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if self.pieces.added(text) or SPACES.search(text):
                yield from self.pieces.whole.encode_group([text])
            else:
                yield np.array(self.ranked.encode_ordinary(text), "<u4").tobytes()


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


@lru_cache(maxsize=2)
def piece_tokenizer(file: bytes, pattern: str) -> RankTokenizer | PieceTokenizer | WholeTokenizer:
    """The soonest that gives the library's ids for this file: by ranks, by matches of the pattern, or whole texts."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    parsed = json.loads(file)
    if cut_pattern(parsed) != pattern:
        return WholeTokenizer(file)
    return RankTokenizer(file, pattern) if merges_by_id(parsed["model"]) else PieceTokenizer(file, pattern)


def _merges(model: dict) -> list[tuple[str, str]]:
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]


def merges_by_id(model: dict) -> bool:
    """Whether every byte has an id and what later merges make has later ids, so that ids are ranks."""
    vocabulary = model["vocab"]
    made = [a + b for a, b in _merges(model)]
    if not all(t in vocabulary for t in [*_byte_names().values(), *made]):
        return False
    ids = [vocabulary[t] for t in made]
    return all(x < y for x, y in zip(ids, ids[1:]))


def pieces(docs: DataFrame, path: str, pattern: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece."""
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    last = np.array([end], "<u4").tobytes()
    names = ["start", "length", "ids_crc32", "doc_tokens"]

    def make():
        own = piece_tokenizer(file.value, pattern)

        def run(texts: list[str | None]):
            rows = []
            for i, ids in enumerate(own.encode_group([t or "" for t in texts])):
                ids += last
                n = len(ids) // 4
                rows += [(i, s, min(width, n - s), zlib.crc32(ids[4 * s : 4 * (s + width)]), n) for s in range(0, n, width)]
            index, *columns = zip(*rows, strict=True)
            return index, dict(zip(names, columns, strict=True))

        return run

    return map_texts(docs, ["doc_id"], dict.fromkeys(names, "long"), make, 256)


def shortest_pack_first(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, how many such sequences)]: every piece once, none cut.

    Lengths are placed longest first, each piece onto the open pack with the most room. All packs with the same room
    take a piece in one step, as many as there are packs of a pattern or pieces left, and are then packs with less room,
    further down; what finds no room opens packs. The loop runs over patterns, not pieces.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        room = width - 1
        while left and room >= length:
            if not open_packs[room]:
                room -= 1
                continue
            pattern, count = open_packs[room].pop()
            used = min(left, count)
            if used < count:
                open_packs[room].append((pattern, count - used))
            left -= used
            open_packs[room - length].append(((*pattern, length), used))
        if left:
            # The pack opened last has the most room, until it has none for this length.
            each = width // length
            if full := left // each:
                open_packs[width - each * length].append(((length,) * each, full))
            if rest := left % each:
                open_packs[width - rest * length].append(((length,) * rest, 1))
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in open_packs.values():
        for pattern, count in packs:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, copies in a sequence, offset of the first copy) of each run.

    Rank r of the run lies in sequence first + (r - first rank) div copies, at offset + length * ((r - first rank) mod copies).
    """
    out, next_rank, sequence = [], defaultdict(int), 0
    for pattern, count in patterns:
        offset = i = 0
        while i < len(pattern):
            copies = pattern.count(pattern[i])
            n = copies * count
            out.append((pattern[i], next_rank[pattern[i]], n, sequence, copies, offset))
            next_rank[pattern[i]] += n
            offset += pattern[i] * copies
            i += copies
        sequence += count
    return out


def pack(cut_pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """cut_pieces with sequence_id (gapless from 0) and offset; it is read three times and should be cut.

    The histogram collected has a bin for each length, width at most. The patterns go back as a small table whose size
    depends on the histogram's shape and not on the corpus; it is joined as any table, so that Spark broadcasts it only
    where its size allows.
    """
    spark = cut_pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(histogram.values())
    runs = places(shortest_pack_first(histogram, width))
    schema = "p_length long, p_rank long, p_n long, p_sequence long, p_copies long, p_offset long"
    table_of_runs = spark.createDataFrame(pd.DataFrame(runs, columns=[c.split()[0] for c in schema.split(", ")]), schema) if runs else spark.createDataFrame([], schema)
    numbered = ranked(cut_pieces, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], total)
    on = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_rank")) & (F.col("rank") < F.col("p_rank") + F.col("p_n"))
    at = F.col("rank") - F.col("p_rank")
    return (
        numbered.join(table_of_runs, on)
        .withColumn("sequence_id", F.expr("p_sequence + (rank - p_rank) div p_copies"))
        .withColumn("offset", F.col("p_offset") + F.col("length") * (at % F.col("p_copies")))
        .select(*cut_pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, path: str, pattern: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text; more columns are ignored): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The ids are the library's with add_special_tokens=False: strings of the file's added tokens become those tokens. A
    null text counts as empty: its one piece is the end id. A document longer than width fills whole sequences and its
    rest is packed; repeated rows are packed as often as they occur. An empty table gives an empty result.
    """
    return pack(hold(pieces(docs, path, pattern, width, end)), width)


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {"op10_pack_documents": op10_pack_documents}
ORACLES: dict[str, str] = {}
