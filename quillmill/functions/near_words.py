"""Known words near other words: an edit-distance automaton run over a vocabulary's trie, for many words at once.

The automaton's state at a trie node is a row of the distance table, of which only the 2 MOST + 1 cells about the
diagonal can matter. Rows of all pairs of word and node that are alive at one depth stand in one array and go down a
level together; a pair dies when no word below its node can come within the distance, by its cells and by how many
letters the words below still have. Distances are unrestricted Damerau-Levenshtein: a transposition may have edits
between its letters, so that the rows of up to MOST levels above are kept as well.

Search is widened distance by distance: a word is finished at the least distance that finds it enough known words.

Words of up to SHORT letters, which are nearly all, meet a vocabulary of moderate size in another way: words within a
distance k become equal without k letters of the longer one, and fewer of the shorter. Hashes of words without some letters are sums of
stretches of prefix sums, so that they are made for many words at once and looked up among those of the known words;
what meets there is compared cell by cell, many pairs at once. Longer words, and what a larger vocabulary knows, go
down the trie.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The greatest distance, cells of a row, and what stands for too far.
MOST = 3
CELLS, FAR = 2 * MOST + 1, 2 * MOST + 2
#: Words that go down a trie together, and letters of their padded rows.
TOGETHER, LETTERS = 384, 1 << 20
#: Known words of one trie; a larger vocabulary has several, and each is searched.
TRIE_WORDS = 500_000
#: Letters of words that are met by hashes, hashes of a vocabulary, and cells, hashes or pairs that stand together.
SHORT, HASHES, CHUNK = 32, 8_000_000, 1 << 18


@dataclass(frozen=True)
class Trie:
    """Nodes in order of depth, children side by side: first child, children, word that ends here (or -1), the least and
    greatest number of letters that words below still have, and the letter, by its place in `letters`."""

    words: list[str]
    child: np.ndarray
    children: np.ndarray
    word: np.ndarray
    least: np.ndarray
    most: np.ndarray
    code: np.ndarray
    letters: np.ndarray

    @classmethod
    def of(cls, words: Sequence[str]) -> Trie:
        """The trie of distinct words."""
        words = sorted(words)
        levels: list[list[tuple[int, int]]] = [[(0, 0)]]  # letter and parent's place in its level
        ends: list[dict[int, int]] = [{}]
        before, path = "", [0]
        for number, word in enumerate(words):
            shared = 0
            while shared < min(len(before), len(word)) and before[shared] == word[shared]:
                shared += 1
            path = path[: shared + 1]
            for depth in range(shared, len(word)):
                if depth + 1 == len(levels):
                    levels.append([])
                    ends.append({})
                levels[depth + 1].append((ord(word[depth]), path[depth]))
                path.append(len(levels[depth + 1]) - 1)
            ends[len(word)][path[len(word)]] = number
            before = word
        sizes = [len(x) for x in levels]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        n = int(starts[-1])
        letter, parent, word_at = np.empty(n, np.int32), np.empty(n, np.int64), np.full(n, -1, np.int64)
        for depth, level in enumerate(levels):
            a, b = starts[depth], starts[depth + 1]
            letter[a:b] = [x for x, _ in level]
            parent[a:b] = [p + (starts[depth - 1] if depth else 0) for _, p in level]
            for place, number in ends[depth].items():
                word_at[a + place] = number
        parent[0] = -1
        children = np.bincount(parent[1:], minlength=n)
        child = 1 + np.concatenate(([0], np.cumsum(children)[:-1]))
        least = np.where(word_at >= 0, 0, 1 << 20).astype(np.int32)
        most = np.where(word_at >= 0, 0, -1).astype(np.int32)
        for depth in range(len(levels) - 1, 0, -1):
            a, b = starts[depth], starts[depth + 1]
            np.minimum.at(least, parent[a:b], least[a:b] + 1)
            np.maximum.at(most, parent[a:b], most[a:b] + 1)
        letters, code = np.unique(letter, return_inverse=True)
        return cls(words, child.astype(np.int64), children.astype(np.int32), word_at, least, most, code.astype(np.int32), letters)

    @cached_property
    def met(self) -> dict[int, Shortened]:
        """By distance, the known words without some letters; none for a vocabulary that would have too many. Made where it is used."""
        sizes = [len(w) for w in self.words if len(w) <= SHORT + MOST]
        fits = lambda k: sum(comb(n, d) for n in sizes for d in range(min(k, n) + 1)) <= HASHES
        return {k: Shortened.of(self.words, k) for k in range(1, MOST + 1) if fits(k)}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "met"}


_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.array([pow(_BASE, k + MOST, 1 << 64) for k in range(-MOST, SHORT + MOST + 1)], np.uint64)


def _codes(words: Sequence[str], n: int) -> np.ndarray:
    """Words of n letters as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)


@lru_cache(maxsize=256)
def _places(n: int, k: int) -> np.ndarray:
    """The ways to leave k of n letters out, a column each."""
    return np.array([*combinations(range(n), k)], np.int64).reshape(comb(n, k), k).T


def _without(codes: np.ndarray, k: int) -> np.ndarray:
    """(words, ways): hashes of rows of letters without k of them, also told apart by how many letters are left."""
    words, n = codes.shape
    own = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    own ^= own >> np.uint64(29)
    sums = np.zeros((k + 1, words, n + 1), np.uint64)
    for gone in range(k + 1):
        np.cumsum(own * _POWERS[MOST - gone : MOST - gone + n], axis=1, out=sums[gone, :, 1:])
    places = _places(n, k)
    out = np.full((words, places.shape[1] if k else 1), n - k, np.uint64)
    begin = 0
    for gone in range(k):
        out += sums[gone][:, places[gone]] - (sums[gone][:, begin] if gone else np.uint64(0))
        begin = places[gone] + 1
    out += sums[k][:, n : n + 1] - (sums[k][:, begin] if k else np.uint64(0))
    return (out ^ (out >> np.uint64(32))) * _MIX


@dataclass(frozen=True)
class Shortened:
    """Known words without up to `most` letters: hashes in order, the word of each, and which beginnings of hashes there are.

    The tables are two: of all that is left without any number of letters, and of what is left without just `most`.
    """

    most: int
    codes: np.ndarray
    lengths: np.ndarray
    tables: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, int], ...]

    @classmethod
    def of(cls, words: Sequence[str], most: int) -> Shortened:
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.zeros((len(words), SHORT + MOST), np.uint32)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in range(min(SHORT + MOST, int(lengths.max(initial=0))) + 1):
            at = np.nonzero(lengths == n)[0]
            if not len(at):
                continue
            codes[at, :n] = _codes([words[i] for i in at], n)
            for k in range(min(most, n) + 1):
                step = max(1, CHUNK // comb(n, k))
                for start in range(0, len(at), step):
                    some = at[start : start + step]
                    made = _without(codes[some, :n], k)
                    found.append((k, made.ravel(), np.repeat(some, made.shape[1])))
        return cls(most, codes, lengths, tuple(cls._table([x for x in found if all_ways or x[0] == most]) for all_ways in (True, False)))

    @staticmethod
    def _table(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        hashes = np.concatenate([np.empty(0, np.uint64), *(h for _, h, _ in found)])
        words = np.concatenate([np.empty(0, np.int64), *(w for _, _, w in found)])
        order = np.lexsort((words, hashes))
        hashes, words = hashes[order], words[order]
        bits = min(26, max(12, int(len(hashes)).bit_length() + 4))
        there = np.zeros(1 << bits, bool)
        there[hashes >> np.uint64(64 - bits)] = True
        return hashes, words, there, 64 - bits

    def near(self, words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in words, place in the known words, distance) of pairs within the distance; words have SHORT letters at most."""
        lengths = np.array([len(w) for w in words], np.int64)
        for n in np.unique(lengths):
            at = np.nonzero(lengths == n)[0]
            every = max(1, sum(comb(int(n), k) for k in range(self.most + 1)))
            step = max(1, CHUNK // every)
            for start in range(0, len(at), step):
                some = at[start : start + step]
                codes = _codes([words[i] for i in some], int(n))
                # A known word of no more letters meets the word without `most`, or all, of its letters; one of more, with fewer gone.
                pairs = [self._met(codes, k, k < min(self.most, n)) for k in range(min(self.most, int(n)) + 1)]
                pair = np.unique(np.concatenate(pairs))
                own, known = pair // len(self.lengths), pair % len(self.lengths)
                for first in range(0, len(own), CHUNK):
                    i, j = own[first : first + CHUNK], known[first : first + CHUNK]
                    distance = _distances(codes, i, self.codes, j, self.lengths[j], self.most)
                    close = np.nonzero(distance <= self.most)[0]
                    yield some[i[close]], j[close], distance[close].astype(np.int64)

    def _met(self, codes: np.ndarray, k: int, longer: bool) -> np.ndarray:
        """Pairs, as numbers: rows of letters and the known words that equal them without k letters."""
        hashes, words, there, shift = self.tables[1 if longer else 0]
        made = _without(codes, k)
        flat = made.ravel()
        hit = np.nonzero(there[flat >> np.uint64(shift)])[0]
        asked = flat[hit]
        low = np.searchsorted(hashes, asked)
        true = np.nonzero((low < len(hashes)) & (hashes[np.minimum(low, max(0, len(hashes) - 1))] == asked))[0] if len(hashes) else np.empty(0, np.int64)
        low, asked, row = low[true], asked[true], hit[true] // made.shape[1]
        times = np.searchsorted(hashes, asked, "right") - low
        each = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.repeat(row, times) * len(self.lengths) + words[each]


def _distances(codes: np.ndarray, i: np.ndarray, known: np.ndarray, j: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Distances of pairs of rows of letters, where they are `most` at most; else any greater number. All rows of codes have one length."""
    n = codes.shape[1]
    a = np.ascontiguousarray(codes[i].T)
    b = np.zeros((n + 2 * most + 1, len(j)), np.uint32)
    b[most : most + min(n + most, known.shape[1])] = known[j, : n + most].T
    far = np.full(len(j), FAR, np.uint8)
    one = np.uint8(1)
    band = range(-most, most + 1)
    rows: list[dict[int, np.ndarray]] = [{d: np.full(len(j), d, np.uint8) if d >= 0 else far for d in band}]
    alike: list[dict[int, np.ndarray]] = [{}]
    for row in range(1, n + 1):
        # unlike: 0 where the letter of this row is that of the known word at row + d, else FAR.
        alike.append({d: (a[row - 1] != b[row - 1 + d + most]) * np.uint8(FAR) if row + d > 0 else far for d in range(-most, most + 1)})
        above, own = rows[-1], {}
        for d in band:
            if row + d < 0:
                own[d] = far
                continue
            if row + d == 0:
                own[d] = np.full(len(j), row, np.uint8)
                continue
            best = above[d] + np.minimum(alike[row][d], one)
            if d + 1 <= most:
                best = np.minimum(best, above[d + 1] + one)
            if d - 1 >= -most:
                best = np.minimum(best, own[d - 1] + one)
            # The letters at row and row + d stand crossed, x letters of the word and y of the known one between them.
            for x in range(most):
                for y in range(most - x):
                    r, c = row - 1 - x, row + d - 1 - y
                    if r < 1 or c < 1 or abs(c - r) > most or abs(c - row) > most or abs(row + d - r) > most:
                        continue
                    crossed = alike[row][c - row] | alike[r][row + d - r]
                    best = np.minimum(best, (rows[r - 1][c - r] + np.uint8(x + y + 1)) | crossed)
            own[d] = np.minimum(best, np.uint8(FAR))
        rows.append(own)
    last = rows[n]
    out = far.copy()
    for d in band:
        ends = lengths == n + d
        out[ends] = last[d][ends]
    return out


#: A row is a number of eight bytes, a cell each; the last is always far. Bytes stay below 128, so that sums don't carry.
ONES, TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
FARS = np.uint64(FAR) * ONES
_BYTE = [np.uint64(8 * k) for k in range(8)]
#: Gaps between letters left in words and below nodes count up to here.
_WIDE = 2 * FAR


def _packed(cells: np.ndarray) -> np.ndarray:
    """Rows (..., CELLS) as numbers."""
    out = np.full((*cells.shape[:-1], 8), FAR, np.uint8)
    out[..., :CELLS] = cells
    return out.view("<u8")[..., 0].astype(np.uint64)


def _least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lesser of two rows, cell by cell."""
    taken = ((((a | TOPS) - b) & TOPS) >> np.uint64(7)) * np.uint64(255)
    return (b & taken) | (a & ~taken)


def _any_within(row: np.ndarray, most: int) -> np.ndarray:
    """Whether a cell is `most` at most."""
    if most < 0:
        return np.zeros(len(row), bool)
    return ((row + np.uint64(127 - most) * ONES) & TOPS) != TOPS


def _gaps() -> np.ndarray:
    """For how many letters the first cell's place has more than the longest word below, and less than the shortest: the
    least number of edits that each cell still needs."""
    x = np.arange(-_WIDE, _WIDE + 1)
    cell = np.arange(CELLS)
    more, less = x[:, None, None] - cell, x[None, :, None] + cell
    return _packed(np.clip(np.maximum(more, less), 0, FAR)).ravel()


GAPS = _gaps()


def search(trie: Trie, words: Sequence[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in words, place in trie.words, distance) of all pairs within `most`, which is MOST at most."""
    lengths = np.array([len(w) for w in words], np.int64)
    pad = 2 * MOST + 2
    text = np.full((len(words), int(lengths.max(initial=0)) + 2 * pad), -2, np.int32)
    for i, own in enumerate(words):
        text[i, pad : pad + len(own)] = np.frombuffer(own.encode("utf-32-le", "surrogatepass"), np.int32)
    cell = np.arange(CELLS)
    every = np.arange(len(words))

    def outside(depth: int) -> np.ndarray:
        place = depth - MOST + cell
        return _packed(np.where((place < 0) | (place > lengths[:, None]), FAR, 0))

    w, node = every, np.zeros(len(words), np.int64)
    first = _packed(np.broadcast_to(np.where(cell < MOST, FAR, cell - MOST), (len(words), CELLS)))
    row = _least(first | outside(0), np.broadcast_to(FARS, len(words)))
    none = np.broadcast_to(FARS, len(words))
    rows, closed = [row, none, none, none], [np.zeros(len(words), bool), *[np.ones(len(words), bool)] * MOST]
    path = [np.zeros(len(words), np.int32)] * MOST
    found = [_ends(trie, w, node, row, 0, lengths, most)]
    depth = 0
    while len(w):
        depth += 1
        times = trie.children[node]
        up = np.repeat(np.arange(len(w)), times)
        if not len(up):
            break
        node = trie.child[node[up]] + np.arange(len(up)) - np.repeat(np.cumsum(times) - times, times)
        w, letter = w[up], trie.code[node]
        # What a letter costs at each place about the diagonal, for each word and letter of the trie.
        window = text[:, pad + depth - MOST - 1 : pad + depth + MOST]
        costs = _packed(window[:, None, :] != trie.letters[None, :, None]) & ONES | np.uint64(1 << 56)
        old = [r[up] for r in rows]
        own = costs[w, letter]
        row = old[0] + own
        row = _least(row, ((old[0] >> _BYTE[1]) + ONES) | np.uint64(FAR << 56))
        # shut: no cell of that row, with the letters left, can lead to a pair within the distance by a transposition.
        shut = [c[up] for c in closed]
        for a in range(most):
            for b in range(most - a):
                some = np.nonzero(~shut[1 + a] & _any_within(old[1 + a], most - 1 - a - b))[0]
                if len(some):
                    crossed = costs[w[some], path[a][up[some]]]
                    row[some] = _least(row[some], _transposed(old[1 + a][some], own[some], crossed, a, b))
        gone = outside(depth)[w]
        row |= gone
        row = _least(row, ((row << _BYTE[1]) + ONES) | np.uint64(FAR))
        row = _least(row, ((row << _BYTE[2]) + np.uint64(2) * ONES) | np.uint64(FAR | FAR << 8))
        row = _least(row | gone, np.broadcast_to(FARS, len(row)))
        found.append(_ends(trie, w, node, row, depth, lengths, most))
        left = lengths[w] - depth + MOST
        more, less = np.clip(left - trie.most[node], -_WIDE, _WIDE), np.clip(trie.least[node] - left, -_WIDE, _WIDE)
        needed = row + GAPS[(more + _WIDE) * (2 * _WIDE + 1) + less + _WIDE]
        alive = _any_within(needed, most)
        for passed in range(most):
            alive |= ~shut[passed] & _any_within(old[passed], most - 1 - passed)
        keep = np.nonzero(alive & (trie.children[node] > 0))[0]
        w, node = w[keep], node[keep]
        rows = [row[keep], *(r[keep] for r in old[:MOST])]
        closed = [~_any_within(needed[keep], most - 1), *(c[keep] for c in shut[:MOST])]
        path = [letter[keep], *(p[up[keep]] for p in path[: MOST - 1])]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _transposed(old: np.ndarray, own: np.ndarray, crossed: np.ndarray, a: int, b: int) -> np.ndarray:
    """Rows by transpositions of a letter (which costs `own`) with the one a + 1 levels above (`crossed`), with a letters
    of the path and b of the word between them; old: the row before the upper one.

    Cells at the ends of a row can't be had so within MOST, nor from beyond them, so that shifts lose nothing.
    """
    moved = old
    if a > b:
        moved = (old >> _BYTE[a - b]) | (FARS << _BYTE[8 - a + b])
    elif b > a:
        moved = (old << _BYTE[b - a]) | (FARS >> _BYTE[8 - b + a])
    unlike = crossed | (own << _BYTE[1 + b]) | (ONES >> _BYTE[7 - b])
    return (moved + np.uint64(a + b + 1) * ONES) | (unlike & ONES) * np.uint64(FAR)


def _ends(trie: Trie, w: np.ndarray, node: np.ndarray, row: np.ndarray, depth: int, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that end at these nodes within the distance."""
    at = np.nonzero(trie.word[node] >= 0)[0]
    cell = lengths[w[at]] - depth + MOST
    inside = (cell >= 0) & (cell < CELLS)
    at, cell = at[inside], cell[inside]
    distance = ((row[at] >> (8 * cell).astype(np.uint64)) & np.uint64(255)).astype(np.int64)
    near = distance <= most
    return w[at[near]], trie.word[node[at[near]]], distance[near]


def nearest(trie: Trie, words: Sequence[str], most: int = MOST, enough: int | None = None) -> Iterator[tuple[str, str, int]]:
    """(word, known word, distance) of pairs within `most`. With `enough`, of each word at least those pairs that are no
    farther than the enough-th; without, all."""
    for i, j, d in nearest_places(trie, words, most, enough):
        yield from ((words[a], trie.words[b], c) for a, b, c in zip(i.tolist(), j.tolist(), d.tolist(), strict=True))


def nearest_places(trie: Trie, words: Sequence[str], most: int = MOST, enough: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """nearest, as places of words, places in trie.words, and distances."""
    left = np.array(sorted(range(len(words)), key=lambda k: len(words[k])), np.int64)
    for distance in range(1, most + 1) if enough else [most]:
        if not len(left):
            return
        own = [words[k] for k in left]
        hashed = len([w for w in own if len(w) <= SHORT]) if distance in trie.met else 0
        parts = trie.met[distance].near(own[:hashed]) if hashed else ()
        found = []
        for part in (p for some in (parts, _down(trie, own, hashed, distance)) for p in some):
            if enough and distance < most:
                found.append(part)
            else:
                yield left[part[0]], part[1], part[2]
        if enough and distance < most:
            i, j, d = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 3
            done = np.bincount(i, minlength=len(own)) >= enough
            taken = done[i]
            yield left[i[taken]], j[taken], d[taken]
            left = left[~done]


def _down(trie: Trie, words: Sequence[str], start: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What search finds for the words from start on, some words at a time; words are in order of length."""
    while start < len(words):
        stop = min(start + TOGETHER, len(words))
        while stop > start + 1 and (stop - start) * max(len(words[stop - 1]), 8 * len(trie.letters)) > LETTERS:
            stop = start + max(1, (stop - start) // 2)
        i, j, d = search(trie, words[start:stop], most)
        yield i + start, j, d
        start = stop


def near_pairs(words: DataFrame, known: DataFrame, most: int = MOST, enough: int | None = None, trie_words: int = TRIE_WORDS) -> DataFrame:
    """word, candidate, distance: pairs of words (column word) and known (column candidate) within an unrestricted
    Damerau-Levenshtein distance of `most` (1 to 3). With `enough`, each word has at least its `enough` nearest, and all
    that are as near as the last of them; without, all pairs.

    Words are dealt to tasks one by one, whatever their letters, so that none gathers. A trie of up to trie_words known
    words is broadcast; a larger vocabulary is dealt over several by hash, and each is searched.
    """
    if not 1 <= most <= MOST:
        raise ValueError(f"distances from 1 to {MOST}")
    spark = words.sparkSession
    own = known.select("candidate").where("candidate IS NOT NULL").distinct()
    parts = max(1, -(-own.count() // trie_words))
    asked = words.select("word").where("word IS NOT NULL").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = None
    for part in range(parts):
        rows = own.where(F.pmod(F.xxhash64("candidate"), F.lit(parts)) == part).collect()
        shared = spark.sparkContext.broadcast(Trie.of([r["candidate"] for r in rows]))
        found = asked.mapInArrow(_searcher(shared, most, enough), "word string, candidate string, distance int")
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(shared, most: int, enough: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        known = pa.array(trie.words, pa.string())
        for batch in batches:
            asked = batch.column("word")
            words = asked.to_pylist()
            for i, j, d in nearest_places(trie, words, most, enough):
                for start in range(0, len(i), 50_000):
                    a, b, c = (x[start : start + 50_000] for x in (i, j, d))
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(a)), known.take(pa.array(b)), pa.array(c, pa.int32())], names=["word", "candidate", "distance"])

    return run
