"""Whole forms in texts: the longest at each place, from the left, whatever their number.

Forms stand in sorted arrays of 64-bit hashes, beside their letters: some 100 MB of numpy for a million of 20 letters.
More are not broadcast; then stretches of texts are joined with them. A text's hashes of all stretches follow from one
running sum. Stretches that begin and end where a form may are looked up for all places at once, by the number of
possible ends between; a hash that is found is compared letter by letter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np

# What ties a form to a word beside it, an apostrophe or a dash with a word character behind.
APOSTROPHES, DASHES = "'’", "-‐‑‒–—"
#: Letters that a comparison without case takes for others though lower case keeps them apart.
_SAME = {"ı": "i", "İ": "i", "ΐ": "ΐ", "ΰ": "ΰ", "ﬆ": "ﬅ"}
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Forms in one table, and forms that are hashed together while it is made.
EACH, TOGETHER = 1_000_000, 50_000


class _Folded(dict):
    """Code point -> the letter that stands for all letters that differ in case alone."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        folded = _SAME.get(c) or next((x for x in (c.casefold(), c.lower()) if len(x) == 1), c)
        self[code] = folded
        return folded


class _Kinds(dict):
    """Code point -> w (word), t (apostrophe or dash), s (space or tab), o."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "w" if c.isalnum() or c == "_" else "t" if c in APOSTROPHES + DASHES else "s" if c in " \t" else "o"
        return kind


_FOLDED, _KINDS = _Folded(), _Kinds()
_RUN = re.compile(r"[ \t]{2,}|\t")


def folded(text: str) -> str:
    return text.translate(_FOLDED)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class _Powers:
    """Powers of the base and of its inverse, as many as any text so far has asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            one = np.ones(1, np.uint64)
            cls.up, cls.down = (np.cumprod(np.append(one, np.full(size - 1, x, np.uint64)), dtype=np.uint64) for x in (_BASE, _INVERSE))
        return cls.up[:n], cls.down[:n]


def _sums(codes: np.ndarray) -> np.ndarray:
    """sums[j] - sums[i], times the inverse power i, is the hash of the stretch from i to j."""
    up, _ = _Powers.to(len(codes) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * up[:-1], dtype=np.uint64)))


def _places(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a form may begin, and where it may end (the place behind it)."""
    word, tie = kinds == ord("w"), kinds == ord("t")
    n = len(kinds)
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    before[2:] |= tie[1:-1] & word[:-2]
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after[:-2] |= tie[1:-1] & word[2:]
    return np.nonzero(~before)[0], np.nonzero(~after)[0] + 1


def _plain(text: str) -> tuple[str, Callable[[np.ndarray], np.ndarray]]:
    """The text folded, with runs of spaces and tabs as one space, and the way from its places back to the text's."""
    plain = folded(text)
    if "\t" not in plain and "  " not in plain:
        return plain, lambda x: x
    # How much longer the text was up to each run.
    at, gone, shifts = [0], 0, [0]
    for m in _RUN.finditer(plain):
        at.append(m.start() + 1 - gone)
        gone += len(m[0]) - 1
        shifts.append(gone)
    places, longer = np.array(at), np.array(shifts)
    return _RUN.sub(" ", plain), lambda x: x + longer[np.searchsorted(places, x, side="right") - 1]


def ends_of(form: str) -> int:
    """How many places where a form may end one has, its own end included."""
    return int(np.count_nonzero(_places(np.frombuffer(folded(form).translate(_KINDS).encode(), np.uint8))[1] <= len(form)))


def stretches(text: str, ends: int, longest: int) -> list[tuple[int, int, str]]:
    """(start, end, folded letters) of all stretches that could be a form with up to so many ends and letters."""
    if not text:
        return []
    plain, back = _plain(text)
    starts, stops = _places(np.frombuffer(plain.translate(_KINDS).encode(), np.uint8))
    starts = starts[[not plain[i].isspace() for i in starts.tolist()]]
    nth = np.searchsorted(stops, starts, side="right")
    out = []
    for k in range(ends):
        open_ = np.nonzero(nth + k < len(stops))[0]
        first, last = starts[open_], stops[nth[open_] + k]
        near = last - first <= longest
        first, last = first[near], last[near]
        out += [(a, b, plain[i:j]) for a, b, i, j in zip(back(first).tolist(), back(last).tolist(), first.tolist(), last.tolist(), strict=True)]
    return out


@dataclass(frozen=True)
class FormTable:
    """Forms as arrays: hashes in order, where each form's letters are, what letters begin forms, and how many places
    where a form may end one can have."""

    hashes: np.ndarray
    spans: np.ndarray
    letters: np.ndarray
    firsts: np.ndarray
    ends: int

    @classmethod
    def of(cls, forms: Iterable[str]) -> FormTable:
        """The table of forms whose white space is single spaces; blank ones are none."""
        own = sorted({folded(f) for f in forms if f.strip()})
        hashes, lengths, letters, most = [], [], [], 0
        for at in range(0, len(own), TOGETHER):
            # Line ends stand between forms; they are no word characters and tie nothing.
            joined = "\n".join(own[at : at + TOGETHER])
            codes, size = _codes(joined), np.array([len(f) for f in own[at : at + TOGETHER]], np.int64)
            start = np.cumsum(size + 1) - size - 1
            sums, down = _sums(codes), _Powers.to(len(codes) + 1)[1]
            hashes.append((sums[start + size] - sums[start]) * down[start])
            lengths.append(size)
            letters.append(codes[codes != ord("\n")].astype(np.uint32))
            ends = _places(np.frombuffer(joined.translate(_KINDS).encode(), np.uint8))[1]
            most = max(most, int((np.searchsorted(ends, start + size, side="right") - np.searchsorted(ends, start, side="right")).max()))
        if not own:
            return cls(np.zeros(0, np.uint64), np.zeros((2, 0), np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint64), 0)
        hash_, size, flat = np.concatenate(hashes), np.concatenate(lengths), np.concatenate(letters)
        start = np.cumsum(size) - size
        order = np.argsort(hash_, kind="stable")
        return cls(hash_[order], np.stack((start[order], start[order] + size[order])), flat, np.unique(flat[start]).astype(np.uint64), most)

    def matches(self, text: str) -> list[tuple[int, int]]:
        """For each place where forms begin, the longest: (start, end) in the text, by start."""
        if not len(self.hashes) or not text:
            return []
        plain, back = _plain(text)
        codes = _codes(plain)
        starts, ends = _places(np.frombuffer(plain.translate(_KINDS).encode(), np.uint8))
        starts = starts[np.isin(codes[starts], self.firsts)]
        sums, down = _sums(codes), _Powers.to(len(codes) + 1)[1]
        nth = np.searchsorted(ends, starts, side="right")
        best = np.zeros(len(starts), np.int64)
        for k in range(self.ends):
            open_ = np.nonzero(nth + k < len(ends))[0]
            stop = ends[nth[open_] + k]
            own = (sums[stop] - sums[starts[open_]]) * down[starts[open_]]
            place = np.searchsorted(self.hashes, own)
            place[place == len(self.hashes)] = 0
            for i in np.nonzero(self.hashes[place] == own)[0].tolist():
                start, end = int(starts[open_[i]]), int(stop[i])
                if self._holds(int(place[i]), own[i], codes[start:end]):
                    best[open_[i]] = end
        found = np.nonzero(best)[0]
        return list(zip(back(starts[found]).tolist(), back(best[found]).tolist(), strict=True))

    def _holds(self, place: int, own: np.uint64, letters: np.ndarray) -> bool:
        while place < len(self.hashes) and self.hashes[place] == own:
            if np.array_equal(self.letters[self.spans[0, place] : self.spans[1, place]], letters):
                return True
            place += 1
        return False


def leftmost(found: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the longest forms at each place those that a reader from the left takes, none overlapping one before."""
    out, done = [], 0
    for start, end in found:
        if start >= done:
            out.append((start, end))
            done = end
    return out


def whole_forms(text: str, tables: Sequence[FormTable]) -> list[tuple[int, int]]:
    """(start, end) of the forms of all tables in a text."""
    if len(tables) == 1:
        return leftmost(tables[0].matches(text))
    longest: dict[int, int] = {}
    for table in tables:
        for start, end in table.matches(text):
            longest[start] = max(end, longest.get(start, 0))
    return leftmost(sorted(longest.items()))
