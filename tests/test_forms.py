"""Whole forms against a regular expression, and in a table of a million."""

import random
import re

from quillmill.functions.forms import FormTable, ends_of, folded, leftmost, stretches, whole_forms

PIECES = ["ab", "a", "b", "ko", "x", "?", "'", "’", "-", " ", "  ", "\t", "\n", "é", "É", "ß", "ſ", "K", "_", "1", "🙂", "'s", "ı", "İ", "–", "Ab"]


def plain(text, forms):
    """The alternation of all forms, the longest first."""
    alternatives = "|".join(r"[ \t]+".join(map(re.escape, f.split(" "))) for f in sorted(forms, key=lambda f: (-len(f), f)))
    whole = r"(?<!\w)(?<!\w['’])(?<!\w[-‐‑‒–—])(?:" + alternatives + r")(?!\w)(?!['’]\w)(?![-‐‑‒–—]\w)"
    return [m.span() for m in re.finditer(whole, text, re.IGNORECASE)]


def test_forms_are_those_of_the_pattern():
    r = random.Random(3)
    found = 0
    for _ in range(3000):
        forms = {re.sub(r"\s+", " ", "".join(r.choice(PIECES) for _ in range(r.randint(1, 5)))).strip().lower() for _ in range(r.randint(1, 8))} - {""}
        text = "".join(r.choice([*PIECES, *sorted(forms), " "]) for _ in range(r.randint(0, 25)))
        k = r.randint(1, 3)
        tables = [FormTable.of(f for i, f in enumerate(sorted(forms)) if i % k == part) for part in range(k)]
        want = plain(text, forms) if forms else []
        assert whole_forms(text, tables) == want
        found += len(want)
    assert found > 500


def test_stretches_hold_every_form():
    """Looking stretches up gives what the table gives."""
    r = random.Random(4)
    for _ in range(1500):
        forms = {re.sub(r"\s+", " ", "".join(r.choice(PIECES) for _ in range(r.randint(1, 5)))).strip().lower() for _ in range(r.randint(1, 8))} - {""}
        text = "".join(r.choice([*PIECES, *sorted(forms), " "]) for _ in range(r.randint(0, 25)))
        known = {folded(f) for f in forms}
        longest = {}
        for start, end, letters in stretches(text, max(map(ends_of, forms), default=0), max(map(len, known), default=0)):
            if letters in known:
                longest[start] = max(end, longest.get(start, 0))
        assert sorted(longest.items()) == FormTable.of(forms).matches(text)


def test_folding_is_what_the_pattern_ignores():
    for code in range(0x20, 0x10000):
        if not 0xD800 <= code < 0xE000:
            assert re.fullmatch(re.escape(folded(chr(code))), chr(code), re.IGNORECASE)


def test_a_million_forms():
    table = FormTable.of(f"salita{i} na {i % 977}" for i in range(1_000_000))
    text = " ".join(f"Salita{i * 7}\tna  {i * 7 % 977} at salita{i}" for i in range(2000))
    spans = whole_forms(text, [table])
    assert len(spans) == 2000 and all(text[a:b].split()[1] == "na" for a, b in spans)


def test_leftmost():
    assert leftmost([(0, 5), (3, 9), (5, 6), (6, 7)]) == [(0, 5), (5, 6), (6, 7)]
