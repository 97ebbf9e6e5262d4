"""Words near known words against all pairs."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.functions import near_words as nw
from quillmill.functions.distance import damerau_levenshtein

WORD = st.text("abñ🙂", max_size=9)


def all_pairs(words, known, most):
    return sorted((w, k, d) for w in words for k in known if (d := damerau_levenshtein(w, k)) <= most)


@settings(max_examples=150, deadline=None)
@given(st.sets(WORD, min_size=1, max_size=12), st.sets(WORD, min_size=1, max_size=12), st.integers(1, 3))
def test_automaton_is_exact(words, known, most):
    assert sorted(nw.nearest(nw.Trie.of(sorted(known)), sorted(words), most)) == all_pairs(words, known, most)


def test_transpositions_with_edits_between():
    trie = nw.Trie.of(["abc", "ca", "acb", "bxxa"])
    assert sorted(nw.nearest(trie, ["ca"], 3)) == [("ca", "abc", 2), ("ca", "acb", 2), ("ca", "bxxa", 3), ("ca", "ca", 0)]
    assert ("ab", "bxxa", 3) in list(nw.nearest(trie, ["ab"], 3))


def test_widening_stops_at_the_nearest():
    r = random.Random(2)
    letters = lambda n: "".join(r.choice("abc") for _ in range(n))
    known = sorted({letters(r.randint(3, 8)) for _ in range(60)})
    words = sorted({letters(r.randint(3, 8)) for _ in range(80)})
    trie = nw.Trie.of(known)
    for enough in (1, 3):
        got = list(nw.nearest(trie, words, 3, enough))
        for w in words:
            every = sorted(d for _, _, d in all_pairs([w], known, 3))
            last = every[enough - 1] if len(every) >= enough else 3
            assert sorted(x for x in got if x[0] == w and x[2] <= last) == [x for x in all_pairs([w], known, 3) if x[2] <= last]


def test_long_words_and_empty_ones():
    long = "abcdefghij" * 5000
    trie = nw.Trie.of([long[1:], long[:-1] + "x", "a", ""])
    assert sorted(nw.nearest(trie, [long, "", "abcd"], 3)) == sorted([(long, long[1:], 1), (long, long[:-1] + "x", 1), ("", "a", 1), ("", "", 0), ("abcd", "a", 3)])


@pytest.mark.parametrize("trie_words", [1 << 20, 7])
def test_pairs_of_tables(spark, trie_words):
    """Several tries give what one gives."""
    words = ["kain", "kumain", "kainan", None, "x", "masaya", "masiya", "msaaya"]
    known = ["kain", "kinain", "masaya", "saya", None, "aso", "pusa", "bahay", "buhay", "araw", "gabi", "tubig", "kape", "isda", "ibon"]
    df, other = spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(k,) for k in known], "candidate string")
    want = all_pairs([w for w in words if w], [k for k in known if k], 3)
    assert sorted(map(tuple, nw.near_pairs(df, other, trie_words=trie_words).collect())) == want
    nearest = {}
    for w, k, d in nw.near_pairs(df, other, enough=1, trie_words=trie_words).collect():
        nearest[w] = min(nearest.get(w, (9, "")), (d, k))
    assert nearest == {w: min((d, k) for x, k, d in want if x == w) for w in {x[0] for x in want}}
    assert nw.near_pairs(df.limit(0), other).collect() == nw.near_pairs(df, other.limit(0)).collect() == []
    with pytest.raises(ValueError):
        nw.near_pairs(df, other, 4)


def test_many_words_meet_few_known_ones_quickly():
    """Words of some length against a vocabulary, 10,000 at once: down the trie alone they take several seconds."""
    r = random.Random(3)
    letters = lambda n: "".join(r.choice("aeiounlstk") for _ in range(n))
    known, words = sorted({letters(r.randint(4, 9)) for _ in range(4000)}), sorted({letters(r.randint(6, 13)) for _ in range(10_000)})
    trie = nw.Trie.of(known)
    began = time.process_time()
    got = list(nw.nearest(trie, words, 3, 1))
    assert time.process_time() - began < 4
    some = words[::500]
    assert sorted(x for x in nw.nearest(trie, some, 3)) == all_pairs(some, known, 3)
    assert {w for w, _, _ in got if w in set(some)} == {w for w, _, _ in all_pairs(some, known, 3)}


def test_large_vocabularies_go_down_the_trie(monkeypatch):
    monkeypatch.setattr(nw, "HASHES", 20)
    trie = nw.Trie.of(["kain", "kumain", "masaya"])
    assert not trie.met.get(3) and sorted(nw.nearest(trie, ["kainn", "masiya"], 3)) == all_pairs(["kainn", "masiya"], ["kain", "kumain", "masaya"], 3)
