"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces take, from the left, the longest vocabulary entry that fits, again and again. Done
plainly this rereads characters. The automaton reads each once: it walks a trie of the vocabulary, and where no edge
goes on it pops the pieces that are by now certain and follows a failure link to the node for what is left. Only how
many pieces a link pops is stored, so that the count comes out without any piece being built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession

from .bpe import CACHE, LONG, read_vocabulary
from .common import map_texts, table

#: Words as word-piece tokenizers cut them: runs of letters, digits and marks, and any other mark alone.
WORDS = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\p{White_Space}]"


class LongestMatch:
    """The automaton over bytes. A word is matched with `start` before it; pieces inside a word have no such mark.

    Nodes are numbers and edges one dict from node * 256 + byte to node. Node 0 is the root of whole words, node 1 the
    root of what follows a piece. fail[v] is -1 where no piece can be popped, which makes the word unknown.
    """

    def __init__(self, first: Iterable[bytes], inner: Iterable[bytes]):
        self.edges: dict[int, int] = {}
        self.fail, self.popped, token = [-1, -1], [0, 0], [False, False]
        parents = [(-1, 0), (-1, 0)]
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    follow = self.edges.get(key)
                    if follow is None:
                        follow = self.edges[key] = len(token)
                        token.append(False)
                        parents.append((node, byte))
                        self.fail.append(-1)
                        self.popped.append(0)
                    node = follow
                token[node] = node > 1
        children: dict[int, list[int]] = {}
        for node in range(2, len(token)):
            children.setdefault(parents[node][0], []).append(node)
        todo = deque([0, 1])
        while todo:
            node = todo.popleft()
            todo.extend(children.get(node, ()))
            if node < 2:
                continue
            if token[node]:
                self.fail[node], self.popped[node] = 1, 1
                continue
            parent, byte = parents[node]
            at, count = self.fail[parent], self.popped[parent]
            while at >= 0 and (at << 8 | byte) not in self.edges:
                count += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.edges[at << 8 | byte], count

    def count(self, word: bytes) -> int:
        """How many pieces the word has, or 0 if it can't be cut into pieces."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for byte in word:
            follow = edges.get(node << 8 | byte)
            while follow is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
                follow = edges.get(node << 8 | byte)
            node = follow
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return total


class WordCounter:
    """Counts of whole words, remembered up to CACHE words of LONG characters."""

    def __init__(self, automaton: LongestMatch, start: bytes):
        self.automaton, self.start = automaton, start
        self.split = regex.compile(WORDS).findall
        self.cache: dict[str, int] = {}

    def word(self, word: str) -> int:
        known = self.cache.get(word)
        if known is None:
            known = self.automaton.count(self.start + word.encode())
            if len(word) <= LONG:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[word] = known
        return known

    def text(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens (an unknown word is one) and unknown words."""
        if not text:
            return 0, 0, 0
        counts = [*map(self.word, self.split(text))]
        unknown = counts.count(0)
        return len(counts), sum(counts) + unknown, unknown


@lru_cache(maxsize=2)
def counter(file: bytes, start: bytes) -> WordCounter:
    """The rank file's entries that begin with `start` open a word, those without `start` anywhere go on inside it."""
    tokens = [base64.b64decode(line.split()[0]) for line in file.splitlines() if line]
    return WordCounter(LongestMatch([t for t in tokens if t.startswith(start) and start not in t[1:]], [t for t in tokens if start not in t]), start)


def token_counts(docs: DataFrame, path: str, start: bytes = b" ") -> DataFrame:
    """One row per row of docs (doc_id, text; more columns are ignored): doc_id, n_words, n_tokens, n_unknown.

    Null and empty texts, and texts of white space, have zero counts. Equal rows give equal results, an empty table an
    empty result. The vocabulary file is broadcast; its size is checked.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        own = counter(file.value, start)

        def run(texts: list[str | None]):
            words, tokens, unknown = zip(*map(own.text, texts), strict=True)
            return None, {"n_words": words, "n_tokens": tokens, "n_unknown": unknown}

        return run

    return map_texts(docs, ["doc_id"], dict.fromkeys(["n_words", "n_tokens", "n_unknown"], "long"), make)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
