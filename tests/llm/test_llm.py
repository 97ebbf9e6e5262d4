"""The training-data operators against brute force, round trips and held-out rows, and at the edges."""

import base64
import collections
import functools
import hashlib
import itertools
import json
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmill.llm import bpe, chat_trees, common, fingerprints, language_id, ngram_join, packing, quality_rules, registry, sharding, token_counts, toxicity
from tests.compare import SF, rows_of, views

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TRICKY = [
    (1, "the cat sat on the mat and then it ran off to the barn", "en", "s0"),
    (2, "the cat sat on the mat and then it ran off to the barn", "en", "s0"),
    (3, None, "en", None),
    (4, "", None, "s0"),
    (5, " \t\r\n", None, None),
    (6, "Señor 🙂 ñandú — ¿qué?  " * 40, "es", "s1"),
    (7, LONG, "en", "s0"),
    (8, "x" * 5000, "de", "s1"),
    (9, "one two three", "en", "s0"),
    (9, "one two three", "en", "s0"),
    (9, "another text with the same id as the two rows before", "en", "s0"),
    (None, "a row without an id has a text all the same", "en", "s0"),
    (2**60 + 1, "line\nline\nline\n\n### $$$ a < b > c", "fr", "s2"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def tricky(spark):
    # Names that operators use themselves must not clash.
    more = ["n_words", "kept", "score", "key", "rank", "shard", "hashes", "length", "row", "block", "tie", "sketch"]
    df = spark.createDataFrame(TRICKY, SCHEMA)
    return df.withColumns({c: F.lit("extra") for c in more}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    assert rows_of(registry.QUERIES[name](spark, SF).toPandas()) == rows_of(views().execute(registry.ORACLES[name]).df())


def test_one_query_for_each():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))


# 1 Quality rules


def brute_repeats(words, k=8):
    at = collections.defaultdict(list)
    for i in range(len(words) - k + 1):
        at[tuple(words[i : i + k])].append(i)
    return len({i + j for s in at.values() if len(s) > 1 for i in s for j in range(k)})


def test_measures():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["a", "b ", "\n", " ", "#", "é"]) for _ in range(r.randint(0, 120)))
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), brute_repeats(words), len(lines), sum(a == b for a, b in itertools.pairwise(words)))
        assert quality_rules.measure(text) == want


def test_quality_edges(tricky, empty):
    rows = quality_rules.quality_rules(tricky).collect()
    assert len(rows) == len(TRICKY) and all(r["base_failed"] is not None and r["kept"] is not None for r in rows)
    assert not any(r["kept"] for r in rows if r["n_words"] < 20)
    assert quality_rules.quality_rules(empty).collect() == []
    kept = quality_rules.keep_good(tricky)
    assert kept.columns == tricky.columns and kept.count() == sum(r["kept"] for r in rows)


def test_quality_by_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality_rules.quality_rules(documents).join(labels, "doc_id").where("NOT base_failed")
    assert good.where("quality = 1 AND NOT kept").count() <= 0.02 * good.where("quality = 1").count()
    assert good.where("quality = 0 AND kept").count() <= 0.2 * max(5, good.where("quality = 0").count())


def test_sketches_merge(spark):
    rows = [(i, "en", f"s{i % 3}", 40 + i % 17, 200 + i, i % 9, 0, 0, 3, 0) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS)).withColumn("base_failed", F.lit(False))
    whole = quality_rules.sketches(df)
    parts = quality_rules.sketches(df.where("doc_id % 2 = 0")).unionByName(quality_rules.sketches(df.where("doc_id % 2 = 1"))).groupBy("lang", "source", "rule", "bin").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_fences_follow_their_group(spark):
    """Scale what a group's documents do, and its fences move; no fence stays at one value over the groups."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    counted = quality_rules.measured(docs, ["lang", "source"]).cache()
    tripled = counted.withColumns({c: 3 * F.col(c) for c in ("n_symbols", "n_stutters", "n_dup_lines", "word_chars")})
    before, after = ({(r["f_lang"], r["f_source"]): r for r in quality_rules.fences(quality_rules.sketches(x)).collect()} for x in (counted, tripled))
    names = [f"high_{r}" for r in quality_rules.RATIOS] + ["low_word_length"]
    moved = [before[k][n] != after[k][n] for k in before for n in names]
    assert len(before) > 50 and sum(moved) > 0.9 * len(moved)
    assert all(len({r[n] for r in before.values()}) > 2 for n in names)
    assert {r["level_symbol_rate"] for r in before.values()} == {0, 1}
    counted.unpersist()


# 2 Sharding


def brute_shard(key, tree):
    """Every arrival at every leaf, far beyond the first one that is taken."""
    found = []
    for region in sorted({x.region for x in tree.shards}):
        time = 0.0
        for arrival in range(400):
            wait, rack_draw, shard_draw = sharding.draws(str(key), region, arrival)
            time += wait / tree.regions.get(region, 1.0)
            for x in tree.shards:
                rack, slot = rack_draw * tree.rack_slots - x.rack, shard_draw * tree.shard_slots - x.slot
                if x.region == region and 0 <= rack < tree.racks.get((region, x.rack), 1.0) and 0 <= slot < x.weight:
                    found.append((time, x.shard))
    return min(found)[1]


def test_sharding(tricky, empty):
    rows = sharding.shard_documents(tricky, sharding.even_tree(8), sharding.even_tree(9)).collect()
    assert len(rows) == len(TRICKY)
    for r in rows:
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == brute_shard(key, sharding.even_tree(8)) and r["grown_shard"] in (r["shard"], 8)
    sizes = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _, _ in TRICKY)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sizes
    for shard in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert sharding.shard_documents(empty, sharding.even_tree(8), sharding.even_tree(9)).collect() == []


def test_sharding_moves_little(spark):
    S = sharding.Shard
    leaves = (S(0, 0, 0, 0, 0.5), S(0, 0, 1, 1), S(0, 1, 0, 2, 0.25), S(1, 0, 0, 3), S(1, 1, 1, 4, 0.5), S(5, 0, 0, 5))
    tree = sharding.Tree(leaves, racks={(1, 0): 0.75}, regions={1: 2.0, 5: 0.5})
    descent = sharding.Descent(tree)
    assert all(descent.shard(str(k)) == brute_shard(k, tree) for k in range(300))
    share = {x.shard: x.weight * tree.racks.get((x.region, x.rack), 1.0) * tree.regions.get(x.region, 1.0) for x in leaves}
    keys = spark.range(20_000)
    before = sharding.shard_of(keys, F.col("id"), tree, "a").cache()
    for row in before.groupBy("a").count().collect():
        assert abs(row["count"] / 20_000 - share[row["a"]] / sum(share.values())) < 0.015

    def moved(changed):
        rows = sharding.shard_of(before, F.col("id"), changed, "b").where("a <> b").select("a", "b").distinct().collect()
        return {(r["a"], r["b"]) for r in rows}

    T = sharding.Tree
    new = T((*leaves[:2], S(0, 1, 0, 2, 0.75), *leaves[3:]), racks=tree.racks, regions=tree.regions)
    assert {b for _, b in moved(new)} == {2}
    less = T(leaves, racks={(1, 0): 0.25}, regions=tree.regions)
    assert {a for a, _ in moved(less)} == {3}
    heavy = T(leaves, racks=tree.racks, regions={1: 4.0, 5: 0.5})
    assert {b for _, b in moved(heavy)} == {3, 4} and {a for a, _ in moved(heavy)} <= {0, 1, 2, 5}
    more = T((*leaves, S(7, 1, 1, 9)), racks=tree.racks, regions=tree.regions)
    assert {b for _, b in moved(more)} == {9}
    for n in range(8, 12):
        grown = sharding.shard_of(sharding.shard_of(keys, F.col("id"), sharding.even_tree(n), "a"), F.col("id"), sharding.even_tree(n + 1), "b")
        assert grown.where(f"a <> b AND b <> {n}").isEmpty()
    for wrong in ((leaves[0], leaves[0]), (S(0, 2, 0, 0),), (S(0, 0, 0, 0, 1.5),), (S(0, 0, 0, 0, 0.0),)):
        with pytest.raises(ValueError):
            sharding.Tree(wrong)


# 3 Byte-level BPE


def unicode_texts(n, seed=2):
    r = random.Random(seed)
    parts = [chr(x) for x in (9, 10, 13, 28, 31, 32, 32, 32, 39, 48, 65, 97, 115, 133, 160, 0xE9, 0x301, 0x3000, 0x4E2D, 0x200B, 0x1F600)] + ["'s", " the", "'ll", " 12", "  "]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(n)]


def tiktoken_encoder(name):
    import tiktoken

    lines = open(public_tokenizers.path(name), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, documents, tricky, empty):
    name = "byte_bpe_multi_50k.tiktoken"
    path, encoder = public_tokenizers.path(name), tiktoken_encoder(name)
    own = bpe.ByteBPE(bpe.read_vocabulary(path), public_tokenizers.PATTERN)
    texts = unicode_texts(3000) + ["a" * 3000, "!?" * 700, " " * 900, "<|endoftext|>"]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    found = {r["doc_id"]: r for r in bpe.bpe_codec(documents, path, public_tokenizers.PATTERN).collect()}
    for doc_id, text in texts_of(documents).items():
        ids = np.array(encoder.encode_ordinary(text or ""), "<u4").tobytes()
        assert found[doc_id]["n_tokens"] == len(ids) // 4
        assert found[doc_id]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert found[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.bpe_codec(tricky, path, public_tokenizers.PATTERN).count() == len(TRICKY)
    assert bpe.bpe_codec(empty, path, public_tokenizers.PATTERN).collect() == []


def test_bpe_small_vocabulary():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"aa", b"aaa"]
    file = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    own = bpe.ByteBPE(file, public_tokenizers.PATTERN)

    def brute(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            ranked = [(tokens.index(a + b), i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in tokens]
            if not ranked:
                return [tokens.index(p) for p in parts]
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(4)
    pieces = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 40))) for _ in range(400)]
    for piece, ids in zip(pieces, own.merge(pieces), strict=True):
        assert ids.tolist() == brute(piece)


def test_long_pieces():
    """Pieces of over LONG bytes are merged alone, to the same ids, and a megabyte in seconds."""
    import time

    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"aa", b"aaa", b"ca", b"cab"]
    own = bpe.ByteBPE(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)), public_tokenizers.PATTERN)
    r = random.Random(11)
    for _ in range(40):
        piece = bytes(r.choice(b"abc") for _ in range(r.randint(2, 500)))
        assert own._alone(piece).tolist() == own.merge([piece])[0].tolist()
    name = "byte_bpe_multi_50k.tiktoken"
    own, encoder = bpe.ByteBPE(bpe.read_vocabulary(public_tokenizers.path(name)), public_tokenizers.PATTERN), tiktoken_encoder(name)
    texts = ["".join(r.choice("acgt") for _ in range(1_000_000)), "".join(r.choice("这是一个很长的句子没有空格") for _ in range(50_000)), "a" * 200_000, "".join(r.choice("abcdefghijklmnop") for _ in range(100_000)) + " word"]
    began = time.time()
    for text in texts:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == encoder.encode_ordinary(text) and own.decode(ids) == text.encode()
    assert time.time() - began < 60


# 4 Token counts


def brute_pieces(word, first, inner):
    i = n = 0
    while i < len(word):
        known = inner if i else first
        j = next((j for j in range(len(word), i, -1) if word[i:j] in known), None)
        if j is None:
            return 0
        i, n = j, n + 1
    return n


def test_longest_match():
    r = random.Random(6)
    for _ in range(200):
        first, inner = ({bytes(r.choice(b"ab") for _ in range(r.randint(1, 4))) for _ in range(4)} for _ in range(2))
        automaton = token_counts.LongestMatch(first, inner)
        for _ in range(30):
            word = bytes(r.choice(b"ab") for _ in range(r.randint(1, 9)))
            assert automaton.count(word) == brute_pieces(word, first, inner)


def test_token_counts(documents, tricky, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = {base64.b64decode(x.split()[0]) for x in open(path, "rb")}
    first, inner = {t for t in tokens if t[:1] == b" " and b" " not in t[1:]}, {t for t in tokens if b" " not in t}
    split = token_counts.counter(bpe.read_vocabulary(path), b" ").split
    found = {r["doc_id"]: r for r in token_counts.token_counts(documents, path).collect()}
    pieces = functools.cache(lambda w: brute_pieces(b" " + w.encode(), first, inner))
    for doc_id, text in texts_of(documents).items():
        counts = [pieces(w) for w in split(text or "")]
        assert (found[doc_id]["n_words"], found[doc_id]["n_tokens"], found[doc_id]["n_unknown"]) == (len(counts), sum(counts) + counts.count(0), counts.count(0))
    rows = {r["doc_id"]: r for r in token_counts.token_counts(tricky, path).collect()}
    assert rows[3]["n_tokens"] == rows[4]["n_tokens"] == rows[5]["n_words"] == 0
    assert token_counts.token_counts(empty, path).collect() == []


# 5 N-gram join


def brute_sets(texts):
    out = []
    for t in texts:
        words = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_links(sets):
    return [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]


def family(seed, n=60, size=60, edits=3):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 400)}" for _ in range(size)]
    texts = []
    for i in range(n):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(size)] = f"x{r.randint(0, 9)}"
        if i % 9 == 0:
            words = words[: r.randint(3, size)]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "QUERIES_EACH", 7)
    texts = family(1) + family(2, 25) + ["one two", "one  TWO", "one two three", None, "", "   ", "ab cd ef gh ij kl", "ab cd ef gh ij kl mn"]
    ids = random.Random(3).sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    sets = brute_sets(texts)
    links = brute_links(sets)
    parent = list(range(len(ids)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i, j in links:
        parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    want = sorted((d, len(sets[i]), least[root(i)], sum(i in x for x in links)) for i, d in enumerate(ids))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.ngram_join(df).collect())
    assert got == want
    stay = ngram_join.one_of_each(df)
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(d for d, _, c, _ in want if d == c)


def test_search_is_exact():
    r = random.Random(8)
    sets = [np.unique(np.array([r.randint(0, 60) for _ in range(r.randint(1, 30))], np.uint64)) for _ in range(300)]
    lists = ngram_join.InvertedLists(sets)
    for i, s in enumerate(sets):
        want = [j for j, t in enumerate(sets) if 4 * len(np.intersect1d(s, t)) >= 3 * len(np.union1d(s, t))]
        assert sorted(lists.search(s).tolist()) == want
        assert sorted(lists.search(s, i).tolist()) == [j for j in want if j > i]


def test_ngram_join_edges(tricky, empty):
    rows = ngram_join.ngram_join(tricky).collect()
    assert len(rows) == len(TRICKY)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[2][0]["component_id"] == 1 and by[3][0]["component_id"] == 3 and by[4][0]["n_shingles"] == 0
    assert by[None][0]["component_id"] is None
    assert sorted(r["n_links"] for r in by[9]) == [0, 1, 1]
    assert ngram_join.ngram_join(empty).collect() == []
    stay = ngram_join.one_of_each(tricky)
    assert stay.columns == tricky.columns and stay.count() == len(TRICKY) - 2


def test_components(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(bytes([100]), bytes([i])) for i in range(101, 140)] + [(bytes([50]), bytes([50]))]
    got = {bytes(r["node"]): bytes(r["root"]) for r in ngram_join.components(spark.createDataFrame(chain, "node binary, root binary")).collect()}
    assert got == {bytes([i]): bytes([0]) for i in range(1, 41)} | {bytes([i]): bytes([100]) for i in range(101, 140)}


# 6 Toxicity


def test_toxicity(spark, tricky, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    ones, zeros = ([r["score"] for r in held if r["toxic"] == y] for y in (1, 0))
    assert np.mean(np.array(ones)[:, None] > np.array(zeros)) > 0.95
    assert sum(r["predicted"] for r in held if not r["toxic"]) <= 0.01 * len(zeros)
    assert sum(r["predicted"] for r in held if r["toxic"]) >= 0.8 * len(ones)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert toxicity.toxicity(tricky, labels).count() == len(TRICKY)
    assert toxicity.toxicity(empty, labels).collect() == []
    assert toxicity.toxicity(tricky, labels.limit(0)).select("score").distinct().count() == 1
    stay = toxicity.keep_civil(tricky, labels)
    assert stay.columns == tricky.columns


def test_swaps_count_less():
    r = random.Random(1)
    filler = [f"w{i}" for i in range(50)]
    texts, labels = [], []
    for i in range(400):
        words = r.sample(filler, 6)
        toxic = i % 2
        words += ["scum"] * toxic if r.random() < 0.8 else []
        words += ["muslim"] if r.random() < (0.7 if toxic else 0.1) else ["christian"] if r.random() < 0.2 else []
        texts.append(" ".join(words))
        labels.append(toxic)
    gap = lambda m: abs(np.log(m.score("muslim") / (1 - m.score("muslim"))) - np.log(m.score("christian") / (1 - m.score("christian"))))
    assert gap(toxicity.fit(texts, labels)) < 0.5 * gap(toxicity.fit(texts, labels, penalty=0.0))


def dense_fit(texts, labels, penalty, others):
    """The same loss over dense matrices, its gradient taken by plain loops over rows."""
    sets = [toxicity.all_features(toxicity.words_of(t)) for t in texts]
    ones, zeros = sum(labels), len(labels) - sum(labels)
    count = {f: [sum(f in s for s, y in zip(sets, labels, strict=True) if y == label) for label in (0, 1)] for f in set().union(*sets)}
    prior, n = toxicity.PRIOR, len(labels)
    scale = {}
    for f, (n0, n1) in sorted(count.items()):
        if n0 + n1 > 2:
            rate1, rate0 = (n1 + prior * ones / n) / (ones + prior), (n0 + prior * zeros / n) / (zeros + prior)
            odds = np.log(rate1 / (ones / n) / (rate0 / (zeros / n)))
            if odds > toxicity.CUT:
                scale[f] = odds - toxicity.CUT
    names = sorted(scale)
    row = lambda words: np.array([scale[f] if f in toxicity.all_features(words) else 0.0 for f in names])
    x = np.array([row(toxicity.words_of(t)) for t in texts])
    gaps = [row(toxicity.words_of(t)) - row(o) for t in texts for o in toxicity.swapped(toxicity.words_of(t), others)]
    w, b, sw, sb = np.zeros(len(names)), 0.0, np.full(len(names), 1e-8), 1e-8
    for _ in range(toxicity.EPOCHS):
        gw, gb = toxicity.DECAY * w / max(1, len(names)), 0.0
        for xi, y in zip(x, labels, strict=True):
            e = (1 / (1 + np.exp(-(xi @ w + b))) - y) * 0.5 / (ones if y else zeros)
            gw, gb = gw + e * xi, gb + e
        for d in gaps:
            gw = gw + 2 * penalty * (d @ w) * d / len(gaps)
        sw, sb = sw + gw**2, sb + gb**2
        w, b = w - toxicity.RATE * gw / np.sqrt(sw), b - toxicity.RATE * gb / np.sqrt(sb)
    return dict(zip(names, w * np.array([scale[f] for f in names]), strict=True)), b


def mentions(seed, n=240):
    """Labelled sentences in which insults make label 1, and one group is often insulted; neutral sentences in which groups are mentioned."""
    r = random.Random(seed)
    filler = [f"w{i}" for i in range(40)]
    kinds = [k for own in toxicity.IDENTITY.values() for k in own if len(k) > 3]
    texts, labels = [], []
    for i in range(n):
        toxic, kind = i % 2, r.choice(kinds[:12])
        words = r.sample(filler, 6) + (["scum"] if toxic and r.random() < 0.7 else [])
        if r.random() < (0.8 if toxic else 0.15):
            words.append(kind[0] if toxic else r.choice(kind))
        texts.append(" ".join(words))
        labels.append(toxic)
    neutral = [" ".join([*r.sample(filler, 6), kind[0], other[0]]) for kind in kinds[:12] for other in kinds[:12]]
    return texts, labels, neutral


def test_fit_is_the_fit():
    texts, labels, _ = mentions(3, 120)
    for penalty in (0.0, 1.0):
        model = toxicity.fit(texts, labels, penalty)
        weights, bias = dense_fit(texts, labels, penalty, toxicity.swaps(toxicity.IDENTITY))
        assert model.weights.keys() == {f for f, v in weights.items() if v}
        assert np.allclose([model.weights[f] for f in sorted(model.weights)], [weights[f] for f in sorted(model.weights)], atol=1e-6) and abs(model.bias - bias) < 1e-6
        for text in texts[:20]:
            assert abs(model.score(text) - 1 / (1 + np.exp(-bias - sum(weights.get(f, 0) for f in toxicity.all_features(toxicity.words_of(text)))))) < 1e-6


def test_neutral_mentions_are_spared():
    """The penalty takes most false alarms on sentences that only mention groups, in English and German, and keeps the insults."""
    texts, labels, neutral = mentions(5, 2000)
    alarms = {}
    for penalty in (0.0, 1.0):
        model = toxicity.fit(texts, labels, penalty)
        alarms[penalty] = np.mean([model.score(t) >= toxicity.THRESHOLD for t in neutral])
        assert model.score("w1 w2 scum") >= toxicity.THRESHOLD
    assert alarms[0.0] > 0.5 and alarms[1.0] < 0.1 * alarms[0.0]
    assert toxicity.fit(texts, labels, 1.0, identity={}).weights == toxicity.fit(texts, labels, 0.0).weights


def test_sample_has_bounds(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(99, None), (99, "again")], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(1).alias("text"))
    texts, marks = toxicity.sampled(docs, labels, 5, 1 << 20)
    assert collections.Counter(marks) == {0: 5, 1: 5}
    assert sum(len(t or "") for t in toxicity.sampled(docs, labels, 20, 1000)[0]) <= 1000


def test_a_text_over_the_bound_costs_itself_only(spark):
    """One huge text in each label, whatever its place in the order of hashes: all others teach."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:200]
    rows = [(i, f"you vile fool number {i}" if i % 2 else f"a calm walk number {i}") for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    for huge in (ids[0], ids[1], ids[2], ids[-1], ids[-2]):
        docs = spark.createDataFrame([(i, "vast " * 20_000 if i in (huge, huge ^ 1) else t) for i, t in rows], "doc_id long, text string")
        texts, found = toxicity.sampled(docs, labels, most=100_000)
        assert sorted(found) == sorted(i % 2 for i in ids if i not in (huge, huge ^ 1)) and max(map(len, texts)) < 50
    assert toxicity.sampled(docs, labels, most=10) == ([], [])


def test_held_out_labels_teach_nothing(spark, documents):
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    held = F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1")
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.sampled(documents, labels) == toxicity.sampled(documents, flipped)


# 7 Language identification


def test_language_id(spark, tricky, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where(F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"))
    found = language_id.language_id(held, docs.join(held.select("doc_id"), "doc_id", "left_anti")).join(held.select("doc_id", "lang"), "doc_id")
    assert found.where("lang_pred = lang").count() > 0.97 * found.count()
    rows = {r["doc_id"]: r for r in language_id.language_id(tricky, docs).collect()}
    assert rows[3]["lang_pred"] == rows[4]["lang_pred"] == rows[5]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert language_id.language_id(empty, docs).collect() == []
    assert {r["lang_pred"] for r in language_id.language_id(tricky, empty).collect()} == {"und"}


def all_buckets(texts):
    found = [language_id.buckets(c) for c in language_id.chunks(texts)]
    return [sorted(np.concatenate([cells[rows == i] for rows, cells in found]).tolist()) for i in range(len(texts))]


def brute_language(text, train):
    """Bayes by plain sums over n-grams, each hashed alone."""
    langs = sorted({k for _, k in train})
    counts = {k: collections.Counter() for k in langs}
    for t, k in train:
        counts[k].update(all_buckets([t])[0])
    own = collections.Counter(all_buckets([text])[0])
    logs = []
    for k in langs:
        total = sum(counts[k].values()) + language_id.SMOOTHING * (1 << language_id.BITS)
        prior = np.log((sum(x == k for _, x in train) + 1) / (len(train) + len(langs)))
        logs.append(sum(n * np.log((counts[k][c] + language_id.SMOOTHING) / total) for c, n in own.items()) / language_id.OVERLAP + prior)
    odds = np.exp(np.array(logs) - max(logs))
    return langs[int(odds.argmax())], float(odds.max() / odds.sum())


@pytest.mark.parametrize("each", [64, 2])
def test_bayes_is_bayes(spark, monkeypatch, each):
    """Also with more languages than a slice of the model has."""
    monkeypatch.setattr(language_id, "LANGS_EACH", each)
    train = [("aa ab", "x"), ("bb ba ab", "y"), ("bbb", "y"), ("cab", "z"), ("éa", "v"), ("cc bc", "w"), ("aa ab", "xx")]
    texts = ["aab", "b", "cabc", "É", "aa ab ba", "zzz", "x" * 50]
    model = language_id.learn(spark.createDataFrame(train, "text string, lang string"))
    assert len(model) == -(-6 // each)
    answers, scores = language_id.predict([*texts, None, "", "12"], lambda: iter(model))
    want = [brute_language(t, train) for t in texts]
    assert answers == [x for x, _ in want] + ["und"] * 3
    assert np.allclose(scores, [x for _, x in want] + [0] * 3)


def test_grams_stay_in_their_text(monkeypatch):
    texts = ["ab", "", "c", "the quick brown fox " * 9, "Ünïcode 中文"]
    plain = []
    for t in texts:
        folded = " " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " "
        plain.append(sum(max(0, len(folded) - n + 1) for n in language_id.ORDERS))
    whole = all_buckets(texts)
    assert [len(x) for x in whole] == plain
    assert whole == [all_buckets([t])[0] for t in texts]
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert all_buckets(texts) == whole


# 8 Chat trees


def test_escapes(spark):
    texts = ["", "\\", "\\l", "<turn user>", "</turn>\n", "a\\b<c>\\g", "\\### Assistant: </turn> ok", "🙂<\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_trees.escaped(F.col("t")).alias("e"))
    assert df.where("e LIKE '%<%' OR e LIKE '%>%'").isEmpty()
    assert df.where(chat_trees.unescaped(F.col("e")) != F.col("t")).isEmpty()


def test_trees(spark):
    #      1          9 (its parent is missing)   20 -> 21 -> 20, 22 under 21
    #    2   3
    #   4 5   6 - 7
    edges = {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 6, 9: 999, 20: 21, 21: 20, 22: 21, 30: 30}
    score = {1: 0.0, 2: 5.0, 3: 1.0, 4: 1.0, 5: 1.0, 6: 1.0, 7: 1.5, 9: None, 20: 9.0, 21: 9.0, 22: 9.0, 30: 9.0}
    rows = [(100 if n < 9 else n, n, p, score[n], "assistant" if n % 2 else "user", f"text {n} <b>") for n, p in edges.items()]
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, score double, role string, text string")
    paths = collections.defaultdict(list)
    for r in chat_trees.root_paths(df).collect():
        paths[r["leaf"]].append((r["up"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {4: [4, 2, 1], 5: [5, 2, 1], 7: [7, 6, 3, 1], 9: [9]}
    every = chat_trees.read_back(chat_trees.format_trees(df, 0)).orderBy("conv_id", "branch").collect()
    assert [[t["text"] for t in r["turns"]] for r in every] == [["text 9 <b>"], ["text 1 <b>", "text 2 <b>", "text 4 <b>"], ["text 1 <b>", "text 2 <b>", "text 5 <b>"], ["text 1 <b>", "text 3 <b>", "text 6 <b>", "text 7 <b>"]]
    assert every[2]["loss_text"] == "text 1 <b>text 5 <b>"
    assert [r["branch"] for r in chat_trees.format_trees(df).where("conv_id = 100").collect()] == [1]


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "b"), (2, 5, "as>si", "</turn>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = {r["conv_id"]: r for r in chat_trees.read_back(chat_trees.format_trees(chat_trees.threads(df))).collect()}
    assert [(t["role"], t["text"]) for t in read[1]["turns"]] == [("", ""), ("user", "a"), ("user", "a")]
    assert read[None]["loss_text"] == "b" and read[2]["turns"][0]["role"] == "as>si"
    assert chat_trees.format_trees(chat_trees.threads(df.limit(0))).collect() == []


# 9 Fingerprints


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def brute_sketch(text):
    """(hash, place) of each anchor, sorted, by a plain scan; hashes are the engine's."""
    raw, k, s = text.encode(), fingerprints.K, fingerprints.S
    signed = lambda h: h - 2**64 if h >> 63 else h
    top = lambda h: h >> (64 - fingerprints.HASH_BITS)
    g = [signed(xx(raw[i : i + s])) for i in range(len(raw) - s + 1)]
    found = [(top(xx(raw[i : i + k])), i) for i in range(len(raw) - k + 1) if min(g[i : i + k - s + 1]) in (g[i], g[i + k - s])]
    if len(raw) < fingerprints.SURE:
        found += [(top(xx(raw[i : i + s])), i) for i in range(len(raw) - s + 1)] if len(raw) >= s else [(top(xx(raw)), 0)] if raw else []
    seen, out = collections.Counter(), []
    for h, i in sorted(found):
        r, seen[h] = seen[h], seen[h] + 1
        out.append((h, i) if r == 0 else (top(xx(r.to_bytes(4, "little"), xx(h.to_bytes(8, "little")))), i))
    return sorted(out)


def brute_likeness(text, other):
    a, b = brute_sketch(text), brute_sketch(other)
    if not text and not other:
        return 1.0
    most = int(fingerprints.NEAR + fingerprints.DRIFT * max(len(text.encode()), len(other.encode())))
    every = sorted(a + b)
    both = sum(x[0] == y[0] and y[1] - x[1] <= most for x, y in itertools.pairwise(every))
    return min(1.0, 2 * both / max(1, len(a) + len(b)))


def brute_fingerprints(ordered):
    """The operator's rows for texts in the order of their documents."""
    texts = [t or "" for t in ordered]
    sketches = functools.cache(brute_sketch)
    out = []
    for text, after in zip(texts, [*texts[1:], texts[0]], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        name = lambda t: " ".join([str(len(t.encode())), *(f"{h:x}.{i}" for h, i in sketches(t))])
        out.append((len(text), hashlib.sha256(edited.encode()).hexdigest(), name(text), name(edited), round(brute_likeness(text, edited), 12), round(brute_likeness(text, after), 12)))
    return out


def plain_rows(rows):
    return [(r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 12), round(r["near_next"], 12)) for r in rows]


def test_fingerprints(spark, documents):
    """Every column, on whole documents, against a plain scan of texts and of edited texts."""
    texts = texts_of(documents)
    rows = sorted(fingerprints.document_fingerprints(documents).collect(), key=lambda r: r["doc_id"])
    assert plain_rows(rows) == brute_fingerprints([texts[d] for d in sorted(texts)])


def test_fingerprint_edges(spark, tricky, empty):
    """Rows without id come first, rows with one id follow each other by a hash of the text."""
    tie = lambda t: (lambda h: h - 2**64 if h >> 63 else h)(xx((t or "").encode()))
    ordered = sorted(TRICKY, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    rows = fingerprints.document_fingerprints(tricky).collect()
    assert sorted(plain_rows(rows)) == sorted(brute_fingerprints([r[1] for r in ordered]))
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert fingerprints.document_fingerprints(empty).collect() == []
    alone = fingerprints.document_fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_edits_are_near(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = fingerprints.document_fingerprints(docs).collect()
    long = [r for r in rows if r["n_chars"] > 400]
    assert min(r["near_edited"] for r in long) > 0.4 and np.mean([r["near_edited"] for r in long]) > 0.7
    assert np.mean([r["near_next"] for r in long]) < 0.02


def sketched(spark, pairs):
    """likeness and both fingerprints of pairs of texts."""
    df = spark.createDataFrame(pairs, "t string, u string")
    for c in "tu":
        df = fingerprints.with_sketch(df.withColumn(f"k{c}", fingerprints.syncmers(F.col(c).cast("binary"))), c, f"k{c}", f"s{c}")
    t, u = [(F.col(c), F.col(f"s{c}")) for c in "tu"]
    return df.select(fingerprints.fingerprint(*t).alias("ft"), fingerprints.fingerprint(*u).alias("fu"), fingerprints.likeness(*t, *u).alias("x"), fingerprints.likeness(*t, *t).alias("one")).collect()


def test_fingerprints_keep_every_anchor(spark):
    """A passage replaced in a long text shows, and repeated passages count as often as they stand there."""
    r = random.Random(3)
    words = [f"w{r.randrange(5000)}" for _ in range(20_000)]
    rows = [(" ".join(words), " ".join([*words[:at], *(f"v{i}" for i in range(50)), *words[at + 50 :]])) for at in range(500, 20_000, 2500)]
    line = " ".join(words[:100])
    rows.append((" ".join([line] * 20), " ".join([line] * 40)))
    got = sketched(spark, rows)
    assert all(len(g["ft"].split()) > 7_000 for g in got[:-1])
    assert all(g["ft"] != g["fu"] and 0.99 < g["x"] < 1 for g in got[:-1])
    assert 0.6 < got[-1]["x"] < 0.7
    assert {g["one"] for g in got} == {1.0}


def test_fingerprints_without_spaces(spark):
    """One inserted character disturbs the anchors around it, whatever the script and wherever; the others stay."""
    r = random.Random(5)
    texts = ["".join(r.choice(letters) for _ in range(3000)) for letters in ("abcdefghij{};=()", [chr(c) for c in range(0x4E00, 0x5200)], "🙂🙃😀😁กขคงจ", "ab c")]
    got = sketched(spark, [(t, t[:at] + "q" + t[at:]) for t in texts for at in (0, 1, 100, 1500, 2999, 3000)])
    assert all(0.96 < g["x"] <= 1 for g in got)
    assert all(g["ft"] != g["fu"] for g in got)


# 10 Packing


def test_shortest_pack_first():
    r = random.Random(7)
    for _ in range(100):
        lengths = [r.randint(1, 50) for _ in range(r.randint(0, 80))]
        patterns = packing.shortest_pack_first(collections.Counter(lengths), 50)
        assert sorted(x for p, n in patterns for x in p * n) == sorted(lengths)
        assert all(sum(p) <= 50 for p, _ in patterns)
        packs = []
        for length in sorted(lengths, reverse=True):
            at = min(range(len(packs)), key=lambda i: packs[i], default=None)
            if at is None or packs[at] + length > 50:
                packs.append(length)
            else:
                packs[at] += length
        assert sorted(packs) == sorted(sum(p) for p, n in patterns for _ in range(n))


def check_packs(rows):
    packs = collections.defaultdict(list)
    for r in rows:
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in packs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WIDTH
    return packs


def test_packing(documents, tricky, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(documents, path, public_tokenizers.PATTERN).collect()
    packs = check_packs(rows)
    assert sum(r["length"] for r in rows) > 0.97 * packing.WIDTH * (len(packs) - 1)
    tokenizer = Tokenizer.from_file(path)
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for doc_id, text in texts_of(documents).items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    found = packing.pack_documents(tricky, path, public_tokenizers.PATTERN).collect()
    check_packs(found)
    assert sum(r["doc_tokens"] == 1 for r in found) == 2  # null and empty texts
    assert packing.pack_documents(empty, path, public_tokenizers.PATTERN).collect() == []


def test_both_tokenizers_agree():
    file = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    ranked, plain = packing.RankTokenizer(file, public_tokenizers.PATTERN), packing.PieceTokenizer(file, public_tokenizers.PATTERN)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(file.decode())
    special = ["<|endoftext|>", "hello <|endoftext|> x", "<|endoftext|><|endoftext|>\n", "<|endoftext|", "a<|endoftext|>b " * 50]
    long = ["the cat sat on 12 mats. " * 10_000, "x" * 300_000, " " * 250_000 + "y", "ab " * 100_000 + "<|endoftext|>"]
    texts = unicode_texts(3000, 9) + ["", "a b" * 900, "  x", " ", "\n\n a", *special, *long]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert want[texts.index(special[1])] == [31373, 220, 50256, 2124]
    for own in (ranked, plain, packing.WholeTokenizer(file)):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_group(texts)] == want
    vocabulary = json.loads(file)["model"]["vocab"]
    assert len(ranked.ranked._mergeable_ranks) >= len(vocabulary) - 1
    assert isinstance(packing.piece_tokenizer(file, public_tokenizers.PATTERN), packing.RankTokenizer)
    assert isinstance(packing.piece_tokenizer(file, r"\S+"), packing.WholeTokenizer)
    shuffled = json.loads(file)
    shuffled["model"]["merges"].reverse()
    assert isinstance(packing.piece_tokenizer(json.dumps(shuffled).encode(), public_tokenizers.PATTERN), packing.PieceTokenizer)
    assert packing.BYTE_LEVEL == public_tokenizers.PATTERN


def test_hot_length_is_numbered_without_gaps(spark):
    from quillmill.llm.common import ranked

    df = spark.createDataFrame(pd.DataFrame({"k": [1] * 900 + [2] * 100, "x": range(1000)}))
    rows = ranked(df, ["k"], ["x"], 1000, each=50).collect()
    for k, n in ((1, 900), (2, 100)):
        assert sorted(r["rank"] for r in rows if r["k"] == k) == list(range(n))


def test_shuffled_docs_are_cut(spark, documents):
    """A scan stays one; what comes of a shuffle is written first, and joins to the same result."""
    some = documents.select("doc_id", "text")
    assert common.settled(some) is some
    dealt = some.repartition(7)
    with common.holding():
        done = common.settled(dealt)
        assert "RDD" in done._jdf.queryExecution().executedPlan().toString() and done.count() == some.count()
        want = sorted(map(tuple, ngram_join.ngram_join(some).collect()))
        assert sorted(map(tuple, ngram_join.ngram_join(dealt).collect())) == want


def test_cut_files_go_with_their_scope(spark):
    files = lambda: {f for d, _, names in os.walk(common.shared_folder(spark).removeprefix("file:")) for f in (os.path.join(d, n) for n in names) if "part-" in f}
    before = files()
    with common.holding():
        kept = common.cut(spark.range(100).withColumn("x", F.col("id") * 2))
        assert kept.agg(F.sum("x")).first()[0] == 9900 and files() > before
    assert files() <= before


def test_held_results_are_not_stale(spark, tmp_path):
    """A table written anew under its path is read anew, and holding() lets go of its own only."""
    from quillmill.llm import common

    for n in (2, 3):
        spark.createDataFrame([(i, f"text {i}") for i in range(n)], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert len(sharding.op2_shard_documents(spark, str(tmp_path)).collect()) == n
    outside = common.hold(spark.range(5))
    with common.holding():
        inside = common.hold(spark.range(6))
        assert inside.count() == 6 and len(common._HELD[-1]) == 1
    assert outside.count() == 5 and common._HELD[-1]


def test_slices_by_rows_and_bytes():
    import pyarrow as pa

    from quillmill.llm.common import slices

    texts = ["a" * 10, None, "b" * 95, "c" * 300, "", "d"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    assert [s.column("text").to_pylist() for s in slices(batch, 4, 100)] == [["a" * 10, None], ["b" * 95], ["c" * 300], ["", "d"]]
    assert [s.num_rows for s in slices(batch, 2, 10_000)] == [2, 2, 2]
