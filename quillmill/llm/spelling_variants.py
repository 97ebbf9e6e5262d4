"""Grouping of spelling variants: words that are one inserted, deleted or replaced code point apart.

1. Counts. Each task counts the words of its documents before anything is shuffled, so that no frequent word gathers.
2. Blocks. One edit leaves a half of a word intact. Two words of one length, or of neighbouring lengths, thus share the
   first half of the shorter one, and lie side by side in the dictionary, or its last half, and lie side by side in the
   dictionary of reversed words. `first` and `last` count the letters at both ends that a block's words share; the edit
   is at one of the `open` places between them.
3. Subdivision. A block of more than BLOCK words is divided: the edit is in the first half of its open places, so that
   the letters of the other half are shared as well, or the other way round. With one open place left, the words of one
   length differ in that letter alone, so that a block has no more words than there are letters. Blocks are counted and
   divided on the cluster, round by round, before any of them reaches a task.
4. Scan. Blocks are range-partitioned by what they share, sorted, and scanned one by one; a task divides a block further
   in the same way, until a handful of words is left, and verifies those. The place of a pair's edit, the end of its
   common prefix, lies in one block of each level, and the pair counts there alone.
5. Forms. Each word's near words are reduced to their number and the best one before they are shuffled; chains of forms
   are followed by doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut, hold, slices, table

#: Code points of a word, and its occurrences, at least.
SHORTEST, SEEN = 6, 5
#: A form occurs so many times as often as the word, at least.
TIMES = 5
#: One letter of a run goes where the checksum of document and run is divisible by this.
DAMAGED = 199
#: Words of a block that a task takes as it is; a larger block is divided on the cluster.
BLOCK = 4096
#: Words whose pairs a task compares without dividing them further.
FEW = 8
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 200_000
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}")


def damaged(key: str, run: str, every: int) -> str:
    """The run, without one letter where the checksum says so; every = 0 leaves all runs as they are."""
    h = zlib.crc32(f"{key}:{run}".encode()) if every else 1
    return run if not every or h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, every: int = DAMAGED) -> DataFrame:
    """word, n: how often each word of SHORTEST code points or more occurs in docs (doc_id, text).

    A deletion makes a run shorter, so that shorter runs need no look. A null doc_id counts as an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def found() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in slices(batch, 512):
                for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    for word, n in Counter(RUN.findall(text.translate(ASCII_LOWER))).items():
                        word = damaged(key, word, every)
                        if len(word) >= SHORTEST:
                            counts[word] += n
                    if len(counts) >= COUNTED:
                        yield found()
        yield found()

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_SHARED = ("extra", "short", "first", "last")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with `head` and `tail`, the letters that the words of their blocks share; tail is read backwards."""
    head = F.substring("word", F.lit(1), F.col("first"))
    return rows.withColumn("head", head).withColumn("tail", F.reverse(F.expr("right(word, last)")))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in the two blocks that its block is divided into."""
    places = F.col("short") + F.col("extra") - F.col("first") - F.col("last")
    half = F.floor(places / 2).cast("int")
    ends = F.explode(F.array(F.struct((F.col("first") + half).alias("first"), F.col("last").alias("last")), F.struct(F.col("first").alias("first"), (F.col("last") + places - half).alias("last"))))
    return _keyed(rows.withColumn("half", ends).select("word", "n", "extra", "short", F.col("half.first").alias("first"), F.col("half.last").alias("last")))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, n and the block: extra (0: pairs of one length, 1: of neighbouring lengths), short (the shorter length),
    first, last, head, tail. No block has more than `most` words, but for those with one open place, which are bounded
    by the number of letters.

    A word of n letters is in blocks of (0, n), (1, n) as the shorter one, and (1, n - 1) as the longer one.
    """
    n = F.length("word")
    roles = F.explode(F.array(*[F.struct(F.lit(extra).alias("extra"), (n - less).cast("int").alias("short")) for extra, less in ((0, 0), (1, 0), (1, 1))]))
    whole = words.withColumn("role", roles).select("word", "n", "role.*", F.lit(0).alias("first"), F.lit(0).alias("last"))
    rows, small = cut(_halved(whole)), []
    key = [*_SHARED, "head", "tail"]
    while True:
        large = hold(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > most) & (F.col("short") + F.col("extra") - F.col("first") - F.col("last") > 1)).drop("size"))
        if large.isEmpty():
            break
        small.append(rows.join(large, key, "left_anti"))
        rows = cut(_halved(rows.join(large, key, "left_semi")))
    for more in small:
        rows = rows.unionByName(more)
    return rows


def _common(a: str, b: str, at: int) -> int:
    """How many letters a and b share from the start, the first `at` being known."""
    end = min(len(a), len(b))
    while at < end and a[at] == b[at]:
        at += 1
    return at


def near_pairs(words: list[str], extra: int, short: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in words that are one edit apart, the edit being at one of the block's open places.

    words: distinct words of `short` letters, and of one more where extra is 1, that share `first` letters at the start
    and `last` at the end.
    """
    todo = [([*range(len(words))], first, last)]
    while todo:
        own, first, last = todo.pop()
        places = short + extra - first - last
        shorter, longer = (own, own) if not extra else ([i for i in own if len(words[i]) == short], [i for i in own if len(words[i]) > short])
        if not shorter or not longer:
            continue
        if places > 1 and len(own) > FEW:
            half = places // 2
            for a, b in ((first + half, last), (first, last + places - half)):
                groups = defaultdict(list)
                for i in own:
                    groups[words[i][first:a], words[i][len(words[i]) - b : len(words[i]) - last]].append(i)
                todo += [(x, a, b) for x in groups.values() if len(x) > 1]
            continue
        for at, i in enumerate(shorter):
            x = words[i]
            for j in longer if extra else own[at + 1 :]:
                y = words[j]
                p = _common(x, y, first)
                if p < first + places and x[p + 1 - extra :] == y[p + 1 :]:
                    yield i, j


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, n_near, near_n, near: for each word that has near words their number, the largest n among them, and the
    smallest word of that n. words: distinct words and their n."""
    key = [*_SHARED, "head", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, known = None, [], {}

        def scanned() -> Iterator[pa.RecordBatch]:
            names, counts = [w for w, _ in held], [n for _, n in held]
            number: Counter = Counter()
            for i, j in near_pairs(names, *block[:4]):
                for a, b in ((i, j), (j, i)):
                    number[a] += 1
                    rank = (-counts[b], names[b])
                    if a not in known or rank < known[a]:
                        known[a] = rank
            if number:
                columns = [pa.array([names[i] for i in number], pa.string()), pa.array(number.values(), pa.int64()), pa.array([-known[i][0] for i in number], pa.int64()), pa.array([known[i][1] for i in number], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "near_n", "near"])
            known.clear()

        for batch in batches:
            for *own, word, n in zip(*[batch.column(c).to_pylist() for c in (*key, "word", "n")], strict=True):
                if own != block:
                    if len(held) > 1:
                        yield from scanned()
                    block, held = own, []
                held.append((word, n))
        if len(held) > 1:
            yield from scanned()

    ranged = blocks(words, most).repartitionByRange(*key).sortWithinPartitions(*key, "word")
    found = ranged.select(*key, "word", "n").mapInArrow(run, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead in the end. A form is more frequent than its word by a factor, so
    that no chain is a circle, and each round doubles the steps taken."""
    chain = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(chain.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        chain = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return chain


def spelling_variants(docs: DataFrame, every: int = DAMAGED, most: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of SHORTEST letters or more that occurs SEEN times or more.

    A word's form is its near word of largest n, the smallest of those in code-point order, if that n is at least TIMES
    the word's; root is where forms lead in the end, the word itself without a form. Null and empty texts have no words,
    repeated rows count as often as they occur, more columns of docs are ignored, an empty table gives an empty result.
    """
    words = hold(word_counts(docs, every).where(F.col("n") >= SEEN))
    found = hold(words.join(near_words(words, most), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "near", "near_n"))
    has = F.col("near_n") >= TIMES * F.col("n")
    listed = found.select("word", F.when(has, F.col("near")).alias("form"), "n", "n_near", F.when(has, F.col("near_n")).alias("form_n"))
    last = roots(listed.where(F.col("form").isNotNull()))
    return listed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8, with the table `t` of crc_table_sql at hand."""
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)::BIGINT"


CRC_TABLES = """bytes(b, c, i) AS (SELECT b, b::BIGINT, 0 FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bytes WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bytes WHERE i = 8)"""


def _oracle() -> str:
    """Near words by what is left of a word without the letter at each place."""
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE {CRC_TABLES},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS key, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{az}', '{az.lower()}') AS run FROM documents),
c AS (SELECT key, run, count(*) AS n, any_value(t) AS t FROM r, crc WHERE length(run) >= {SHORTEST} GROUP BY key, run),
h AS (SELECT run, n, {crc_sql("key || ':' || run")} AS h FROM c),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {SEEN}),
p AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
e AS (SELECT DISTINCT a.word AS x, b.word AS y FROM p a JOIN p b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT w.word, p.word FROM w JOIN p ON p.rest = w.word UNION SELECT p.word, w.word FROM w JOIN p ON p.rest = w.word),
b AS (SELECT x AS word, count(*) AS n_near, max(w.n) AS near_n, arg_min(y, row(-w.n, encode(y))) AS near FROM e JOIN w ON e.y = w.word GROUP BY x),
f AS (SELECT w.word, CASE WHEN near_n >= {TIMES} * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
g(word, root, done) AS (SELECT word, word, false FROM f UNION ALL SELECT g.word, coalesce(f.form, g.root), f.form IS NULL FROM g JOIN f ON f.word = g.root WHERE NOT done)
SELECT word, form, root, n, n_near, form_n FROM f JOIN g USING (word) WHERE done
"""


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op13_spelling_variants": _oracle()}
