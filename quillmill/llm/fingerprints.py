"""Document fingerprints from closed syncmers, in DataFrame operations only.

Of a text's k-mers, K bytes of its UTF-8 each, those are anchors whose least s-mer of S bytes, by hash, is their first
or last. Whether a k-mer is an anchor depends on its own bytes alone, whatever the script, with or without spaces, and
wherever it stands, so that an edit disturbs no anchor that it does not touch. A fingerprint keeps every anchor with its
place in the text; an anchor that comes again counts as one of its own, by its number among equal ones. Two fingerprints
are as like as the share of anchors that both have at about the same place (Dice's coefficient).

Any text of SURE bytes has an anchor; a shorter one takes its s-mers as well, and one shorter than those itself.

As anchors are free of context, those of a text put together from two others are theirs, but for the k-mers across the
seam: the edited texts are fingerprinted from the anchors of both documents and the 2 K - 2 bytes around the seam.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hold, pieces_for, table

K, S = 32, 8
#: Closed syncmers leave no gap of more than K - S k-mers.
SURE = 2 * K - S
#: Anchors match if their places differ by no more than NEAR bytes and a share DRIFT of the longer text.
NEAR, DRIFT = 48, 0.25
#: An anchor is HASH_BITS of its hash and PLACE_BITS of its place; both fit a positive number, and an array has no more places.
HASH_BITS, PLACE_BITS = 32, 31
#: Rows of a stretch of doc_ids that one task walks, about.
STRETCH = 20_000
#: Up to so many stretches the list of their ends is broadcast, about 24 bytes each.
BROADCAST_ENDS = 100_000


def packed(h: Column, p: Column) -> Column:
    return F.shiftleft(h, PLACE_BITS) + p


def hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, PLACE_BITS)


def place_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once, also where lambdas in use refer to it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _anchor(raw: Column, at: Column, size: Column) -> Column:
    """The anchor of so many bytes from a place on."""
    return packed(F.shiftrightunsigned(F.xxhash64(F.substring(raw, at + 1, size)), 64 - HASH_BITS), at)


def syncmers(raw: Column) -> Column:
    """array of the anchors of a binary column, in the order of their places."""
    inner = K - S

    def least(g: Column, i: Column, at: int) -> Column:
        """Whether the s-mer at one edge is the least; most k-mers fail at one of the first comparisons."""
        own = F.get(g, i + at)
        others = range(1, inner + 1) if at == 0 else range(inner - 1, -1, -1)
        return reduce(and_, [own <= F.get(g, i + j) for j in others])

    def found(raw: Column) -> Column:
        smers = F.transform(F.sequence(F.lit(0), F.octet_length(raw) - S), lambda i: F.xxhash64(F.substring(raw, i + 1, F.lit(S))))
        places = _with(smers, lambda g: F.filter(F.sequence(F.lit(0), F.octet_length(raw) - K), lambda i: least(g, i, 0) | least(g, i, inner)))
        return F.transform(places, lambda i: _anchor(raw, i, F.lit(K)))

    return F.when(F.octet_length(raw) >= K, _with(raw, found)).otherwise(_none())


def short_mers(raw: Column) -> Column:
    """What a text of under SURE bytes takes besides its syncmers."""
    several = lambda raw: F.transform(F.sequence(F.lit(0), F.octet_length(raw) - S), lambda i: _anchor(raw, i, F.lit(S)))
    n = F.octet_length(raw)
    return F.when(n >= SURE, _none()).when(n >= S, _with(raw, several)).when(n > 0, F.array(_anchor(raw, F.lit(0), n))).otherwise(_none())


def joined_syncmers(raw: Column, first: Column, other: Column, second: Column) -> Column:
    """syncmers() of raw followed by other (both binary). first and second have the syncmers of both, and may have those of longer texts that begin so."""
    cut, taken = F.octet_length(raw), F.octet_length(other)
    start = F.greatest(cut - (K - 1), F.lit(0))
    seam = F.concat(F.substring(raw, start + 1, F.lit(K - 1)), F.substring(other, F.lit(1), F.lit(K - 1)))
    own = _with(cut, lambda c: F.filter(first, lambda x: place_of(x) + K <= c))
    across = _with(start, lambda s: F.transform(syncmers(seam), lambda x: x + s))
    behind = _with(F.struct(cut.alias("c"), taken.alias("t")), lambda v: F.transform(F.filter(second, lambda x: place_of(x) + K <= v["t"]), lambda x: x + v["c"]))
    return F.concat(own, across, behind)


def with_sketch(df: DataFrame, text: str, anchors: str, name: str) -> DataFrame:
    """df with `name`: the anchors of a text without nulls, given its syncmers, sorted by hash, then place.

    The second and later anchors of one hash are hashed again with their number, so that the hashes of a sketch differ.
    """
    t = lambda x: f"__{name}_{x}"
    df = df.withColumn(t("a"), F.sort_array(F.concat(F.col(anchors), short_mers(F.col(text).cast("binary")))))
    a, f = F.col(t("a")), F.col(t("f"))
    fresh = lambda i: (i == 0) | (hash_of(F.get(a, i)) != hash_of(F.get(a, i - 1)))
    df = df.withColumn(t("f"), F.when(F.size(a) > 0, F.filter(F.sequence(F.lit(0), F.size(a) - 1), fresh)).otherwise(F.array().cast("array<int>")))
    again = lambda x, r: F.when(r == 0, x).otherwise(packed(F.shiftrightunsigned(F.xxhash64(hash_of(x), r), 64 - HASH_BITS), place_of(x)))
    run = lambda at, j: F.transform(F.slice(a, at + 1, F.coalesce(F.get(f, j + 1), F.size(a)) - at), again)
    return df.withColumn(name, F.when(F.size(f) == F.size(a), a).otherwise(F.sort_array(F.flatten(F.transform(f, run))))).drop(t("a"), t("f"))


def fingerprint(text: Column, sketch: Column) -> Column:
    """The sketch of a text as a string: the number of bytes, then hash.place of each anchor."""
    pairs = F.transform(sketch, lambda x: F.concat(F.lower(F.hex(hash_of(x))), F.lit("."), place_of(x).cast("string")))
    return F.concat_ws(" ", F.octet_length(text).cast("string"), pairs)


def likeness(text: Column, sketch: Column, other: Column, other_sketch: Column) -> Column:
    """From 0 to 1, of two texts and their sketches; 1 for equal ones, also of empty texts, and 0 if only one text is empty."""
    tolerance = F.floor(NEAR + DRIFT * F.greatest(F.octet_length(text), F.octet_length(other))).cast("int")
    # Sorted together, an anchor of both stands beside itself.
    beside = lambda c, most: lambda x, i: (i > 0) & (hash_of(x) == hash_of(F.get(c, i - 1))) & (place_of(x) - place_of(F.get(c, i - 1)) <= most)
    both = _with(tolerance, lambda most: _with(F.sort_array(F.concat(sketch, other_sketch)), lambda c: F.size(F.filter(c, beside(c, most)))))
    share = F.least(F.lit(1.0), 2 * both / F.greatest(F.size(sketch) + F.size(other_sketch), F.lit(1)))
    return F.when((F.octet_length(text) == 0) & (F.octet_length(other) == 0), F.lit(1.0)).otherwise(share)


def stretch_of(docs: DataFrame, rows: int, partitions: int) -> Column:
    """The number of the stretch of doc_ids that a row lies in, rising with doc_id; rows without one lie in the first.

    Quantiles of doc_id (a fixed number, from a mergeable summary) are the coarse ends; between two of them stretches
    have equal widths, as many as the number of rows asks for.
    """
    wanted = max(4 * partitions, pieces_for(rows, STRETCH))
    coarse = min(wanted, 256)
    fine = -(-wanted // coarse)
    marks = [i / coarse for i in range(coarse + 1)]
    found = docs.agg(F.percentile_approx("doc_id", marks, 10_000).alias("q"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).first()
    if found["a"] is None:
        return F.lit(0).cast("long")
    ends = sorted({found["a"], *found["q"], found["z"] + 1})
    below = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in ends[1:-1]]), lambda x: x <= F.col("doc_id")))
    low = F.get(F.array(*[F.lit(x).cast("long") for x in ends[:-1]]), below)
    width = F.get(F.array(*[F.lit(float(z - a)) for a, z in zip(ends, ends[1:], strict=False)]), below)
    # Differences are taken between whole numbers, as large ids that are close share a double; one that overflows is far.
    inside = F.coalesce(F.floor(F.try_subtract("doc_id", low).cast("double") * fine / width), F.lit(fine - 1))
    own = below * F.lit(fine).cast("long") + F.greatest(F.lit(0), F.least(inside, F.lit(fine - 1)))
    return F.when(F.col("doc_id").isNull(), F.lit(0).cast("long")).otherwise(own)


def with_next(docs: DataFrame, columns: list[str], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """made(docs) (docs: doc_id, text, tie, stretch) with next_<column>, of the row that follows by doc_id and tie.

    The first follows the last. Within a stretch the next row is a window's lead. The last row of each stretch is
    followed by the first of the next one that has rows; those rows are few, and are looked up and joined apart.
    """
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    window = Window.partitionBy("stretch").orderBy(*order)
    # What made adds is computed behind the shuffle and the sort, so that neither carries it.
    inside = made(docs.repartition("stretch").sortWithinPartitions("stretch", *order)).withColumns({f"next_{c}": F.lead(c).over(window) for c in columns}).where(F.col(f"next_{columns[0]}").isNotNull())
    ends = hold(docs.groupBy("stretch").agg(F.min(F.struct("doc_id", "tie")).alias("first"), F.max(F.struct("doc_id", "tie")).alias("last")))
    n = ends.count()
    along = Window.orderBy("stretch")
    chain = ends.withColumn("after", F.coalesce(F.lead("first").over(along), F.first("first").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    chain = hold(chain.select(F.col("stretch").alias("s"), "last", "after"))

    def rows_at(which: str, prefix: str, wanted: list[str]) -> DataFrame:
        keys = chain.select("s", F.col(f"{which}.doc_id").alias("k"), F.col(f"{which}.tie").alias("t"))
        keys = F.broadcast(keys) if n <= BROADCAST_ENDS else keys
        on = F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t"))
        found = docs.join(keys, on).dropDuplicates(["s"])  # rows that are equal in all that counts
        return made(found).select("s", *[F.col(c).alias(prefix + c) for c in wanted])

    across = rows_at("last", "", [c for c in inside.columns if not c.startswith("next_")]).join(rows_at("after", "next_", columns), "s").drop("s")
    return inside.unionByName(across)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text; more columns are ignored): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter of code points, rounded down, replaced by as many from the start
    of the next document's text, or all of it. Rows follow each other by doc_id, rows without one first, rows with one
    doc_id in the order of a hash of the text; the first follows the last, so that a single row follows itself. Null
    texts count as empty. Equal texts have equal fingerprints. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.count()
    stretch = stretch_of(docs, rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("stretch", stretch)
    followed = with_next(texts, ["text", "anchors"], lambda df: df.withColumn("anchors", syncmers(F.col("text").cast("binary"))))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    parted = followed.withColumns({"head": F.substr("text", F.lit(1), n - quarter), "tail": F.substr("next_text", F.lit(1), quarter)})
    seam = joined_syncmers(F.col("head").cast("binary"), F.col("anchors"), F.col("tail").cast("binary"), F.col("next_anchors"))
    edited = parted.withColumns({"edited": F.concat("head", "tail"), "edited_anchors": seam})
    done = with_sketch(edited, "text", "anchors", "sketch")
    done = with_sketch(with_sketch(done, "edited", "edited_anchors", "edited_sketch"), "next_text", "next_anchors", "next_sketch")
    a, b, c = [(F.col(t), F.col(f"{x}sketch")) for t, x in (("text", ""), ("edited", "edited_"), ("next_text", "next_"))]
    return done.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(*a).alias("fingerprint"),
        fingerprint(*b).alias("edited_fingerprint"),
        likeness(*a, *b).alias("near_edited"),
        likeness(*a, *c).alias("near_next"),
    )


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op9_syncmer_fingerprints": op9_syncmer_fingerprints}
ORACLES: dict[str, str] = {}
