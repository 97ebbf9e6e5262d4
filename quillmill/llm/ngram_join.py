"""Exact similarity join on word shingles: pairs of documents whose shingle sets have a Jaccard likeness of 0.75 or more.

1. Sets. A document's set is that of its 64-bit shingle hashes, sorted. Documents with equal sets are one class, found
   by a 128-bit digest of the set and named by its smallest doc_id; from here on only classes count.
2. Survivors. If two sets have the likeness, then of each set's smallest hashes (a quarter of the set, plus a share
   SLACK of it) a number that depends on the sizes alone must be in the other's. So a class can only link if so many of
   those hashes occur in some other text. That is found by counting, without making pairs: hashes are dealt over
   buckets, with their owner's number in its batch beside them, and a hash met twice within a batch is sent on once,
   as a flag, so that no hash gathers its documents. Classes of copies may survive for their copies alone.
3. Blocks. Survivors are dealt into blocks of bounded size, alike sets together: a set's label is the least smallest
   hash of any set that has one of its FIRSTS smallest among its own, so that a family has one label but for chance; a
   large family takes several blocks. The same counting argument says which other blocks can hold a partner of a survivor, and it is sent to those only,
   from one of the two blocks.
4. Search. Within a block, T-occurrence search over inverted lists (DivideSkip): the short lists are merged with a heap
   that skips what can't reach the threshold, the long ones are probed by binary search, and the documents that reach
   the overlap which the two sizes require are links. Each pair that can matter meets once, and counts for both, so
   every link is found, and counted, exactly.
5. Components. Each search reports a spanning star for each component it sees, not its links. Stars are joined by
   alternating large-star and small-star rounds on the cluster.

A pair of hashes that collide by chance would count as a common shingle; at 64 bits that moves no likeness in practice.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, hold, map_texts, pieces_for, settled, table, with_row

WORDS = 5
#: A likeness of at least NUM / DEN.
NUM, DEN = 3, 4
#: Of a set's size, how many common hashes the filters ask for beyond the first.
SLACK = 0.15
#: Hashes in one batch, bucket and block, about.
BATCH, BUCKET, BLOCK = 1 << 20, 1 << 19, 1 << 20
#: Owners of one batch at most, so that their numbers take two bytes.
OWNERS = 1 << 16
#: A worker's memory is a few hundred MB; word hashes take some 150 bytes each of it.
WORDS_KEPT = 200_000
#: Queries of one search, and their hashes, about.
QUERIES_EACH, QUERY_HASHES = 3000, 1 << 20
#: How many of a set's smallest hashes lead to its label.
FIRSTS = 4
#: Bits of the filter that says which texts may be survivors, 4 MB; broadcast for up to FILTERED of them.
FILTER_BITS, FILTERED = 1 << 25, 1 << 22
#: Rows of a list of parts or routes that are broadcast at most, of some 24 bytes each.
BROADCAST_ROWS = 500_000
#: A class with one row in so many, or more, is looked up by broadcast; there are HOT_SHARE of them at most.
HOT_SHARE = 2000
#: DivideSkip's weight of a list's length.
MU = 0.0085
FEW = 32


class _Hashes(dict):
    """Word -> 64-bit hash, remembered for WORDS_KEPT words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = _Hashes()
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; with fewer words than a shingle has, one hash for all of them."""
    # bytes.lower() lowers A-Z only and bytes.split() splits at the six ASCII white-space characters only.
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    span = min(WORDS, len(words))
    n = len(words) - span + 1
    out, shifted = np.full(n, span, np.uint64), np.empty(n, np.uint64)
    for k in range(span):
        out ^= each[k : n + k]
        out *= _P
        out ^= np.right_shift(out, np.uint64(29), out=shifted)
    out *= _Q
    out ^= np.right_shift(out, np.uint64(32), out=shifted)
    out.sort()
    fresh = np.ones(n, bool)
    np.not_equal(out[1:], out[:-1], out=fresh[1:])
    return out if fresh.all() else out[fresh]


def key_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def least_overlap(size):
    """Common hashes that a set of this size needs with any partner."""
    return -(-NUM * size // DEN)


def lead(size):
    """How many of a set's smallest hashes the filters look at."""
    return np.minimum(size, size - least_overlap(size) + np.ceil(SLACK * size).astype(np.int64))


def least_lead(size):
    """How many of those any partner must have among its own."""
    return np.maximum(1, np.ceil(SLACK * least_overlap(size)).astype(np.int64))


def class_table(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), n_shingles, key, firsts (the FIRSTS smallest hashes, eight bytes each): a row per row of docs; key is null for an empty set."""

    def run(texts: list[str | None]):
        sets = [*map(shingle_set, texts)]
        return None, {"n_shingles": [len(s) for s in sets], "key": [key_of(s) if len(s) else None for s in sets], "firsts": [s[:FIRSTS].astype(">u8").tobytes() for s in sets]}

    return map_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("tie")), ["doc_id", "tie"], {"n_shingles": "long", "key": "binary", "firsts": "binary"}, lambda: run)


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def survivors(docs: DataFrame, buckets: int, parts: int) -> DataFrame:
    """short (the first half of a key): the classes that enough of whose leading hashes occur in another text.

    A task's texts go in batches; a batch is named by its task, its number and a digest of its owners, and an owner by
    its number in the batch. Hashes meet by bucket, as four bytes (a clash only costs time) and two for the owner; what
    they say of the owners is summed by batch. A batch that other tasks know and that is no longer there (rows came in
    another order when a lost task ran again) is an error, not a loss.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        needs: dict[int, int] = {}
        total = number = 0
        task = TaskContext.get().partitionId()

        def flush():
            owners = np.fromiter(held, np.int64, len(held))
            hashes = np.concatenate([*held.values()])
            own = np.repeat(np.arange(len(owners)), [len(x) for x in held.values()])
            _, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            twice = counts[at] > 1
            here = np.bincount(own[twice], minlength=len(owners))
            batch = int.from_bytes(xxhash.xxh3_64_digest(owners.tobytes() + b"%d %d" % (task, number)), "big", signed=True)
            # Negative buckets hold the owners of a batch and what it already knows of them.
            known = {"bucket": -1 - batch % parts, "batch": batch, "hashes": owners.tobytes(), "owners": np.fromiter(needs.values(), np.int64, len(needs)).tobytes(), "flags": here.astype(np.int64).tobytes()}
            flags, (lone, own) = np.unique(hashes[twice]), (hashes[~twice], own[~twice])
            order, flag_order = (np.argsort(x % np.uint64(buckets), kind="stable") for x in (lone, flags))
            lone, own, flags = lone[order], own[order].astype(np.uint16), flags[flag_order]
            cuts, flag_cuts = (np.searchsorted(x % np.uint64(buckets), np.arange(buckets + 1, dtype=np.uint64)) for x in (lone, flags))
            lone, flags = _four(lone), _four(flags)
            rows = [
                {"bucket": b, "batch": batch, "hashes": lone[cuts[b] : cuts[b + 1]].tobytes(), "owners": own[cuts[b] : cuts[b + 1]].tobytes(), "flags": flags[flag_cuts[b] : flag_cuts[b + 1]].tobytes()}
                for b in np.flatnonzero(np.diff(cuts) + np.diff(flag_cuts)).tolist()
            ]
            return pa.RecordBatch.from_pylist([known, *rows], schema=kinds)

        for batch in batches:
            for text in batch.column("text"):
                s = shingle_set(text.as_py())
                if not len(s) or (short := _short(key_of(s))) in held:
                    continue
                held[short], needs[short] = s[: int(lead(np.int64(len(s))))], int(least_lead(np.int64(len(s))))
                total += len(held[short])
                if total >= BATCH or len(held) == OWNERS:
                    yield flush()
                    held, needs, total, number = {}, {}, 0, number + 1
        if held:
            yield flush()

    kinds = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *((c, pa.binary()) for c in ("hashes", "owners", "flags"))])

    def meet(part: pa.Table) -> pa.Table:
        if part.column("bucket")[0].as_py() < 0:
            return part.drop_columns("bucket")
        batches = part.column("batch").to_numpy()
        hashes, owners = (np.frombuffer(b"".join(part.column(c).to_pylist()), k) for c, k in (("hashes", np.uint32), ("owners", np.uint16)))
        flags = np.unique(np.frombuffer(b"".join(part.column("flags").to_pylist()), np.uint32))
        row = np.repeat(np.arange(len(part)), [len(x) // 2 for x in part.column("owners").to_pylist()])
        _, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = (counts[at] > 1) | np.isin(hashes, flags)
        # One row a batch and bucket comes in, so that a row stands for its batch.
        found, hits = np.unique(row[shared] << 16 | owners[shared], return_counts=True)
        cuts = np.searchsorted(found >> 16, np.arange(len(part) + 1))
        present = np.flatnonzero(np.diff(cuts)).tolist()
        numbers, hits = (found & 0xFFFF).astype(np.uint16), hits.astype(np.uint32)
        return pa.table({
            "batch": pa.array(batches[present], pa.int64()),
            "hashes": pa.nulls(len(present), pa.binary()),
            "owners": pa.array([numbers[cuts[i] : cuts[i + 1]].tobytes() for i in present], pa.binary()),
            "flags": pa.array([hits[cuts[i] : cuts[i + 1]].tobytes() for i in present], pa.binary()),
        })

    def settle(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        known = next((r for r in rows if r["hashes"] is not None), None)
        if known is None:
            raise RuntimeError("the rows of docs came in another order when a lost task ran again: write docs first, then join what is read")
        names, needs, here = (np.frombuffer(known[c], np.int64) for c in ("hashes", "owners", "flags"))
        hits = here.copy()
        for r in rows:
            if r["hashes"] is None:
                hits[np.frombuffer(r["owners"], np.uint16)] += np.frombuffer(r["flags"], np.uint32)
        return pa.table({"short": pa.array(names[hits >= needs], pa.int64())})

    columns = "batch long, hashes binary, owners binary, flags binary"
    emitted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(emit, "bucket int, " + columns)
    return emitted.groupBy("bucket").applyInArrow(meet, columns).groupBy("batch").applyInArrow(settle, "short long")


def _four(hashes: np.ndarray) -> np.ndarray:
    """Four bytes of each hash that its bucket says little of."""
    return (hashes >> np.uint64(16)).astype(np.uint32)


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """df of that many narrow rows, to be broadcast if they are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _marks(hashed: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of the filter that stand for each hashed id, four each."""
    h = hashed.astype(np.int64).view(np.uint64)
    for shift in (0, 13, 26, 39):
        yield ((h >> np.uint64(shift)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter(ids: DataFrame) -> np.ndarray:
    """The bits of all ids (hashed: long), of a fixed number; they are set on the cluster, bytes of eight at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for at in _marks(batch.column("hashed").to_numpy()):
                bits[at] = True
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        for start in range(0, len(at), 1 << 14):
            own = at[start : start + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(words[own], pa.int64())], names=["at", "word"])

    words = np.zeros(FILTER_BITS // 64, np.int64)
    got = ids.mapInArrow(run, "at long, word long").groupBy("at").agg(F.expr("bit_or(word)").alias("word")).toArrow()
    words[got.column("at").to_numpy()] = got.column("word").to_numpy()
    return words.view(np.uint8)


def labels(classes: DataFrame, total: int) -> DataFrame:
    """l_node, label of that many classes: one round of handing on the least of the smallest hashes."""
    each = F.expr("transform(sequence(0, length(firsts) div 8 - 1), i -> substring(firsts, 8 * i + 1, 8))")
    held = classes.select("node", F.expr("substring(firsts, 1, 8)").alias("first"), F.explode(each).alias("h"))
    least = cut(held.groupBy(F.col("h").alias("l_h")).agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("many")))
    # A hash that a family shares is looked up by broadcast; there are HOT_SHARE * FIRSTS such hashes at most.
    few = max(2, total // HOT_SHARE)
    hot = F.broadcast(least.where(F.col("many") >= few).select(F.col("l_h").alias("h"), F.col("least").alias("hot")))
    met = held.join(hot, "h", "left")
    cold = met.where("hot IS NULL").join(least.where(F.col("many") < few), F.col("h") == F.col("l_h")).select("node", "least")
    found = met.where("hot IS NOT NULL").select("node", F.col("hot").alias("least")).unionByName(cold)
    return found.groupBy(F.col("node").alias("l_node")).agg(F.min("least").alias("label"))


def in_blocks(alive: DataFrame, classes: int, total: int) -> DataFrame:
    """alive (node, n, firsts; that many classes and hashes) with the number of the block that each class lies in instead of firsts."""
    parts = pieces_for(total, BLOCK)
    part = F.pmod(F.xxhash64("label"), F.lit(parts))
    dealt = cut(alive.join(labels(alive, classes), F.col("node") == F.col("l_node")).withColumn("part", part).drop("l_node", "label", "firsts"))
    sizes = dealt.groupBy(F.col("part").alias("p")).agg(F.expr(f"cast(ceil(sum(n) / {BLOCK}) as bigint)").alias("splits"))
    block = F.col("part") * F.lit(1 << 20) + F.pmod(F.xxhash64("node"), F.col("splits"))
    return dealt.join(_bounded(sizes, parts), F.col("part") == F.col("p")).withColumn("block", block).drop("part", "p", "splits")


def class_sets(docs: DataFrame, alive: DataFrame, survivors_known: int) -> DataFrame:
    """node, short, n, copies, block, hashes: the set of each class in alive (key, class_id and all these but hashes), once.

    Sets are made where the texts are and only they are shuffled: a filter of a fixed size, broadcast, says which texts
    may be asked for. Beyond FILTERED classes it would let too many through; then the texts go to the join.
    """
    named = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("hashed"), F.col("text").cast("string").alias("text"))
    bits = None
    if survivors_known <= FILTERED:
        bits = docs.sparkSession.sparkContext.broadcast(_filter(alive.select(F.xxhash64("class_id").alias("hashed"))))
    else:
        named = named.join(alive.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits is not None:
                may = np.ones(batch.num_rows, bool)
                for at in _marks(batch.column("hashed").to_numpy()):
                    may &= (bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                batch = batch.filter(pa.array(may))
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                sets = [shingle_set(t.as_py()) for t in part.column("text")]
                columns = [part.column("doc_id"), pa.array([key_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "hashes"])

    made = named.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("key", T.BinaryType()), T.StructField("hashes", T.BinaryType())]))
    wanted = alive.select(F.col("key").alias("k"), "class_id", "node", "short", "copies", "n", "block")
    found = made.join(wanted, (F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("k")))
    return found.groupBy("class_id", "k").agg(*[F.first(c).alias(c) for c in ("node", "short", "n", "copies", "block", "hashes")]).drop("class_id", "k")


def routes(blocked: DataFrame, buckets: int, parts: int) -> DataFrame:
    """short, to_block: the blocks, beside its own, that can hold a partner of a set and that it is sent to.

    Of two blocks whose sets can be partners, one sends and the other is searched; which is a matter of their numbers'
    parity, so that neither the first blocks nor the last get all of it. Hashes travel as in survivors, with the block.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("hashes")]
            sizes = np.array([len(x) for x in sets], np.int64)
            leads, needs = lead(sizes), least_lead(sizes)
            shorts, blocks = (batch.column(c).to_numpy().astype(np.int64) for c in ("short", "block"))
            ends = np.cumsum(leads)
            start = 0
            while start < len(sets):
                stop = max(start + 1, min(start + OWNERS, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BATCH))))
                own = slice(start, stop)
                hashes = np.concatenate([s[:k] for s, k in zip(sets[own], leads[own].tolist(), strict=True)])
                owners = np.repeat(np.arange(stop - start), leads[own])
                name = int.from_bytes(xxhash.xxh3_64_digest(shorts[own].tobytes() + b"%d %d" % (task, number)), "big", signed=True)
                known = {"bucket": -1 - name % parts, "batch": name, "hashes": shorts[own].tobytes(), "owners": needs[own].tobytes(), "blocks": b""}
                order = np.argsort(hashes % np.uint64(buckets), kind="stable")
                hashes, owners = hashes[order], owners[order]
                cuts = np.searchsorted(hashes % np.uint64(buckets), np.arange(buckets + 1, dtype=np.uint64))
                hashes, at, owners = _four(hashes), blocks[own][owners], owners.astype(np.uint16)
                rows = [{"bucket": b, "batch": name, **{c: x[cuts[b] : cuts[b + 1]].tobytes() for c, x in (("hashes", hashes), ("owners", owners), ("blocks", at))}} for b in np.flatnonzero(np.diff(cuts)).tolist()]
                yield pa.RecordBatch.from_pylist([known, *rows], schema=kinds)
                start, number = stop, number + 1

    kinds = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *((c, pa.binary()) for c in ("hashes", "owners", "blocks"))])

    def meet(part: pa.Table) -> pa.Table:
        if part.column("bucket")[0].as_py() < 0:
            return part.drop_columns("bucket").append_column("common", pa.nulls(len(part), pa.binary()))
        batches = part.column("batch").to_numpy()
        hashes, numbers, blocks = (np.frombuffer(b"".join(part.column(c).to_pylist()), k) for c, k in (("hashes", np.uint32), ("owners", np.uint16), ("blocks", np.int64)))
        own = np.repeat(np.arange(len(part)), [len(x) // 2 for x in part.column("owners").to_pylist()]) << 16 | numbers
        blocks, block = np.unique(blocks, return_inverse=True)
        odd = (blocks >> 20 ^ blocks) & 1 == 1
        values, names = np.unique(hashes, return_inverse=True)
        # The blocks of each hash, once each; hashes of one block lead nowhere.
        pairs = np.unique(names * len(blocks) + block)
        of, to = pairs // max(1, len(blocks)), pairs % max(1, len(blocks))
        first = np.searchsorted(of, np.arange(len(values) + 1))
        many = (np.diff(first) > 1)[names]
        names, own, block = names[many], own[many], block[many]
        cells = counts = np.zeros(0, np.int64)
        start, width = 0, np.diff(first)[names]
        ends = np.cumsum(width)
        while start < len(names):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 22), side="right")))
            w = width[start:stop]
            inside = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            target = to[np.repeat(first[names[start:stop]], w) + inside]
            home = np.repeat(block[start:stop], w)
            foreign = (target != home) & ((target < home) ^ odd[target] ^ odd[home])
            got, n = np.unique(np.repeat(own[start:stop], w)[foreign] * len(blocks) + target[foreign], return_counts=True)
            both, at = np.unique(np.concatenate([cells, got]), return_inverse=True)
            cells, counts = both, np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
            start = stop
        of, to = cells // max(1, len(blocks)), blocks[cells % max(1, len(blocks))]
        cuts = np.searchsorted(of >> 16, np.arange(len(part) + 1))
        present = np.flatnonzero(np.diff(cuts)).tolist()
        columns = {"owners": (of & 0xFFFF).astype(np.uint16), "blocks": to.astype(np.int64), "common": counts.astype(np.uint32)}
        packed = {c: pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in present], pa.binary()) for c, x in columns.items()}
        return pa.table({"batch": pa.array(batches[present], pa.int64()), "hashes": pa.nulls(len(present), pa.binary()), **packed})

    def settle(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        known = next((r for r in rows if r["hashes"] is not None), None)
        if known is None:
            raise RuntimeError("sets came in another order when a lost task ran again")
        names, needs = (np.frombuffer(known[c], np.int64) for c in ("hashes", "owners"))
        found = [r for r in rows if r["hashes"] is None]
        own, to, common = (np.frombuffer(b"".join(r[c] for r in found), k) for c, k in (("owners", np.uint16), ("blocks", np.int64), ("common", np.uint32)))
        order = np.lexsort((to, own))
        own, to, common = own[order], to[order], common[order]
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (to[1:] != to[:-1]))[: len(own)])
        enough = (np.add.reduceat(common.astype(np.int64), first) if len(first) else common) >= needs[own[first]]
        return pa.table({"short": pa.array(names[own[first]][enough], pa.int64()), "to_block": pa.array(to[first][enough], pa.int64())})

    columns = "batch long, hashes binary, owners binary, blocks binary"
    emitted = blocked.select("short", "block", "hashes").mapInArrow(emit, "bucket int, " + columns)
    return emitted.groupBy("bucket").applyInArrow(meet, columns + ", common binary").groupBy("batch").applyInArrow(settle, "short long, to_block long")


class InvertedLists:
    """Sorted lists of the sets that hold each hash; sets are numbered by size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        own = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.hashes, starts = np.unique(every[order], return_index=True)
        self.array = own[order]
        self.postings = self.array.tolist()
        self.bounds = np.append(starts, len(every))

    def lists(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the list of each of the query's hashes that has one, shortest list first."""
        at = np.searchsorted(self.hashes, query)
        at = at[(at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == query)] if len(self.hashes) else at[:0]
        starts, ends = self.bounds[at], self.bounds[at + 1]
        order = np.argsort(ends - starts, kind="stable")
        return starts[order], ends[order]

    def merge_skip(self, starts: list[int], ends: list[int], least: int, after: int) -> tuple[list[int], list[int]]:
        """The sets numbered above `after` in at least `least` of the lists and how many: a heap of list heads; what is
        below the threshold is jumped over by binary search."""
        postings = self.postings
        if after >= 0:
            starts = [bisect_right(postings, after, s, e) for s, e in zip(starts, ends, strict=True)]
        heap = [(postings[s], s, e) for s, e in zip(starts, ends, strict=True) if s < e]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        found, counts = [], []
        while len(heap) >= least:
            at = heap[0][0]
            taken = [pop(heap)]
            while heap and heap[0][0] == at:
                taken.append(pop(heap))
            if len(taken) >= least:
                found.append(at)
                counts.append(len(taken))
                for _, s, e in taken:
                    if s + 1 < e:
                        push(heap, (postings[s + 1], s + 1, e))
                continue
            while heap and len(taken) < least - 1:
                taken.append(pop(heap))
            if not heap:
                break
            to = heap[0][0]
            for _, s, e in taken:
                s = bisect_left(postings, to, s, e)
                if s < e:
                    push(heap, (postings[s], s, e))
        return found, counts

    def search(self, query: np.ndarray, after: int = -1) -> np.ndarray:
        """The numbers above `after` of the sets with the likeness to the query."""
        size = len(query)
        least = least_overlap(size)
        starts, ends = self.lists(query)
        m = len(starts)
        if m < least:
            return np.zeros(0, np.int64)
        longest = int(ends[-1] - starts[-1])
        if longest == 1 and after >= 0:
            return np.zeros(0, np.int64)
        long = min(least - 1, int(least / (MU * np.log2(longest + 1) + 1)))
        cut_at, reach = m - long, least - long
        found, counts = self.merge_skip(starts[:cut_at].tolist(), ends[:cut_at].tolist(), reach, after)
        if not found:
            return np.zeros(0, np.int64)
        ids, n = np.array(found, np.int64), np.array(counts, np.int64)
        sizes = self.sizes[ids]
        near = (DEN * sizes >= NUM * size) & (NUM * sizes <= DEN * size)
        ids, n = ids[near], n[near]
        # c / (a + b - c) >= NUM / DEN, as c >= NUM (a + b) / (NUM + DEN).
        need = -(-NUM * (size + self.sizes[ids]) // (NUM + DEN))
        starts, ends = starts[cut_at:].tolist(), ends[cut_at:].tolist()
        if len(ids) <= FEW:
            postings, out = self.postings, []
            for i, c, want in zip(ids.tolist(), n.tolist(), need.tolist(), strict=True):
                left = long
                for s, e in zip(starts, ends, strict=True):
                    if c >= want or c + left < want:
                        break
                    k = bisect_left(postings, i, s, e)
                    c += k < e and postings[k] == i
                    left -= 1
                if c >= want:
                    out.append(i)
            return np.array(out, np.int64)
        sure = []
        for left, s, e in zip(range(long, 0, -1), starts, ends, strict=True):
            if left % 8 == 0:
                done, may = n >= need, n + left >= need
                if not may.all() or done.any():
                    sure.append(ids[done])
                    go = may & ~done
                    ids, n, need = ids[go], n[go], need[go]
                    if not len(ids):
                        break
            own = self.array[s:e]
            k = np.searchsorted(own, ids)
            n = n + (own[np.minimum(k, e - s - 1)] == ids)
        return np.concatenate([*sure, ids[n >= need]])


def _search_block(part: pa.Table) -> pa.Table:
    """One star per component among the block's sets and the queries sent to it, and the links found at each set."""
    index: dict[bytes, tuple] = {}
    queries: dict[bytes, tuple] = {}
    for role, name, copies, raw in zip(*(part.column(c).to_pylist() for c in ("role", "node", "copies", "hashes")), strict=True):
        hashes = np.frombuffer(raw, np.uint64)
        if role < 2:
            index[name] = (hashes, copies)
        if role > 0:
            queries[name] = (hashes, copies)
    listed = sorted(index, key=lambda k: (len(index[k][0]), k))
    number = {k: i for i, k in enumerate(listed)}
    lists = InvertedLists([index[k][0] for k in listed])
    nodes = listed + [k for k in queries if k not in number]
    place = {k: i for i, k in enumerate(nodes)}
    copies = np.array([index[k][1] if k in index else queries[k][1] for k in nodes], np.int64)
    links = np.zeros(len(nodes), np.int64)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for name, (hashes, own) in queries.items():
        # A set of the block looks at those numbered after it: each pair of them meets once.
        found = lists.search(hashes, number.get(name, -1))
        if len(found):
            at = place[name]
            links[at] += copies[found].sum()
            links[found] += own
            a = root(at)
            for b in found.tolist():
                if parent[b] != a:
                    b = root(b)
                    if a != b:
                        a, b = min(a, b), max(a, b)
                        parent[b] = a
    linked = np.flatnonzero(links).tolist()
    return pa.table({"node": pa.array([nodes[i] for i in linked], pa.binary()), "root": pa.array([nodes[root(i)] for i in linked], pa.binary()), "links": pa.array(links[linked], pa.int64())})


def searched(blocked: DataFrame, routed: DataFrame) -> DataFrame:
    """node, root, links of each search. blocked: node, short, n, copies, hashes, block.

    Sets go to their block once and are listed for its chunks there, so that the chunks of a block, which has a bounded
    size, may share a task.
    """
    own = blocked.select("block", "node", "short", "n", "copies", "hashes")
    routed = cut(routed)
    sent = own.drop("block").join(_bounded(routed, routed.count()), "short").withColumnRenamed("to_block", "block")
    loads = own.select("block", "n").unionByName(sent.select("block", "n")).groupBy("block")
    load = loads.agg(F.expr(f"cast(ceil(greatest(count(1) / {QUERIES_EACH}, sum(n) / {QUERY_HASHES})) as int)").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    # In each chunk of a block all its sets are listed (role 0); those of the chunk are also queries (1); queries from elsewhere are only that (2).
    listed = own.join(load, "block").withColumn("mine", chunk).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("role", F.when(F.col("mine") == F.col("chunk"), 1).otherwise(0))
    asked = sent.join(load, "block").withColumn("chunk", chunk).withColumn("role", F.lit(2))
    columns = ["block", "chunk", "role", "node", "copies", "hashes"]
    return listed.select(*columns).unionByName(asked.select(*columns)).groupBy("block", "chunk").applyInArrow(_search_block, "node binary, root binary, links long")


def components(stars: DataFrame) -> DataFrame:
    """node, root: the least node of each component, by alternating large and small stars. stars: node, root, any edges."""
    edges = cut(stars.where("node <> root").select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        moved = large.join(small, F.col("u") == F.col("x"))
        down = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(down.unionByName(small.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def ngram_join(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text; more columns are ignored): doc_id, n_shingles, component_id, class_id, n_links.

    class_id is the smallest doc_id with an equal set, component_id the smallest reachable by links, n_links the number
    of other rows linked with this one, copies included. Null texts and texts without words have empty sets, link with
    nothing and are their own class and component. A row without doc_id counts for nothing and gets nulls; repeated
    rows are copies of each other; one doc_id with two texts is two documents. An empty table gives an empty result.
    """
    return _joined(docs).drop("tie")


def _joined(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Texts are named by their places in batches, which a task that runs again has to find as they were.
    docs = settled(docs.select("doc_id", "text"))
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    rows = hold(class_table(docs))
    known = rows.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"), F.first("firsts").alias("firsts"))
    # A node is the class's smallest doc_id, as bytes that sort as numbers do, and half of its key, as an id can have two texts.
    number = F.lpad(F.hex(F.col("class_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    classes = hold(classes.withColumns({"node": F.concat(F.unhex(number), F.expr("substring(key, 1, 8)")), "short": F.expr("cast(conv(hex(substring(key, 1, 8)), 16, -10) as bigint)")}))
    total, documents = classes.agg(F.sum("n"), F.sum("copies")).first()
    buckets = max(2 * partitions, pieces_for((total or 0) * (1 - NUM / DEN + SLACK), BUCKET))
    alive = cut(classes.join(survivors(named, buckets, 2 * partitions), "short", "left_semi"))
    total, n_alive = alive.agg(F.sum("n"), F.count(F.lit(1))).first()
    blocked = hold(class_sets(docs, cut(in_blocks(alive, n_alive, total or 0)), n_alive))
    stars = hold(searched(blocked, routes(blocked, max(partitions, pieces_for((total or 0) // 2, BUCKET)), 2 * partitions)))
    links = stars.groupBy("node").agg(F.sum("links").alias("links"))
    linked = classes.join(components(stars), "node", "left").join(links, "node", "left")
    least = F.expr("cast(conv(hex(substring(coalesce(root, node), 1, 8)), 16, -10) as bigint)").bitwiseXOR(F.lit(-(1 << 63)))
    verdicts = linked.select("key", "class_id", least.alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    return _spread(rows, verdicts, documents or 0).select(
        "doc_id", "tie", "n_shingles", *[F.when(F.col("own"), F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("component_id", "class_id")], F.when(F.col("own"), F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links")
    )


def _spread(rows: DataFrame, verdicts: DataFrame, documents: int) -> DataFrame:
    """rows with the verdict of their class and `own`, true for rows with an id and an empty set.

    The few classes that hold a HOT_SHARE of all rows or more are broadcast, so that no class meets in one task; rows
    that no class is looked up for are spread over all tasks.
    """
    named = F.col("doc_id").isNotNull()
    rows = rows.withColumn("own", F.col("key").isNull() & named)
    few = max(2, documents // HOT_SHARE)
    verdicts = hold(verdicts)
    columns = ["class_id", "component_id", "n_links"]
    hot = F.broadcast(verdicts.where(F.col("copies") >= few).select(F.col("key").alias("h"), F.struct(*columns).alias("hot")))
    cold = verdicts.where(F.col("copies") < few).select(F.col("key").alias("c"), F.struct(*columns).alias("cold"))
    met = rows.join(hot, (F.col("key") == F.col("h")) & named, "left")
    # Keys have sixteen bytes, so that these eight meet none.
    at = F.when(F.col("key").isNotNull() & named & F.col("hot").isNull(), F.col("key")).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64("doc_id", "tie", "n_shingles")), 16, "0")))
    found = met.withColumn("at", at).join(cold, F.col("at") == F.col("c"), "left").withColumn("found", F.coalesce("hot", "cold"))
    return found.select("doc_id", "tie", "n_shingles", "own", "found.*")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which no row with a smaller doc_id is in the same component.

    Rows without doc_id stay; of rows with one doc_id and one text one stays.
    """
    from pyspark.sql import Window

    stay = _joined(docs).where("component_id = doc_id").select(F.col("doc_id").alias("s_doc_id"), F.col("tie").alias("s_tie")).distinct()
    rows = with_row(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("tie"), "__row")
    on = (F.col("doc_id") == F.col("s_doc_id")) & (F.col("tie") == F.col("s_tie"))
    first = F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("tie"))
    found = rows.join(stay, on, "left_semi").withColumn("first", first).where("first = 1")
    return found.select("__row.*").unionByName(docs.where("doc_id IS NULL"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS x FROM d),
u AS (SELECT doc_id, len(x) AS n, unnest(x) AS t FROM s),
f AS (SELECT t FROM u GROUP BY t HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM (u SEMI JOIN f USING (t)) a JOIN (u SEMI JOIN f USING (t)) b ON a.t = b.t AND a.doc_id <> b.doc_id AND {DEN} * a.n >= {NUM} * b.n AND {DEN} * b.n >= {NUM} * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(k, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.k AND r.c < p.b),
m AS (SELECT k AS doc_id, min(c) AS component_id FROM r GROUP BY k),
q AS (SELECT x, min(doc_id) AS class_id FROM (SELECT doc_id, list_sort(x) AS x FROM s WHERE len(x) > 0) GROUP BY x),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM p GROUP BY a)
SELECT s.doc_id, len(s.x)::BIGINT AS n_shingles, component_id, coalesce(class_id, s.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM s JOIN m USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN q ON q.x = list_sort(s.x) AND len(s.x) > 0
"""


QUERIES = {"op5_ngram_join": op5_ngram_join}
ORACLES = {"op5_ngram_join": _oracle()}
