"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

A key descends from the root to one shard by hash draws alone.

Region. Each region draws arrivals for the key: the waiting times between them are exponential with the region's weight
as rate, from hashes of key, region and arrival number. Rack and shard. Each arrival goes on to one of the region's rack
slots and one of the rack's shard slots, by further draws from the same hash, and is taken if the draw within a slot is
below the weight of what stands there; an empty slot takes nothing. The key belongs to the shard that takes the first
arrival of all. So a shard gets keys in proportion to the product of the weights on its path, and only nodes that
arrivals pass are ever looked at: a region is left as soon as its next arrival is later than one already taken.

Arrivals do not depend on any other node, which confines movement to subtrees whose weights change: raise the weight of
a shard or rack, or fill an empty slot, and keys move there and nowhere else; lower it, and keys leave it alone; change
a region's weight, or add a region, and keys only enter or leave that region, keeping their place within it. The slots
of racks and shards are fixed for the life of a tree; regions can be added without end.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, ranked, table

#: A digest is four draws of 32 bits.
DRAW = 1 << 32


@dataclass(frozen=True)
class Shard:
    """A leaf in one slot of a rack; `shard` is the number that rows get. weight: 0 to 1, the share of its slot's arrivals it takes."""

    region: int
    rack: int
    slot: int
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """Shards, and the weights of racks (0 to 1) and regions (above 0) that are not 1."""

    shards: tuple[Shard, ...]
    rack_slots: int = 2
    shard_slots: int = 2
    racks: dict[tuple[int, int], float] = field(default_factory=dict)
    regions: dict[int, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        leaves = self.shards
        if len({x.shard for x in leaves}) < len(leaves) or len({(x.region, x.rack, x.slot) for x in leaves}) < len(leaves):
            raise ValueError("each shard needs a number and a slot of its own")
        if any(not (0 <= x.rack < self.rack_slots and 0 <= x.slot < self.shard_slots) for x in leaves):
            raise ValueError("a rack or shard stands outside the tree's slots")
        if any(not 0 <= w <= 1 for w in [x.weight for x in leaves] + [*self.racks.values()]) or any(w <= 0 for w in self.regions.values()):
            raise ValueError("weights of shards and racks lie between 0 and 1, those of regions above 0")
        if not self.live():
            raise ValueError("a tree needs a shard with weight")

    def live(self) -> dict[int, dict[int, tuple[float, dict[int, tuple[float, int]]]]]:
        """region -> rack -> (weight, slot -> (weight, shard)), without what has no weight."""
        out: dict = {}
        for x in sorted(self.shards, key=lambda x: (x.region, x.rack, x.slot)):
            rack = self.racks.get((x.region, x.rack), 1.0)
            if x.weight > 0 and rack > 0:
                out.setdefault(x.region, {}).setdefault(x.rack, (rack, {}))[1][x.slot] = (x.weight, x.shard)
        return out


def even_tree(shards: int, per_rack: int = 2, per_region: int = 4) -> Tree:
    """Shards 0 to shards - 1 with equal weights, filled region by region. Trees of n and n + 1 shards differ in one leaf."""
    leaves = [Shard(s // per_region, s % per_region // per_rack, s % per_rack, s) for s in range(shards)]
    return Tree(tuple(leaves), per_region // per_rack, per_rack)


def draws(key: str, region: int, arrival: int) -> tuple[float, float, float]:
    """Waiting time (rate 1), rack draw and shard draw (0 to 1) of an arrival."""
    digest = hashlib.md5(f"{key}:{region}:{arrival}".encode()).digest()
    a, b, c = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8))
    return -math.log((a + 0.5) / DRAW), b / DRAW, c / DRAW


class Descent:
    """The shard of a key."""

    def __init__(self, tree: Tree):
        self.live, self.rack_slots, self.shard_slots = tree.live(), tree.rack_slots, tree.shard_slots
        self.rates = {region: tree.regions.get(region, 1.0) for region in self.live}

    def shard(self, key: str) -> int:
        best, answer = math.inf, -1
        for region, racks in self.live.items():
            time, arrival, rate = 0.0, 0, self.rates[region]
            while True:
                wait, rack_draw, shard_draw = draws(key, region, arrival)
                time, arrival = time + wait / rate, arrival + 1
                if time >= best:
                    break
                rack, within = divmod(rack_draw * self.rack_slots, 1)
                weight, slots = racks.get(int(rack), (0.0, None))
                if within >= weight:
                    continue
                slot, within = divmod(shard_draw * self.shard_slots, 1)
                weight, shard = slots.get(int(slot), (0.0, -1))
                if within < weight:
                    best, answer = time, shard
                    break
        return answer


def shard_of(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """df with the shard number of the key. A null key counts as the string 'null'."""
    descent = Descent(tree)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return keys.map(descent.shard)

    return df.withColumn(name, place(F.coalesce(key.cast("string"), F.lit("null"))))


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree) -> DataFrame:
    """One row per row of docs (doc_id, text; more columns are ignored): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: doc_id and the tree decide, so rows with one doc_id share a shard, also repeated ones, and a tree
    with one more shard takes rows into that shard alone. size is the text's UTF-8 bytes plus 1, a null text having none
    (and the checksum of no bytes). Slots number each shard's rows without gaps. An empty table gives an empty result.
    Only doc_id, size and checksum are shuffled, in blocks, so neither a hot text nor a hot source gathers anywhere.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    placed = hold(shard_of(shard_of(sized, F.col("doc_id"), tree, "shard"), F.col("doc_id"), grown, "grown_shard"))
    out = ranked(placed, ["shard"], ["doc_id", "size", "text_crc32"], placed.count(), name="slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), even_tree(8), even_tree(9))


def _oracle() -> str:
    """The same in SQL: arrivals are drawn by recursion until one is taken; the checksum goes byte by byte."""

    def descent(name: str, tree: Tree) -> str:
        leaves = ", ".join(f"({x.region}, {x.rack}, {x.slot}, {x.shard}, {tree.racks.get((x.region, x.rack), 1.0)}::DOUBLE, {x.weight}::DOUBLE, {tree.regions.get(x.region, 1.0)}::DOUBLE)" for x in tree.shards)
        number = lambda at: f"('0x' || substr(md5(key || ':' || region || ':' || arrival), {at}, 8))::BIGINT"
        return f"""
{name}_leaves(region, rack, slot, shard, rack_weight, weight, rate) AS (VALUES {leaves}),
{name}_regions AS (SELECT DISTINCT region, rate FROM {name}_leaves),
{name}_drawn AS (SELECT key, region, rate, arrival, time - ln(({number(1)} + 0.5) / {DRAW}.0) / rate AS time, {number(9)} / {DRAW}.0 * {tree.rack_slots} AS r, {number(17)} / {DRAW}.0 * {tree.shard_slots} AS s FROM (SELECT key, region, rate, 0 AS arrival, 0.0::DOUBLE AS time FROM (SELECT DISTINCT key FROM d), {name}_regions)),
{name}(key, region, rate, arrival, time, shard) AS (
SELECT x.key, x.region, x.rate, x.arrival, x.time, l.shard FROM {name}_drawn x LEFT JOIN {name}_leaves l ON l.region = x.region AND l.rack = floor(r) AND r - floor(r) < l.rack_weight AND l.slot = floor(s) AND s - floor(s) < l.weight
UNION ALL
SELECT x.key, x.region, x.rate, x.arrival, x.time, l.shard FROM (SELECT key, region, rate, arrival, time - ln(({number(1)} + 0.5) / {DRAW}.0) / rate AS time, {number(9)} / {DRAW}.0 * {tree.rack_slots} AS r, {number(17)} / {DRAW}.0 * {tree.shard_slots} AS s FROM (SELECT key, region, rate, arrival + 1 AS arrival, time FROM {name} WHERE shard IS NULL)) x
LEFT JOIN {name}_leaves l ON l.region = x.region AND l.rack = floor(r) AND r - floor(r) < l.rack_weight AND l.slot = floor(s) AND s - floor(s) < l.weight),
{name}_of AS (SELECT key, arg_min(shard, time) AS shard FROM {name} WHERE shard IS NOT NULL GROUP BY key)"""

    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE bytes(b, c, i) AS (SELECT b, b::BIGINT, 0 FROM range(256) t(b) UNION ALL SELECT b, {step}, i + 1 FROM bytes WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bytes WHERE i = 8),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, encode(coalesce(text, '')) AS raw FROM documents),
{descent("own", even_tree(8))},{descent("grown", even_tree(9))},
z AS (SELECT doc_id, key, (octet_length(raw) + 1)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(raw)), lambda i: ('0x' || substr(hex(raw), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)::BIGINT AS text_crc32 FROM d, crc),
n AS (SELECT z.doc_id, size, text_crc32, own_of.shard, grown_of.shard AS grown_shard, ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), size, text_crc32)), 1, 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / 50000.0))::BIGINT FROM documents) AS block
 FROM z JOIN own_of USING (key) JOIN grown_of USING (key))
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard FROM n
"""


QUERIES = {"op2_shard_documents": op2_shard_documents}
ORACLES = {"op2_shard_documents": _oracle()}
