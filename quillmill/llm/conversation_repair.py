"""Repair of the structure of conversations: the cheapest edits that leave (system)? (user assistant)+, or nothing.

Each turn has at most one fault: blank, duplicate of an earlier turn, or truncated. Edits are K (keep), R (another role),
D (delete) and I (insert an empty turn); blank and duplicate turns have to be deleted. The cheapest sequence is found by
a forward Viterbi pass over the four states of the grammar (nothing yet, after system, after user, after assistant),
which carries for each state the least (cost, audit), the audit being the letters of the edits. Before each turn's edit
at most two inserts lead from one state to another: more come back to a state at a cost.

A long conversation is not walked by one task. Turns are range-partitioned by conversation and place; each partition's
part of a conversation is a segment, whose costs from every state to every state are found by itself, and segments are
chained by their costs. An audit is not carried as a string: a state has its rank among the audits, and the step back at
each turn, which say the same. Audits of one length in turns differ before either ends, as the letters decide
the states, so that what sorts first stays first whatever follows.

A partition has at most two conversations that go beyond it, so that what each has to be told about its neighbours is a
table of that size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hold, pieces_for, table
from .spelling_variants import CRC_TABLES, crc_sql

#: Costs of edits, and of keeping a truncated turn.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
OK, CUT_OFF, BLANK, REPEATED = 0, 1, 2, 3
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role's initial leads to from a state, and the one that an insert leads to.
NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Adjacent roles, by initials, that the grammar allows somewhere.
LEGAL = ("su", "ua", "au")
#: Bytes of a segment of turns, about.
SEGMENT_BYTES = 16 << 20
_FAR = 1 << 60


def _moves() -> dict[tuple[str, bool, bool], list[tuple[int, str, int, int]]]:
    """(initial, may be kept, truncated) -> (from, letters, to, cost) of all steps over a turn: up to two inserts, then
    its edit; of those from one state to another the least (cost, letters)."""
    out = {}
    for initial in ("s", "u", "a", ""):
        for sound, cut_off in ((True, False), (True, True), (False, False)):
            found = []
            for origin in range(4):
                state = origin
                for inserts in range(3):
                    cost, letters = inserts * INSERT, "I" * inserts
                    found.append((origin, letters + "D", state, cost + DELETE))
                    if sound:
                        kept = NEXT.get((initial, state))
                        more = TRUNCATED * cut_off
                        if kept is not None:
                            found.append((origin, letters + "K", kept, cost + more))
                        found.append((origin, letters + "R", INSERTED[state], cost + REROLE + more))
                    state = INSERTED[state]
            least: dict[tuple[int, int], tuple[int, str]] = {}
            for origin, letters, state, cost in found:
                least[origin, state] = min(least.get((origin, state), (cost, letters)), (cost, letters))
            out[initial, sound, cut_off] = [(origin, letters, state, cost) for (origin, state), (cost, letters) in least.items()]
    return out


MOVES = _moves()


def moves(initial: str, fault: int) -> list[tuple[int, str, int, int]]:
    return MOVES[initial if initial in ("s", "u", "a") else "", fault < BLANK, fault == CUT_OFF]


@lru_cache(maxsize=1 << 14)
def layer(costs: tuple[int, ...], ranks: tuple[int, ...], initial: str, fault: int) -> tuple:
    """(costs, ranks, steps) after a turn; steps has for each state the one it comes from and the letters."""
    best: list = [None] * 4
    for origin, letters, state, cost in moves(initial, fault):
        if costs[origin] < _FAR:
            key = (costs[origin] + cost, ranks[origin], letters)
            if best[state] is None or key < best[state][0]:
                best[state] = (key, origin)
    # What a conversation can do that has nothing yet, or a system turn, one that ends in an assistant turn can do for
    # one deletion more. So these two states are given up beyond that, and costs stay close together.
    if best[ASSISTANT]:
        for state in (START, SYSTEM):
            if best[state] and best[state][0][0] > best[ASSISTANT][0][0] + DELETE:
                best[state] = None
    order = sorted((b[0][1:], s) for s, b in enumerate(best) if b)
    places = [0] * 4
    for place, (_, state) in enumerate(order):
        places[state] = place
    return tuple(b[0][0] if b else _FAR for b in best), tuple(places), tuple(b and (b[1], b[0][2]) for b in best)


class Walk:
    """The least (cost, audit) from one state over a segment's turns to each state.

    Costs are kept as what they are above the least of them, so that few different layers occur and are remembered.
    """

    def __init__(self, origin: int, steps: bool = False):
        self.base, self.ranks = 0, (0, 0, 0, 0)
        self.above = tuple(0 if s == origin else _FAR for s in range(4))
        self.steps: list[tuple] | None = [] if steps else None

    def turn(self, initial: str, fault: int) -> None:
        costs, self.ranks, steps = layer(self.above, self.ranks, initial, fault)
        least = min(costs)
        self.base += least
        self.above = tuple(c - least if c < _FAR else _FAR for c in costs)
        if self.steps is not None:
            self.steps.append(steps)

    @property
    def costs(self) -> list[int]:
        return [c + self.base if c < _FAR else _FAR for c in self.above]

    def edits(self, state: int) -> list[str]:
        """The letters of each turn, inserts before it included, of the audit that ends in this state."""
        out = []
        for steps in reversed(self.steps):
            state, letters = steps[state]
            out.append(letters)
        return out[::-1]


def ending(costs: list[int], ranks: list[int]) -> tuple[int, int, int]:
    """(state, inserts after the last turn, cost) of the least (cost, audit) that leaves a whole conversation or none."""
    found = []
    for state in range(4):
        at = state
        for inserts in range(3):
            if at in (START, ASSISTANT) and costs[state] < _FAR:
                found.append((costs[state] + inserts * INSERT, ranks[state], inserts, state))
            at = INSERTED[at]
    cost, _, inserts, state = min(found)
    return state, inserts, cost


def chained(segments: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], int]:
    """(cost, (state before, state after) of each segment, inserts at the end) of the segments' (costs, ranks), each by
    16 pairs of states; ranks order the audits that leave one state."""
    costs, ranks, back = [0, _FAR, _FAR, _FAR], [0] * 4, []
    for own, order in segments:
        best: list = [None] * 4
        for origin in range(4):
            for state in range(4):
                if costs[origin] < _FAR and own[4 * origin + state] < _FAR:
                    key = (costs[origin] + own[4 * origin + state], ranks[origin], order[4 * origin + state])
                    if best[state] is None or key < best[state][0]:
                        best[state] = (key, origin)
        places = sorted((b[0][1:], s) for s, b in enumerate(best) if b)
        costs, ranks = [b[0][0] if b else _FAR for b in best], [0] * 4
        for rank, (_, state) in enumerate(places):
            ranks[state] = rank
        back.append([b and b[1] for b in best])
    state, inserts, cost = ending(costs, ranks)
    ways = []
    for layer in reversed(back):
        ways.append((layer[state], state))
        state = layer[state]
    return cost, ways[::-1], inserts


def flagged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, fault, segment: different turns and how often each is there, in order within
    each segment: by conv_id, turn (nulls first), role and text. Null roles and texts count as one space.

    Equal turns are one row from the start, however many there are. A turn is a duplicate if its role and text were there
    at an earlier one; to find the first, digests alone are shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("seen", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    firsts = rows.groupBy("conv_id", "seen").agg(first.alias("first"), F.count(F.lit(1)).alias("places")).where(F.col("places") > 1)
    told = firsts.select(F.col("conv_id").alias("f_conv"), F.col("seen").alias("f_seen"), F.col("first.turn").alias("f_turn"))
    found = rows.join(told, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("seen") == F.col("f_seen")), "left")
    later = F.col("f_seen").isNotNull() & ~F.col("turn").eqNullSafe(F.col("f_turn"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(later, REPEATED).when(~whole, CUT_OFF).otherwise(OK)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    placed = found.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))
    size = turns.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 100), F.lit(0))).first()[0]
    parts = pieces_for(size, SEGMENT_BYTES, 1 << 16)
    return hold(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("segment", F.spark_partition_id()))


def copies_of(fault: int, copies: int) -> Iterator[int]:
    """The faults of a turn and of its copies."""
    yield fault
    for _ in range(copies - 1):
        yield BLANK if fault == BLANK else REPEATED


class Part:
    """One conversation's turns in one segment, as they come."""

    def __init__(self, conv: int | None, segment: int):
        self.conv, self.segment = conv, segment
        self.walks = [Walk(s) for s in range(4)]
        self.counts = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.low = self.high = None
        self.first = self.last = None

    def add(self, turn: int | None, role: str, copies: int, fault: int) -> None:
        initial = role[:1]
        if self.last is None:
            self.first, self.first_turn = initial, turn
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += copies - 1
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last, self.last_turn = initial, turn
        for f in copies_of(fault, copies):
            self.counts[f] += 1
            for walk in self.walks:
                walk.turn(initial, f)

    def row(self) -> tuple:
        return (self.conv, self.segment, *self.counts[1:], self.illegal, self.turns, self.low, self.high, self.first_turn, self.last_turn, self.first, self.last, [c for w in self.walks for c in w.costs], [r for w in self.walks for r in w.ranks])


_PART = "segment int, cut_off long, blank long, repeated long, illegal long, turns long, low long, high long, first_turn long, last_turn long, first string, last string, costs array<long>, ranks array<int>"
_INT = pa.int64()


def _by_conversation(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def parts_of(rows: DataFrame) -> DataFrame:
    """A row for each conversation and segment, with all that its neighbours need to know."""
    schema = _with_conv(rows, _PART)
    arrow = pa.schema([("conv_id", _arrow(rows.schema["conv_id"].dataType)), ("segment", pa.int32()), *[(c, _INT) for c in schema.names[2:11]], ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(_INT)), ("ranks", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = None, []

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
            done.clear()
            return out

        for conv, segment, turn, role, copies, fault in _by_conversation(batches, ["conv_id", "segment", "turn", "role", "copies", "fault"]):
            if part is None or part.conv != conv:
                if part:
                    done.append(part.row())
                part = Part(conv, segment)
            part.add(turn, role, copies, fault)
            if len(done) >= 4096:
                yield given()
        if part:
            done.append(part.row())
            yield given()

    return rows.select("conv_id", "segment", "turn", "role", "copies", "fault").mapInArrow(run, schema)


def _with_conv(df: DataFrame, ddl: str) -> T.StructType:
    return T.StructType([df.schema["conv_id"], *T.StructType.fromDDL(ddl).fields])


def _arrow(kind: T.DataType) -> pa.DataType:
    return pa.from_numpy_dtype({"long": "int64", "integer": "int32", "short": "int16", "byte": "int8"}[kind.typeName()]) if kind.typeName() != "string" else pa.string()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def chains(parts: DataFrame) -> DataFrame:
    """conv_id, report, ways (segment, before, after, inserts), beyond (whether it is in several segments) of each conversation.

    A conversation has at most as many rows here as there are segments, and one as a rule.
    """
    own = [c for c in parts.columns if c != "conv_id"]

    @F.pandas_udf(f"report struct<{REPORT.replace(' long', ': long')}>, ways array<struct<segment:int,before:int,after:int,inserts:int>>")
    def chain(all_parts: pd.Series) -> pd.DataFrame:
        reports, ways = [], []
        for ps in all_parts:
            ps = [p if isinstance(p, dict) else p.asDict() for p in ps]
            cost, found, inserts = chained([([*p["costs"]], [*p["ranks"]]) for p in ps])
            pairs = list(zip(ps, ps[1:], strict=False))
            lows, highs = ([int(p[k]) for p in ps if p[k] is not None] for k in ("low", "high"))
            turns = sum(int(p["turns"]) for p in ps) - sum(a["high"] is not None and a["high"] == b["low"] for a, b in pairs)
            reports.append({
                "gaps": min(max(highs) - min(lows) + 1 - turns, (1 << 63) - 1) if lows else 0,
                "blank": sum(p["blank"] for p in ps), "duplicate": sum(p["repeated"] for p in ps), "truncated": sum(p["cut_off"] for p in ps),
                "illegal": sum(p["illegal"] for p in ps) + sum(a["last"] + b["first"] not in LEGAL for a, b in pairs), "cost": cost,
            })
            ways.append([{"segment": p["segment"], "before": a, "after": b, "inserts": inserts * (i == len(ps) - 1)} for i, (p, (a, b)) in enumerate(zip(ps, found, strict=True))])
        return pd.DataFrame({"report": reports, "ways": ways})

    gathered = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("parts"))
    return gathered.select("conv_id", chain("parts").alias("c"), (F.size("parts") > 1).alias("beyond")).select("conv_id", "c.report", "c.ways", "beyond")


def replayed(rows: DataFrame, told: DataFrame) -> DataFrame:
    """conv_id, segment, place, edit, role, text, beyond: every edit in order, with the turn that it leaves; role and text
    are null for D. told: the ways of conversations in several segments, two for each segment at most.

    A part of a conversation is kept until its last turn is known: a segment's bytes at most.
    """
    ways = told.select(F.col("conv_id").alias("t_conv"), F.explode("ways").alias("w")).select("t_conv", F.col("w.segment").alias("t_segment"), F.col("w.before").alias("before"), F.col("w.after").alias("after"), F.col("w.inserts").alias("inserts"))
    both = rows.join(F.broadcast(ways), (F.col("segment") == F.col("t_segment")) & F.col("conv_id").eqNullSafe(F.col("t_conv")), "left")
    columns = ["conv_id", "segment", "before", "after", "inserts", "role", "text", "copies", "fault"]
    schema = _with_conv(rows, "segment int, place long, edit string, role string, text string, beyond boolean")
    arrow = pa.schema([("conv_id", _arrow(rows.schema["conv_id"].dataType)), ("segment", pa.int32()), ("place", _INT), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("beyond", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, turns, out = None, [], []

        def edited() -> Iterator[tuple]:
            conv, segment, before, after, inserts = head
            walk = Walk(before or START, steps=True)
            for role, _, copies, fault in turns:
                for f in copies_of(fault, copies):
                    walk.turn(role[:1], f)
            beyond = after is not None
            if not beyond:
                after, inserts, _ = ending(walk.costs, walk.ranks)
            letters, state, place = iter(walk.edits(after)), before or START, 0
            for role, text, copies, _ in turns:
                for _ in range(copies):
                    for edit in next(letters):
                        if edit == "D":
                            yield conv, segment, place, edit, None, None, beyond
                        elif edit == "K":
                            state = NEXT[role[:1], state]
                            yield conv, segment, place, edit, role, text, beyond
                        else:
                            state = INSERTED[state]
                            yield conv, segment, place, edit, ROLE[state], text if edit == "R" else "", beyond
                        place += 1
            for _ in range(inserts):
                state = INSERTED[state]
                yield conv, segment, place, "I", ROLE[state], "", beyond
                place += 1

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
            out.clear()
            return batch

        def flushed() -> Iterator[pa.RecordBatch]:
            size = 0
            for row in edited():
                out.append(row)
                size += len(row[5] or "")
                if size > 1 << 20 or len(out) >= 4096:
                    size = 0
                    yield given()

        for *own, role, text, copies, fault in _by_conversation(batches, columns):
            if own != head:
                if head is not None:
                    yield from flushed()
                head, turns = own, []
            turns.append((role, text, copies, fault))
        if head is not None:
            yield from flushed()
        if out:
            yield given()

    return both.select(*columns).mapInArrow(run, schema)


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, edits) of turns (conv_id, turn, role, text; more columns are ignored).

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost. edits: conv_id, segment, place, edit (K, R, D or
    I), role and text of the turn that it leaves (null for D), beyond; in order by segment and place. Rows without
    conv_id are one conversation; null turns come first; turns of one number stand in the order of role and text; null
    roles and texts are one space, and so blank; a role counts by its first letter. Empty tables give empty results.
    """
    rows = flagged(turns)
    found = hold(chains(parts_of(rows)))
    return found.select("conv_id", "report.*"), replayed(rows, found.where("beyond"))


def written(edits: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of edits: their letters, and the digest of role:text of the turns that are left,
    joined by line ends.

    Read in order: a conversation within one segment where it lies, one beyond it in the task that its parts are sent to,
    as a digest takes its bytes one after the other. A task keeps a batch and the letters of one conversation.
    """
    schema = _with_conv(edits, "audit string, repaired_sha256 string")
    arrow = pa.schema([("conv_id", _arrow(edits.schema["conv_id"].dataType)), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, letters, digest, empty, done = False, None, [], None, True, []

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
            done.clear()
            return batch

        for own, edit, role, text in _by_conversation(batches, ["conv_id", "edit", "role", "text"]):
            if not begun or own != conv:
                if begun:
                    done.append((conv, "".join(letters), digest.hexdigest()))
                begun, conv, letters, digest, empty = True, own, [], hashlib.sha256(), True
            letters.append(edit)
            if edit != "D":
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
            if len(done) >= 4096:
                yield given()
        if begun:
            done.append((conv, "".join(letters), digest.hexdigest()))
            yield given()

    columns = ["conv_id", "edit", "role", "text"]
    near = edits.where(~F.col("beyond")).select(*columns).mapInArrow(run, schema)
    far = edits.where("beyond").repartition("conv_id").sortWithinPartitions("conv_id", "segment", "place").select(*columns).mapInArrow(run, schema)
    return near.unionByName(far)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that the checksum of conv_id:turn plants. Nulls are one space, in the
    checksum's text as well."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, edits = repair_conversations(damaged(conversations))
    both = report.withColumnRenamed("conv_id", "r_conv").join(written(edits), F.col("r_conv").eqNullSafe(F.col("conv_id"))).drop("conv_id")
    every = conversations.select("conv_id").distinct().join(both, F.col("conv_id").eqNullSafe(F.col("r_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _oracle() -> str:
    """All conversations a turn at a time, by recursion that keeps the least (cost, audit) of each state."""
    return f"""
WITH RECURSIVE {CRC_TABLES},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT conv_id, turn, role, text, {crc_sql("key")} % 20 AS kind FROM k, crc),
d AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM h WHERE kind <> 0)),
o AS (SELECT c, conv_id, turn, role, text, left(role, 1) AS a, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS b FROM d WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 3 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 1 ELSE 0 END AS fault FROM o),
r AS (SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 2) AS blank, count(*) FILTER (WHERE fault = 3) AS duplicate, count(*) FILTER (WHERE fault = 1) AS truncated, count(*) FILTER (WHERE i > 1 AND b || a NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY c),
g(o, k, s, lines) AS (VALUES (0, '', 0, []), (1, '', 1, []), (2, '', 2, []), (3, '', 3, []), (0, 'I', 2, ['user:']), (1, 'I', 2, ['user:']), (3, 'I', 2, ['user:']), (2, 'I', 3, ['assistant:']), (0, 'II', 3, ['user:', 'assistant:']), (1, 'II', 3, ['user:', 'assistant:']), (3, 'II', 3, ['user:', 'assistant:']), (2, 'II', 2, ['assistant:', 'user:'])),
t(o, a, s) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
v(o, s, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')),
s(c, i, s, cost, audit, lines) AS (
SELECT c, 0::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM r
UNION ALL
SELECT c, i, s, cost, audit, lines FROM (
SELECT s.c, f.i, g.s, s.cost + 3 * length(g.k) + 4 AS cost, s.audit || g.k || 'D' AS audit, s.lines || g.lines AS lines FROM s JOIN f ON f.c = s.c AND f.i = s.i + 1 JOIN g ON g.o = s.s
UNION ALL
SELECT s.c, f.i, t.s, s.cost + 3 * length(g.k) + 3 * f.fault, s.audit || g.k || 'K', s.lines || g.lines || [f.role || ':' || f.text] FROM s JOIN f ON f.c = s.c AND f.i = s.i + 1 JOIN g ON g.o = s.s JOIN t ON t.o = g.s AND t.a = f.a WHERE f.fault < 2
UNION ALL
SELECT s.c, f.i, v.s, s.cost + 3 * length(g.k) + 3 + 3 * f.fault, s.audit || g.k || 'R', s.lines || g.lines || [v.role || ':' || f.text] FROM s JOIN f ON f.c = s.c AND f.i = s.i + 1 JOIN g ON g.o = s.s JOIN v ON v.o = g.s WHERE f.fault < 2)
QUALIFY row_number() OVER (PARTITION BY c, s ORDER BY cost, audit) = 1),
e AS (SELECT s.c, s.cost + 3 * length(g.k) AS cost, s.audit || g.k AS audit, array_to_string(s.lines || g.lines, chr(10)) AS repaired FROM s JOIN r ON r.c = s.c AND s.i = r.n JOIN g ON g.o = s.s WHERE g.s IN (0, 3) QUALIFY row_number() OVER (PARTITION BY s.c ORDER BY s.cost + 3 * length(g.k), s.audit || g.k) = 1)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN r ON q.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN e USING (c)
"""


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES = {"op11_conversation_repair": _oracle()}
