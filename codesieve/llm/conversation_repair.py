r"""Repair of the turn structure of conversations, by weighted finite-state composition.

A conversation is an acceptor of its rows. An edit transducer keeps a row, gives it another role, deletes it, or inserts
an empty turn, each at a cost; an acceptor of roles says which sequences are well formed. The three are composed lazily:
a state is (rows read, state of the role acceptor), and arcs are made when they are looked at. The shortest path runs
over these states in reverse topological order, in the semiring of (cost, edits' initials) ordered by cost and then by
ASCII: putting an edit in front keeps the order of what follows, so the least path is found exactly. Strings are not
compared letter by letter: each layer ranks its states, and an edit's initial with the rank of what follows decides.

Conversations are ranges of (conv_id, turn, role, text digest), so one that holds most rows is dealt over many tasks.
Each task cuts its rows into segments of bounded rows and bytes. A conversation that lies whole in one segment is
repaired there. The segments of others give their least (cost, edits) from each role state to each other one; these are
composed once more over the conversation, which fixes the states between segments, and then each segment is repaired by
itself. Rows that repeat are counted before anything is moved. Repaired turns come out as a row for each segment; only
their digest, which is one hash over a whole conversation, reads the segments of one conversation in one task, in order
and one at a time.

Faults: blank (no character but white space), duplicate (role and text stand earlier in the conversation), truncated
(the last character that isn't white space ends no sentence); a row has the first of these that holds.

Defined cases: a null role or text is one blank; rows are taken by turn, nulls first, those of one turn by role and MD5
of the text; rows without conv_id are one conversation, whose id is null; a null turn takes no part in gaps; other
columns are ignored; an empty table gives no rows. A conversation of which every row is gone is empty, which is well
formed and costs nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: Rows and characters of a segment.
SEGMENT, SEGMENT_CHARS = 1000, 1_000_000
DELETE, INSERT, KEEP, REROLE = range(4)
INITIALS = "DIKR"
LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


class Roles(NamedTuple):
    """A deterministic acceptor of role initials. `given` names the roles that an edit may give, by initial."""

    start: int
    finals: frozenset[int]
    arcs: dict[int, dict[str, int]]
    given: dict[str, str]


class Costs(NamedTuple):
    keep: int = 0
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


#: An optional system turn, then user and assistant in turn, at least once; or nothing.
CHAT = Roles(0, frozenset({0, 3}), {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}, {"u": "user", "a": "assistant"})


class Item(NamedTuple):
    """A row, or `times` rows that have to go; row: its place in the segment."""

    initial: str
    doomed: bool
    extra: int
    times: int
    row: int


class Lattice:
    """Least (cost, edits) from every composed state to the ends. ends: role states in which the items may end."""

    def __init__(self, items: list[Item], ends: set[int], roles: Roles, costs: Costs):
        self.items, self.roles, self.costs = items, roles, costs
        after = self.inserted({q: (0, (), None) for q in ends})
        self.layers = [after]
        for item in reversed(items):
            after = self.inserted(self.arcs(item, after))
            self.layers.append(after)
        self.layers.reverse()

    def arcs(self, item: Item, after: dict) -> dict:
        """The least arc over an item from each role state, after being what follows it."""
        ranks = {k: r for r, k in enumerate(sorted({v[1] for v in after.values()}))}
        best: dict = {}
        for q in self.roles.arcs:
            ways = []
            if q in after:
                ways.append((after[q][0] + self.costs.delete * item.times, (DELETE, ranks[after[q][1]]), (DELETE, q, "")))
            if not item.doomed:
                for symbol, to in self.roles.arcs[q].items():
                    if to in after:
                        cost, rank = after[to][0] + item.extra, ranks[after[to][1]]
                        if symbol == item.initial:
                            ways.append((cost + self.costs.keep, (KEEP, rank), (KEEP, to, "")))
                        if symbol in self.roles.given:
                            ways.append((cost + self.costs.rerole, (REROLE, rank), (REROLE, to, symbol)))
            if ways:
                best[q] = min(ways)
        return best

    def inserted(self, layer: dict) -> dict:
        """A layer's states with insertions between its items. They cost something, so no circle pays."""
        changed = True
        while changed:
            changed = False
            for q, arcs in self.roles.arcs.items():
                for symbol, to in arcs.items():
                    if symbol in self.roles.given and to in layer:
                        way = (layer[to][0] + self.costs.insert, (INSERT, *layer[to][1]), (INSERT, to, symbol))
                        if q not in layer or way[:2] < layer[q][:2]:
                            layer[q] = way
                            changed = True
        return layer

    def path(self, q: int) -> Iterator[tuple[int, Item | None, str]]:
        """(edit, item, initial of the role given) along the least path from q."""
        at = 0
        while self.layers[at][q][2] is not None:
            edit, q, symbol = self.layers[at][q][2]
            yield edit, None if edit == INSERT else self.items[at], symbol
            at += edit != INSERT

    def audit(self, q: int) -> str:
        return "".join(INITIALS[edit] * (item.times if item else 1) for edit, item, _ in self.path(q))


def fault(text: str) -> str:
    """b (blank), t (truncated) or nothing."""
    last = LAST.search(text)
    return "b" if last is None else "" if last[0] in ".!?" else "t"


def items_of(segment: dict, costs: Costs) -> tuple[list[Item], dict[str, int]]:
    """A segment's rows as items, and its counts of faults and of neighbours whose roles don't follow on each other."""
    out, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    before = None
    for i, (role, text, copies, late) in enumerate(zip(segment["roles"], segment["texts"], segment["copies"], segment["late"], strict=True)):
        kind, initial = fault(text), role[:1]
        doomed = copies if kind == "b" or late else copies - 1
        if kind == "b":
            counts["blank"] += copies
        else:
            counts["duplicate"] += doomed
        if doomed < copies:
            counts["truncated"] += kind == "t"
            out.append(Item(initial, False, costs.truncated if kind == "t" else 0, 1, i))
        if doomed:
            out.append(Item(initial, True, 0, doomed, i))
        counts["illegal"] += (copies - 1) * (initial * 2 not in FOLLOWS) + (before is not None and before + initial not in FOLLOWS)
        before = initial
    return out, counts


#: Initials of roles that may stand side by side.
FOLLOWS = {"su", "ua", "au"}

KEY = "conv_id bigint, part int, seg int"
SEGMENTS = f"{KEY}, whole boolean, roles array<string>, texts array<string>, copies array<bigint>, late array<boolean>"
KEY_FIELDS = [("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32())]
SEGMENT_FIELDS = pa.schema([*KEY_FIELDS, ("whole", pa.bool_()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("late", pa.list_(pa.bool_()))])


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows with known faults: by CRC-32 of conv_id:turn some go, lose their text or its
    sentence ends, come twice, or have the role user."""
    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    k = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    own = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), k.alias("k")).filter("k <> 0")
    return own.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def segments(rows: DataFrame, ws: Workspace, size: int = SEGMENT) -> DataFrame:
    """Rows of conversations, in order, as segments: equal rows counted, later ones of a role and text marked late."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    counted = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *text).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    own = ws.save(counted.withColumn("digest", F.md5("text")), "rows")
    again = own.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = again.select(F.col("conv_id").alias("c_"), F.col("role").alias("r_"), F.col("digest").alias("d_"), "first")
    marked = own.join(again, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("role") == F.col("r_")) & (F.col("digest") == F.col("d_")), "left")
    late = F.coalesce(F.struct(F.col("turn").isNotNull().alias("known"), "turn") > F.col("first"), F.lit(False))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest"]
    placed = marked.select("conv_id", "turn", "role", "digest", "text", "copies", late.alias("late")).repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, first, held, chars = TaskContext.get().partitionId(), 0, True, [], 0

        def segment(ends: bool) -> pa.RecordBatch:
            row = {"conv_id": held[0]["conv_id"], "part": part, "seg": seg, "whole": ends and not first}
            return pa.RecordBatch.from_pylist([row | {"roles": [r["role"] for r in held], "texts": [r["text"] for r in held], "copies": [r["copies"] for r in held], "late": [r["late"] for r in held]}], schema=SEGMENT_FIELDS)

        for b in batches:
            for r in b.to_pylist():
                other = bool(held) and held[0]["conv_id"] != r["conv_id"]
                if held and (other or len(held) >= size or chars + len(r["text"]) > SEGMENT_CHARS):
                    yield segment(other)
                    seg, first, held, chars = seg + 1, not other, [], 0
                held.append(r)
                chars += len(r["text"])
        if held:
            yield segment(False)  # the next task may go on with it

    return ws.save(placed.mapInArrow(cut, SEGMENTS), "segments")


def between(parts: DataFrame, roles: Roles, costs: Costs) -> DataFrame:
    """conv_id, part, seg, entry, exit: the role states at both ends of segments whose conversation goes beyond them."""
    kind = "array<struct<entry:int,exit:int,cost:bigint,audit:string>>"

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*KEY_FIELDS, ("ways", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
        for b in batches:
            for s in b.to_pylist():
                items, _ = items_of(s, costs)
                ways = []
                for end in roles.arcs:
                    lattice = Lattice(items, {end}, roles, costs)
                    ways += [{"entry": q, "exit": end, "cost": v[0], "audit": lattice.audit(q)} for q, v in lattice.layers[0].items()]
                yield pa.RecordBatch.from_pylist([{k: s[k] for k in ("conv_id", "part", "seg")} | {"ways": ways}], schema=schema)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*KEY_FIELDS, ("entry", pa.int32()), ("exit", pa.int32())])
        rows = (s for b in batches for s in b.to_pylist())
        for _, own in groupby(rows, key=lambda s: s["conv_id"]):
            best, chosen = {q: (0, "") for q in roles.finals}, []
            for s in own:  # from the last segment to the first
                ways: dict = {}
                for w in s["ways"]:
                    if w["exit"] in best:
                        cost, audit = best[w["exit"]]
                        way = (w["cost"] + cost, w["audit"] + audit, w["exit"])
                        ways[w["entry"]] = min(way, ways.get(w["entry"], way))
                best = {q: v[:2] for q, v in ways.items()}
                chosen.append((s["part"], s["seg"], {q: v[2] for q, v in ways.items()}))
                conv_id = s["conv_id"]
            q = roles.start
            for part, seg, exits in reversed(chosen):
                yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "part": part, "seg": seg, "entry": q, "exit": exits[q]}], schema=schema)
                q = exits[q]

    ways = parts.mapInArrow(least, f"{KEY}, ways {kind}")
    return ways.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.desc("part"), F.desc("seg")).mapInArrow(compose, f"{KEY}, entry int, exit int")


TURN = "struct<role:string,text:string,edit:string>"
REPAIRED = f"{KEY}, whole boolean, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, turns array<{TURN}>"
REPAIRED_FIELDS = pa.schema([
    *KEY_FIELDS, ("whole", pa.bool_()), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()),
    ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))),
])


def repair(spark: SparkSession, rows: DataFrame, roles: Roles = CHAT, costs: Costs = Costs(), size: int = SEGMENT, ws: Workspace | None = None) -> DataFrame:
    """A row for each segment of a conversation: conv_id, part, seg (its order), whole (nothing of the conversation lies
    elsewhere), the repaired turns with the edit that made each, and the segment's counts, cost and edits."""
    ws = ws or Workspace(spark, "repair")
    parts = segments(rows, ws, size)
    open_ = ws.save(between(parts.filter("not whole"), roles, costs), "between").select(F.col("conv_id").alias("c_"), F.col("part").alias("p_"), F.col("seg").alias("s_"), "entry", "exit")
    joined = parts.filter("not whole").join(open_, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("part") == F.col("p_")) & (F.col("seg") == F.col("s_")))
    state = F.lit(None).cast("int")
    columns = parts.columns

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                items, counts = items_of(s, costs)
                lattice = Lattice(items, set(roles.finals) if s["exit"] is None else {s["exit"]}, roles, costs)
                q = roles.start if s["entry"] is None else s["entry"]
                turns = []
                for edit, item, symbol in lattice.path(q):
                    if edit != DELETE:
                        role = s["roles"][item.row] if edit == KEEP else roles.given[symbol]
                        turns.append({"role": role, "text": s["texts"][item.row] if item else "", "edit": INITIALS[edit]})
                ends = {"first": s["roles"][0][:1], "last": s["roles"][-1][:1]}
                yield pa.RecordBatch.from_pylist([{k: s[k] for k in ("conv_id", "part", "seg", "whole")} | ends | counts | {"cost": lattice.layers[0][q][0], "audit": lattice.audit(q), "turns": turns}], schema=REPAIRED_FIELDS)

    return parts.filter("whole").select(*columns, state.alias("entry"), state.alias("exit")).unionByName(joined.select(*columns, "entry", "exit")).mapInArrow(mend, REPAIRED)


REPORT = "conv_id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of segments of one conversation, which come in order."""
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    rows = (s for b in batches for s in b.to_pylist())
    for conv_id, own in groupby(rows, key=lambda s: s["conv_id"]):
        sums, audits, digest, lines, before = dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), 0, None
        for s in own:
            for c in COUNTS:
                sums[c] += s[c]
            sums["illegal"] += before is not None and before + s["first"] not in FOLLOWS
            before = s["last"]
            audits.append(s["audit"])
            for t in s["turns"]:
                digest.update((("\n" if lines else "") + f"{t['role']}:{t['text']}").encode())
                lines += 1
        yield pa.RecordBatch.from_pylist([{"conv_id": conv_id} | sums | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}], schema=schema)


def repair_report(spark: SparkSession, rows: DataFrame, ids: DataFrame, roles: Roles = CHAT, costs: Costs = Costs(), size: int = SEGMENT) -> DataFrame:
    """Of each conv_id in ids: gaps between turns, counts of faults, cost, edits and the digest of its repaired turns."""
    ws = Workspace(spark, "repair")
    mended = ws.save(repair(spark, rows, roles, costs, size, ws), "repaired")
    whole = mended.filter("whole").mapInArrow(fold, REPORT)
    split = mended.filter("not whole").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "seg").mapInArrow(fold, REPORT)
    turns = rows.groupBy(F.col("conv_id").cast("bigint").alias("g_")).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    found = whole.unionByName(split).withColumnRenamed("conv_id", "f_")
    all_ = ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    out = all_.join(turns, F.col("conv_id").eqNullSafe(F.col("g_")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("f_")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *COUNTS)]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
