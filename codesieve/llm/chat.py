"""Chat formatting through a prefix tree: turns that conversations share at their beginning are emitted once.

Template, each turn: an opening mark, the escaped text, a closing mark; marks depend on the role. Inside texts (and
names of other roles) a backslash is doubled and each control string gets one after its first character, so no control
string is left and the escape can be undone.

A node is a turn after a given history. Conversations are sorted by the path of their node hashes; in that order the
tree is walked depth-first, and each conversation emits only nodes that the one before it has not. Tokens are the code
points of the formatted text. A node's row has its place in the stream, position ids counted along its own branch, the
intervals of its ancestors (those that follow each other as one), which with itself are all that its tokens may attend
to, and its span under the loss mask.
A conversation's row has the starts of its nodes. Sorting is by range over tasks, ties broken by conv_id, so neither a
first turn nor equal conversations fill one task; tasks learn only their totals and last path from those before them.

Defined cases: turns go by `turn`, nulls first, then role and text; a null text or role is empty; each row without
conv_id is a conversation of one turn; a repeated row is a turn of its own; roles are read back as they were; an empty table gives no
rows; other columns are ignored. A conversation, like a document, fits into one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions, text_bytes

#: Opening and closing mark of each role; any other role is named between ROLE marks.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, TURN = ("<<ROLE>>", "<</ROLE>>"), ("<<TURN>>", "<</TURN>>")
CONTROL = sorted({m for pair in (*MARKS.values(), ROLE, TURN) for m in pair}, key=len, reverse=True)
LEARNED = "assistant"
#: Readers of one node row that meet in one task.
READERS_PER_TASK = 500
#: Bytes of text that a task walks, beyond what the session's number of partitions has.
TASK_BYTES = 64_000_000
_control = re.compile("|".join(map(re.escape, CONTROL)))
_escaped = re.compile(r"\\(.)", re.DOTALL)
_turn = re.compile("|".join(f"(?P<{r}>{re.escape(a)}(?P<{r}_text>.*?){re.escape(b)})" for r, (a, b) in MARKS.items()) + f"|{re.escape(ROLE[0])}(?P<name>.*?){re.escape(ROLE[1])}{re.escape(TURN[0])}(?P<text>.*?){re.escape(TURN[1])}", re.DOTALL)


def escape(text: str) -> str:
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the span of its text."""
    if role in MARKS:
        opening, closing = MARKS[role]
    else:
        opening, closing = ROLE[0] + escape(role) + ROLE[1] + TURN[0], TURN[1]
    body = escape(text)
    return opening + body + closing, len(opening), len(opening) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation; anything between turns is an error."""
    out, at = [], 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
        at = m.end()
        role = next((r for r in MARKS if m[r] is not None), None)
        out.append((role, unescape(m[f"{role}_text"])) if role else (unescape(m["name"]), unescape(m["text"])))
    return out


def conversations_with_paths(rows: DataFrame) -> DataFrame:
    """conv_id, own (0, or a number of a row without conv_id), path (node hashes in hex, one after the other), turns."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("bigint"))
    grouped = rows.withColumn("own", own).groupBy("conv_id", "own").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = []
            for turns in b.column("turns").to_pylist():
                h, path = b"", []
                for t in turns:
                    h = hashlib.blake2b(h + f"{len(t['role'])}:{t['role']}{t['text']}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    path.append(h.hex())
                paths.append("".join(path))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("own"), pa.array(paths, pa.string()), b.column("turns")], names=["conv_id", "own", "path", "turns"])

    return grouped.mapInArrow(run, grouped.select("conv_id", "own", F.lit("").alias("path"), "turns").schema)


class Branch:
    """The branch of the tree that a walk is on: hash, start and length of each node."""

    def __init__(self, nodes: list[tuple[str, int, int]], at: int):
        self.nodes, self.at = nodes, at

    def shared(self, path: str) -> int:
        k = 0
        while k < len(self.nodes) and path[32 * k : 32 * k + 32] == self.nodes[k][0]:
            k += 1
        return k


def extend(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Add an interval, to the last one if it goes on there."""
    if spans and spans[-1][1] == start:
        spans[-1] = (spans[-1][0], end)
    else:
        spans.append((start, end))


def walk(branch: Branch, path: str, turns: list[dict]) -> list[dict]:
    """Move the branch to a conversation; rows of the nodes that are new."""
    k = branch.shared(path)
    del branch.nodes[k:]
    out = []
    spans: list[tuple[int, int]] = []
    for _, s, n in branch.nodes:
        extend(spans, s, s + n)
    position = sum(n for _, _, n in branch.nodes)
    for i in range(k, len(turns)):
        text, a, b = format_turn(turns[i]["role"], turns[i]["text"])
        before = [{"start": s, "end": e} for s, e in spans]
        loss = {"start": branch.at + a, "end": branch.at + b} if turns[i]["role"] == LEARNED else None
        out.append({"start": branch.at, "end": branch.at + len(text), "position": position, "attends": before, "loss": loss, "segment": text})
        extend(spans, branch.at, branch.at + len(text))
        branch.nodes.append((path[32 * i : 32 * i + 32], branch.at, len(text)))
        branch.at += len(text)
        position += len(text)
    return out


SPAN = "struct<start:bigint,end:bigint>"
OUT = f"kind string, conv_id bigint, own bigint, starts array<bigint>, start bigint, end bigint, position bigint, attends array<{SPAN}>, loss {SPAN}, segment string"


def prefix_tree(spark: SparkSession, rows: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(nodes, conversations). nodes: start, end, position (position id of the first token), attends, loss, segment."""
    found = conversations_with_paths(rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text"))
    found = ws.save(found, "paths")
    tasks = max(partitions(spark), -(-text_bytes(rows) // TASK_BYTES))
    ordered = found.repartitionByRange(tasks, "path", "conv_id", "own").sortWithinPartitions("path", "conv_id", "own")
    # kept with its task number, so that the second walk finds the tasks of the first
    ordered = ws.save(ordered.withColumn("task", F.spark_partition_id()), "ordered")
    by_task = ordered.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "path", "conv_id", "own")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, branch, out = None, None, None, []

        def close() -> None:
            if now is not None:
                out.append({"task": now, "first": [h for h, _, _ in first], "lengths": [n for _, _, n in first], "total": branch.at, "path": [h for h, _, _ in branch.nodes], "starts": [s for _, s, _ in branch.nodes], "sizes": [n for _, _, n in branch.nodes]})

        for b in batches:
            for task, path, turns in zip(b.column("task").to_pylist(), b.column("path").to_pylist(), b.column("turns").to_pylist(), strict=True):
                new = task != now
                if new:
                    close()
                    now, branch = task, Branch([], 0)
                walk(branch, path, turns)
                if new:
                    first = list(branch.nodes)
        close()
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("task", pa.int32()), ("first", pa.list_(pa.string())), ("lengths", pa.list_(pa.int64())), ("total", pa.int64()), ("path", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]))

    # one row for each task: where it ends
    ends = by_task.mapInArrow(totals, "task int, first array<string>, lengths array<bigint>, total bigint, path array<string>, starts array<bigint>, sizes array<bigint>").orderBy("task").collect()
    begins: dict[int, tuple[list[tuple[str, int, int]], int]] = {}
    branch = Branch([], 0)
    for e in ends:
        begins[e["task"]] = (list(branch.nodes), branch.at)
        k = branch.shared("".join(e["first"]))
        less = sum(e["lengths"][:k])  # nodes that an earlier task has emitted
        shift = branch.at - less
        same = 0
        while same < min(k, len(e["path"])) and e["path"][same] == branch.nodes[same][0]:
            same += 1
        own = list(zip(e["path"], [s + shift for s in e["starts"]], e["sizes"], strict=True))[same:]
        branch = Branch(branch.nodes[:same] + own, branch.at + e["total"] - less)
    sent = spark.sparkContext.broadcast(begins)  # one branch for each task

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, branch = None, None
        schema = None
        for b in batches:
            out = []
            for task, conv, own, path, turns in zip(*(b.column(c).to_pylist() for c in ("task", "conv_id", "own", "path", "turns")), strict=True):
                if task != now:
                    nodes, at = sent.value[task]
                    now, branch = task, Branch(list(nodes), at)
                out += [{"kind": "node", **r} for r in walk(branch, path, turns)]
                out.append({"kind": "conversation", "conv_id": conv, "own": own, "starts": [s for _, s, _ in branch.nodes]})
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            schema = pa.schema([("kind", pa.string()), ("conv_id", pa.int64()), ("own", pa.int64()), ("starts", pa.list_(pa.int64())), ("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("attends", pa.list_(span)), ("loss", span), ("segment", pa.string())])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    written = by_task.mapInArrow(emit, OUT)
    written.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(ws.path("tree"))
    ws.release()
    table = spark.read.schema(OUT).parquet(ws.path("tree"))
    return table.filter("kind = 'node'").select("start", "end", "position", "attends", "loss", "segment"), table.filter("kind = 'conversation'").select("conv_id", "own", "starts")


def read_back(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, spans: the text of each conversation, put together from its nodes, and what its loss covers."""
    asked = conversations.select("conv_id", "own", F.posexplode("starts").alias("k", "start"))
    readers = asked.groupBy("start").agg(F.ceil(F.count(F.lit(1)) / READERS_PER_TASK).cast("int").alias("copies"))
    salted = asked.join(readers, "start").withColumn("salt", F.pmod(F.xxhash64("conv_id", "own"), "copies").cast("int"))
    copied = nodes.join(readers, "start").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    piece = F.struct("k", "segment", (F.col("loss.start") - F.col("start")).alias("a"), (F.col("loss.end") - F.col("start")).alias("b"), "position")
    return salted.select("conv_id", "own", "k", "start", "salt").join(copied, ["start", "salt"]).groupBy("conv_id", "own").agg(F.array_sort(F.collect_list(piece)).alias("pieces")).drop("own")


def digests(read: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for pieces in b.column("pieces").to_pylist():
                formatted = "".join(p["segment"] for p in pieces)
                ends = [0, *accumulate(len(p["segment"]) for p in pieces)]
                if [p["position"] for p in pieces] != ends[:-1]:
                    raise ValueError("position ids do not follow the branch")
                loss = "".join(unescape(p["segment"][p["a"] : p["b"]]) for p in pieces if p["a"] is not None)
                turns = parse(formatted)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
                rows.append((len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted)))
            n, whole, chars, loss, size = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(n, pa.int64()), pa.array(whole, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return read.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def chat_digests(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Format all conversations and read them back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return digests(read_back(*prefix_tree(spark, rows, Workspace(spark, "chat"))))
