"""Line dedup: documents probe a sharded minimal perfect hash of repeated lines instead of joining their lines.

1. Every document gives the 128-bit hashes of its distinct line keys; Spark counts documents and finds the largest
   doc_id for each hash (summed before the shuffle, so a line that a third of all documents share costs no more).
2. Hashes of lines that repeat at all are dealt over shards. Each shard builds a minimal perfect hash (levels of bit
   arrays, ranked) into three arrays: fingerprint, count, keeper. Lines of one document have no entry: whatever the
   threshold, none of them goes.
3. Documents read again probe the arrays; a line goes if its count there is `min_docs` or more and its keeper is another
   document. Shards of at most BROADCAST_BYTES together are broadcast. Beyond that they
   stay where they are: documents send the hashes of their lines, packed, to the tasks of the hashes' shards, which probe
   their arrays and send back the numbers of dropped lines. Either way the corpus is read twice in all.

Keys: lines with [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased; only keys of `min_chars` code points count.
Defined cases: a null or empty text is one empty line, which is too short to drop; rows with a null doc_id neither
count nor lose lines; rows that share a doc_id count as one document, and of those that share the largest doc_id each
keeps its line; a text all of whose lines go becomes empty; an empty table gives no rows; dedup_lines keeps all other
columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices, text_bytes

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of one shard, and bytes of shards that are broadcast at once.
SHARD_KEYS, BROADCAST_BYTES = 50_000, 48_000_000
SPACE = b" \t\n\x0b\x0c\r"
GAMMA = 2


def line_keys(text: str | None, min_chars: int) -> tuple[list[str], list[bytes | None]]:
    """Lines of a text and the hash of each line's key, or None for a key that is too short."""
    lines = (text or "").split("\n")
    out: list[bytes | None] = []
    for line in lines:
        if len(line) < min_chars:
            out.append(None)
            continue
        raw = line.encode("utf-8", "surrogatepass").strip(SPACE).lower()
        long = len(raw) >= min_chars and (raw.isascii() or len(raw.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(raw) if long else None)
    return lines, out


def line_counts(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(high, low, n_docs, keeper) of line hashes found in two documents or more (or in min_docs, if that is less)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for id_, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                own = {k for k in line_keys(text.as_py(), min_chars)[1] if k}
                ids += [id_] * len(own)
                keys += own
            two = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(ids, pa.int64())], names=["high", "low", "doc_id"])

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "high bigint, low bigint, doc_id bigint")
    # rows that share a doc_id are one document; a common line is dealt by (line, doc_id) first, so it fills no task
    counted = rows.groupBy("high", "low").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("n_docs") >= min(min_docs, 2))


def mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level, keys that are alone in their bit stay there."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.words = [np.concatenate([[0], np.cumsum(np.bitwise_count(bits.view(np.uint8)).astype(np.int64))]) for bits in levels]
        self.before = np.concatenate([[0], np.cumsum([w[-1] for w in self.words])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(64, -(-GAMMA * len(keys) // 8) * 8)
            at = (mix(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[at]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for some keys that were not there (others get any index)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mix(keys[left], k) % np.uint64(len(bits) * 8)).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (bits[byte] >> bit) & 1 == 1
            below = np.bitwise_count(bits[byte[hit]] & ((np.uint8(1) << bit[hit]) - np.uint8(1)))
            out[left[hit]] = self.before[k] + self.words[k][byte[hit]] + below
            left = left[~hit]
        return out


class Shard:
    """Perfect hash, fingerprints, counts and keepers of a shard's line hashes."""

    def __init__(self, levels: list[bytes], fingerprint: bytes, count: bytes, keeper: bytes):
        self.hash = PerfectHash([np.frombuffer(x, np.uint8) for x in levels])
        self.fingerprint, self.count, self.keeper = np.frombuffer(fingerprint, "<i8"), np.frombuffer(count, "<u4"), np.frombuffer(keeper, "<i8")

    def keepers(self, high: np.ndarray, low: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(is it here with a count of min_docs or more, keeper) of each line hash."""
        at = self.hash.find(high.view(np.uint64))
        here = at >= 0
        here[here] = (self.fingerprint[at[here]] == low[here]) & (self.count[at[here]] >= min_docs)
        return here, np.where(here, self.keeper[np.where(here, at, 0)], 0) if len(self.keeper) else np.zeros(len(high), np.int64)


def build_shards(counts: DataFrame, n_shards: int) -> DataFrame:
    """One row for each shard: its arrays. Two hashes of one shard with equal high halves go to different copies."""

    def run(table: pa.Table) -> pa.Table:
        high, low = table.column("high").to_numpy(), table.column("low").to_numpy()
        count, keeper = table.column("n_docs").to_numpy(), table.column("keeper").to_numpy()
        rows: list[dict] = []
        left = np.arange(len(high))
        while len(left):
            _, first = np.unique(high[left], return_index=True)
            use = left[np.sort(first)]
            left = np.setdiff1d(left, use)
            h = PerfectHash.build(high[use].view(np.uint64))
            order = np.empty(len(use), np.int64)
            order[h.find(high[use].view(np.uint64))] = use
            rows.append({"shard": table.column("shard")[0].as_py(), "levels": [x.tobytes() for x in h.levels], "fingerprint": low[order].astype("<i8").tobytes(), "count": np.minimum(count[order], 2**32 - 1).astype("<u4").tobytes(), "keeper": keeper[order].astype("<i8").tobytes()})
        return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("levels", pa.list_(pa.binary())), ("fingerprint", pa.binary()), ("count", pa.binary()), ("keeper", pa.binary())]))

    return counts.withColumn("shard", F.pmod("high", F.lit(n_shards)).cast("int")).groupBy("shard").applyInArrow(run, "shard int, levels array<binary>, fingerprint binary, count binary, keeper binary")


def dropped_lines(ids: list[int | None], hashes: list[list[bytes | None]], shards: dict[int, list[Shard]], n_shards: int, min_docs: int) -> list[np.ndarray]:
    """For each document of a batch, a flag for each of its lines."""
    n = [len(h) for h in hashes]
    flat = [k for h in hashes for k in h]
    doc = np.repeat(np.arange(len(ids)), n)
    real = np.array([k is not None for k in flat], bool)
    two = np.frombuffer(b"".join(k for k in flat if k), "<i8").reshape(-1, 2)
    high, low = two[:, 0].copy(), two[:, 1].copy()
    own = np.array([-1 if i is None else i for i in ids], np.int64)[doc[real]]
    known = np.array([i is not None for i in ids], bool)[doc[real]]
    drop, shard = np.zeros(len(high), bool), np.mod(high, n_shards)
    for s in np.unique(shard):
        at = np.nonzero(shard == s)[0]
        for part in shards.get(int(s), ()):
            here, keeper = part.keepers(high[at], low[at], min_docs)
            drop[at] |= here & (keeper != own[at]) & known[at]
    out = np.zeros(len(flat), bool)
    out[real] = drop
    return np.split(out, np.cumsum(n)[:-1]) if n else []


def probe(docs: DataFrame, shared, n_shards: int, min_chars: int, min_docs: int, columns: str, emit) -> DataFrame:
    """mapInArrow over docs; emit(batch, lines, flags) makes the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[Shard]] = {}
        for s, *arrays in shared.value:
            shards.setdefault(s, []).append(Shard(*arrays))
        for b in batches:
            split = [line_keys(t.as_py(), min_chars) for t in b.column("text")]
            flags = dropped_lines(b.column("doc_id").cast(pa.int64()).to_pylist(), [h for _, h in split], shards, n_shards, min_docs)
            yield emit(b, [x for x, _ in split], flags)

    return docs.mapInArrow(run, columns)


def kept_text(lines: list[str], drop: np.ndarray) -> str:
    return "\n".join([x for x, d in zip(lines, drop, strict=True) if not d]) if drop.any() else "\n".join(lines)


def emit_digest(b: pa.RecordBatch, lines: list[list[str]], flags: list[np.ndarray]) -> pa.RecordBatch:
    kept = [hashlib.sha256(kept_text(x, d).encode("utf-8", "surrogatepass")).hexdigest() for x, d in zip(lines, flags, strict=True)]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in lines], pa.int64()), pa.array([int(d.sum()) for d in flags], pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def emit_text(b: pa.RecordBatch, lines: list[list[str]], flags: list[np.ndarray]) -> pa.RecordBatch:
    old = b.column("text")
    text = [t.as_py() if not d.any() else kept_text(x, d) for t, x, d in zip(old, lines, flags, strict=True)]
    at = b.schema.get_field_index("text")
    return b.set_column(at, "text", pa.array(text, pa.string()))


#: A line that is looked up away from its document: hash, doc_id, hashes of the document's text, number of the line.
PROBE = np.dtype([("high", "<i8"), ("low", "<i8"), ("doc", "<i8"), ("k1", "<i8"), ("k2", "<i8"), ("line", "<i4")])
PARCEL = "shard int, salt int, kind int, levels array<binary>, a binary, b binary, c binary"
ARRAYS, PROBES = 0, 1
#: Bytes of text whose lines one task looks up in a shard.
SALT_BYTES = 64_000_000


def probe_blocks(docs: DataFrame, n_shards: int, salts: int, min_chars: int) -> DataFrame:
    """Lines of (doc_id, k1, k2, text), packed for their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for b in slices(batches):
            keys = [line_keys(t.as_py(), min_chars)[1] for t in b.column("text")]
            at = [(d, i) for d, own in enumerate(keys) for i, k in enumerate(own) if k]
            doc, line = np.array(at, np.int64).reshape(-1, 2).T
            probes = np.zeros(len(at), PROBE)
            two = np.frombuffer(b"".join(k for own in keys for k in own if k), "<i8").reshape(-1, 2)
            probes["high"], probes["low"], probes["line"] = two[:, 0], two[:, 1], line
            for name, column in (("doc", "doc_id"), ("k1", "k1"), ("k2", "k2")):
                probes[name] = b.column(column).to_numpy()[doc]
            shard = np.mod(probes["high"], n_shards)
            order = np.argsort(shard, kind="stable")
            found, start = np.unique(shard[order], return_index=True)
            blobs = [probes[x].tobytes() for x in np.split(order, start[1:])] if len(found) else []
            none = pa.nulls(len(blobs), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([(task + made) % salts] * len(blobs), pa.int32()), pa.array([PROBES] * len(blobs), pa.int32()), pa.nulls(len(blobs), pa.list_(pa.binary())), pa.array(blobs, pa.binary()), none, none], schema=pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), ("levels", pa.list_(pa.binary())), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]))
            made += 1

    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(run, PARCEL)


def look_up(parcels: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, k1, k2, lines): what documents lose, from parcels in which a shard's arrays come before its probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            lost = [np.zeros(0, PROBE)]
            for shard, salt, kind, levels, x, y, z in zip(*(b.column(c).to_pylist() for c in ("shard", "salt", "kind", "levels", "a", "b", "c")), strict=True):
                if (shard, salt) != now:
                    now, held = (shard, salt), []
                if kind == ARRAYS:
                    held.append(Shard(levels, x, y, z))
                    continue
                probes = np.frombuffer(x, PROBE)
                drop, high, low = np.zeros(len(probes), bool), probes["high"].copy(), probes["low"].copy()
                for part in held:
                    here, keeper = part.keepers(high, low, min_docs)
                    drop |= here & (keeper != probes["doc"])
                lost.append(probes[drop])
            rows = np.concatenate(lost)
            who = rows[["doc", "k1", "k2"]]
            start = np.nonzero(np.concatenate([[True], who[1:] != who[:-1]]))[0] if len(rows) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array([*start.tolist(), len(rows)], pa.int32()), pa.array(rows["line"], pa.int32())) if len(rows) else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[c][start], pa.int64()) for c in ("doc", "k1", "k2")), lists], names=["doc_id", "k1", "k2", "lines"])

    return parcels.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, lines array<int>")


def text_key() -> dict[str, Column]:
    """128 bits that tell texts apart whose rows share a doc_id."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return {"k1": F.xxhash64(t), "k2": F.xxhash64(F.lit("text"), t)}


def routed(docs: DataFrame, shards: DataFrame, n_shards: int, salts: int, min_chars: int, min_docs: int, ws: Workspace, columns: str, emit) -> DataFrame:
    """As probe, without sending shards to all tasks: lines go to the shards."""
    key = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumns(text_key())
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    arrays = shards.select("shard", salt, F.lit(ARRAYS).alias("kind"), "levels", F.col("fingerprint").alias("a"), F.col("count").alias("b"), F.col("keeper").alias("c"))
    parcels = arrays.unionByName(probe_blocks(key, n_shards, salts, min_chars))
    found = look_up(parcels.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind"), min_docs)
    # a document has at most as many entries as lines
    lines = ws.save(found.groupBy("doc_id", "k1", "k2").agg(F.flatten(F.collect_list("lines")).alias("dropped")), "dropped")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumns(text_key())
    joined = rows.join(lines, ["doc_id", "k1", "k2"], "left").select("row", "dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.RecordBatch.from_struct_array(b.column("row"))
            split = [(t.as_py() or "").split("\n") for t in own.column("text")]
            flags = []
            for x, drop in zip(split, b.column("dropped").to_pylist(), strict=True):
                flags.append(np.zeros(len(x), bool))
                flags[-1][drop or []] = True
            yield emit(own, split, flags)

    return joined.mapInArrow(run, columns)


def apply(spark: SparkSession, docs: DataFrame, emit, columns: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS, salt_bytes: int = SALT_BYTES) -> DataFrame:
    ws = Workspace(spark, "line-dedup")
    counts = ws.save(line_counts(docs, min_chars, min_docs), "counts")
    n_shards = max(1, -(-counts.count() // shard_keys))
    shards = ws.save(build_shards(counts, n_shards), "shards")
    size = shards.agg(F.sum(F.length("fingerprint") + F.length("count") + F.length("keeper") + F.aggregate("levels", F.lit(0), lambda a, x: a + F.length(x)))).first()[0] or 0
    if size > broadcast_bytes:
        salts = max(1, -(-text_bytes(docs) // (n_shards * salt_bytes)))
        return routed(docs, shards, n_shards, salts, min_chars, min_docs, ws, columns, emit)
    rows = shards.collect()  # at most broadcast_bytes
    sent = spark.sparkContext.broadcast([(r["shard"], [bytes(x) for x in r["levels"]], bytes(r["fingerprint"]), bytes(r["count"]), bytes(r["keeper"])) for r in rows])
    return probe(docs, sent, n_shards, min_chars, min_docs, columns, emit)


def line_report(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return apply(spark, docs.select("doc_id", "text"), emit_digest, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string", **options)


def dedup_lines(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs with repeated lines gone from `text`; all columns stay."""
    return apply(spark, docs, emit_text, docs.schema, **options)
