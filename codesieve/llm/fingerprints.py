"""Which fingerprints of a document also occur in documents of other content, counted over all documents.

A fingerprint has 64 bits; a shuffle row for each would be several times its size. So each task packs the fingerprints
of a few thousand documents, a chunk, into one block for each bucket (a range of the hash space), buckets count them,
and send back to each block what is shared. A fingerprint that several documents of a chunk have goes to its bucket
once, with their number, and the answer is dealt to them when it comes back; so what a third of all rows share costs a
bucket one entry for each chunk. Buckets have a power of two in number, and blocks keep the bits that it leaves open:
all 64 count at any size.

A chunk has a block for FAN buckets at most, so that blocks stay worth their row. A larger corpus has more buckets, and
goes there in two rounds: chunks send blocks to FAN ranges; in a range blocks of many chunks are packed anew, equal
fingerprints as one entry, and the pack sends blocks to the buckets of its range. Answers come back to the pack, which
deals them to its chunks' blocks. So what all rows share costs a bucket one entry for each pack.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fingerprints packed together, and bytes of text whose fingerprints fill a bucket.
BLOCK, BUCKET_BYTES = 400_000, 10_000_000
BLOCKS = "chunk bigint, bucket int, kind int, a binary, b binary, c binary"
#: Blocks of a chunk at most, and buckets whose blocks one task packs anew.
FAN, PACKED_TOGETHER = 4096, 64
#: Kinds of rows: fingerprints of one document each, of several, the chunk's documents, which have those of several, and a
#: block as it came to a pack.
ONE, SEVERAL, DOCUMENTS, HOLDERS, MEMBER = range(5)
COLUMNS = ["chunk", "bucket", "kind", "a", "b", "c"]


def bucket_count(n_bytes: int, least: int = 256, each: int = BUCKET_BYTES) -> int:
    return int(min(1 << 24, max(least, 1 << max(0, -(-n_bytes // each) - 1).bit_length())))


def low_bits(n_buckets: int) -> int:
    return 64 - (n_buckets.bit_length() - 1)


def buckets_of(prints: np.ndarray, n_buckets: int) -> np.ndarray:
    return (prints >> np.uint64(low_bits(n_buckets))).astype(np.int64)


def pack(values: np.ndarray, n_buckets: int) -> bytes:
    """The bytes that hold the low bits of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-low_bits(n_buckets) // 8)]).tobytes()


def unpack(raw: bytes, bucket: int, n_buckets: int) -> np.ndarray:
    bits = low_bits(n_buckets)
    size = -(-bits // 8)
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return (out.view("<u8").ravel() & np.uint64((1 << bits) - 1)) | np.uint64(bucket << bits)


def heads(values: np.ndarray) -> np.ndarray:
    """Whether each of the ordered values is the first of its kind."""
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return first


def cuts(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """Each bucket that occurs among ordered ones, and where."""
    found, start = np.unique(bucket, return_index=True)
    ends = np.append(start, len(bucket)).tolist()
    return [(b, slice(ends[k], ends[k + 1])) for k, b in enumerate(found.tolist())]


def runs(doc: np.ndarray) -> np.ndarray:
    """(document, number of its fingerprints) for documents in order."""
    first = np.nonzero(heads(doc))[0]
    return np.stack([doc[first], np.diff(np.append(first, len(doc)))], 1).astype("<u4")


def block_table(chunk: int, rows: list[tuple]) -> pa.RecordBatch:
    bucket, kind, *blobs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), *(pa.array(c, pa.binary()) for c in blobs)], names=COLUMNS)


def blocks(n_buckets: int, extract: Callable[[list], list[tuple[int, bytes, np.ndarray]]]):
    """mapInArrow function: (doc_id, text) to blocks. extract gives (size, 16-byte content id, distinct fingerprints)."""

    def flush(chunk: int, ids: list, found: list) -> pa.RecordBatch:
        prints = np.concatenate([f[2] for f in found])
        doc = np.repeat(np.arange(len(ids)), [len(f[2]) for f in found])
        content = b"".join(f[1] for f in found)
        short = np.frombuffer(content, "<u8")[::2]
        order = np.argsort(prints, kind="stable")
        first = heads(prints[order])
        group = np.cumsum(first) - 1
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        alone = size[group] == 1
        many = order[~alone]

        at = np.sort(order[alone])  # documents in order
        bucket = buckets_of(prints[at], n_buckets)
        at = at[np.argsort(bucket, kind="stable")]
        rows = []
        for b, part in cuts(np.sort(bucket)):
            own = runs(doc[at[part]])
            rows.append((b, ONE, pack(prints[at[part]], n_buckets), own.tobytes(), short[own[:, 0]].tobytes()))

        value, holder = prints[many], doc[many]
        start = np.nonzero(heads(value))[0]
        inner = np.lexsort((short[holder], value))
        fresh = heads(value[inner]) | heads(short[holder][inner])
        n_contents = np.add.reduceat(fresh.astype(np.int64), start).astype("<u4") if len(start) else np.zeros(0, "<u4")
        one_content = short[holder][inner][start]
        value = value[start]
        for b, part in cuts(buckets_of(value, n_buckets)):
            rows.append((b, SEVERAL, pack(value[part], n_buckets), n_contents[part].tobytes(), one_content[part].tobytes()))
        home = n_buckets + chunk % n_buckets
        rows.append((home, DOCUMENTS, np.array(ids, "<i8").tobytes(), np.array([f[0] for f in found], "<i4").tobytes(), content))
        rows.append((home, HOLDERS, np.diff(np.append(start, len(many))).astype("<u4").tobytes(), holder.astype("<u4").tobytes(), b""))
        return block_table(chunk, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, found, held = TaskContext.get().partitionId() << 32, [], [], 0
        for part in slices(batches):
            ids += part.column("doc_id").to_pylist()
            new = extract(part.column("text").to_pylist())
            found += new
            held += sum(len(f[2]) for f in new)
            if held >= BLOCK:
                yield flush(chunk, ids, found)
                chunk, ids, found, held = chunk + 1, [], [], 0
        if ids:
            yield flush(chunk, ids, found)

    return run


def entries(rows: list[tuple], bucket: int, n_buckets: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints of each block, all of them, a content of each, how many other contents it stands for)."""
    prints, content, more = [], [], []
    for kind, a, b, c in rows:
        p = unpack(a, bucket, n_buckets)
        prints.append(p)
        if kind == ONE:
            content.append(np.repeat(np.frombuffer(c, "<u8"), np.frombuffer(b, "<u4").reshape(-1, 2)[:, 1]))
            more.append(np.zeros(len(p), np.int64))
        else:
            content.append(np.frombuffer(c, "<u8"))
            more.append(np.frombuffer(b, "<u4").astype(np.int64) - 1)
    return prints, np.concatenate(prints), np.concatenate(content), np.concatenate(more)


def answer(kind: int, prints: np.ndarray, b: bytes, own: np.ndarray, n_buckets: int) -> tuple[bytes, bytes, bytes]:
    """What a block gets back: of single documents what is shared, of several all, with the number of contents."""
    if kind != ONE:
        return pack(prints, n_buckets), b"", own.astype("<u4").tobytes()
    keep = own >= 2
    n = np.frombuffer(b, "<u4").reshape(-1, 2)
    return pack(prints[keep], n_buckets), runs(np.repeat(n[:, 0], n[:, 1])[keep]).tobytes(), own[keep].astype("<u4").tobytes()


def counter(n_buckets: int):
    """applyInArrow function of a bucket: blocks to blocks of what is shared, c the number of contents.

    Contents of one document each are told apart by their ids; those that a chunk has already counted are added."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= n_buckets:  # what a chunk or a pack keeps for itself
            return table
        kind, a, b, c = (table.column(x).to_pylist() for x in ("kind", "a", "b", "c"))
        prints, value, who, more = entries(list(zip(kind, a, b, c, strict=True)), bucket, n_buckets)
        order = np.argsort(value, kind="stable")
        ordered = value[order]
        again = np.zeros(len(value), bool)
        same = ordered[1:] == ordered[:-1]
        again[1:] |= same
        again[:-1] |= same
        n_contents = 1 + more  # of prints that stand here once
        at = order[again]
        if len(at):
            at = at[np.lexsort((who[at], value[at]))]
            first = heads(value[at])
            group = np.cumsum(first) - 1
            fresh = first | heads(who[at])
            n_contents[at] = (np.bincount(group, fresh) + np.bincount(group, more[at])).astype(np.int64)[group]
        start, out = 0, []
        for k, p, x in zip(kind, prints, b, strict=True):
            out.append(answer(k, p, x, n_contents[start : start + len(p)], n_buckets))
            start += len(p)
        return pa.Table.from_arrays([table.column("chunk"), table.column("bucket"), table.column("kind"), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], names=COLUMNS)

    return run


def packer(n_ranges: int, n_buckets: int, block: int):
    """mapInArrow function over blocks in the order of (bucket, salt, chunk, kind): blocks of many chunks to those of
    packs, whose ids are negative and follow from range, salt and place. What chunks keep for themselves passes."""

    def flush(pack_id: int, range_: int, members: list[dict]) -> pa.RecordBatch:
        _, value, who, more = entries([(m["kind"], m["a"], m["b"], m["c"]) for m in members], range_, n_ranges)
        order = np.lexsort((who, value))
        first = heads(value[order])
        group = np.cumsum(first) - 1
        fresh = first | heads(who[order])
        n_contents = np.bincount(group, fresh) + np.bincount(group, more[order])
        start = np.nonzero(first)[0]
        value, one = value[order][start], who[order][start]
        rows = [(b, SEVERAL, pack(value[part], n_buckets), n_contents[part].astype("<u4").tobytes(), one[part].tobytes()) for b, part in cuts(buckets_of(value, n_buckets))]
        home = n_buckets + -pack_id % n_buckets
        rows += [(home, MEMBER, m["a"], m["b"], struct.pack("<qi", m["chunk"], m["kind"])) for m in members]
        return block_table(pack_id, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for (range_, salt), own in groupby(rows, key=lambda r: (r["bucket"], r["salt"])):
            if range_ >= n_ranges:
                for r in own:
                    yield block_table(r["chunk"], [(n_buckets + r["chunk"] % n_buckets, r["kind"], r["a"], r["b"], r["c"])])
                continue
            members, held, seq = [], 0, 0
            for r in own:
                members.append(r)
                held += len(r["a"])
                if held >= block * -(-low_bits(n_ranges) // 8):
                    yield flush(pack_of(range_, salt, seq), range_, members)
                    members, held, seq = [], 0, seq + 1
            if members:
                yield flush(pack_of(range_, salt, seq), range_, members)

    return run


def pack_of(range_: int, salt: int, seq: int) -> int:
    """The id of a pack: up to 2**20 salts of a range and 2**28 packs of a salt."""
    return -1 - ((range_ << 48) | (salt << 28) | seq)


def range_of(pack_id: int) -> int:
    return (-1 - pack_id) >> 48


def dealer(n_ranges: int, n_buckets: int):
    """applyInArrow function of a pack: answers of buckets to answers for the blocks of its chunks."""

    def run(table: pa.Table) -> pa.Table:
        pack_id = table.column("chunk")[0].as_py()
        if pack_id >= 0:  # what a chunk keeps for itself
            return table
        range_, value, counts, members = range_of(pack_id), [], [], []
        for bucket, kind, a, b, c in sorted(zip(*(table.column(x).to_pylist() for x in COLUMNS[1:]), strict=True), key=lambda r: r[:2]):
            if kind == MEMBER:
                members.append((a, b, *struct.unpack("<qi", c)))
            else:
                value.append(unpack(a, bucket, n_buckets))
                counts.append(np.frombuffer(c, "<u4"))
        value, counts = np.concatenate(value), np.concatenate(counts).astype(np.int64)  # buckets are ranges, so values are in order
        out = []
        for a, b, _, kind in members:
            prints = unpack(a, range_, n_ranges)
            out.append(answer(kind, prints, b, counts[np.searchsorted(value, prints)], n_ranges))
        n = len(members)
        return pa.Table.from_arrays([pa.array([m[2] for m in members], pa.int64()), pa.array([range_] * n, pa.int32()), pa.array([m[3] for m in members], pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], names=COLUMNS)

    return run


def assembler(n_buckets: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], heavy: int, weighed: bool):
    """applyInArrow function of a chunk: one row for each document; prints only where keep(size, shared) holds."""

    def run(table: pa.Table) -> pa.Table:
        ids = size = content = times = holder = None
        docs, values, weights, several, their = [], [], [], [], []
        for bucket, kind, a, b, c in sorted(zip(*(table.column(x).to_pylist() for x in COLUMNS[1:]), strict=True), key=lambda r: r[:2]):
            if kind == DOCUMENTS:
                ids, size, content = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i4"), np.frombuffer(c, "V16")
            elif kind == HOLDERS:
                times, holder = np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)
            else:
                value, weight = unpack(a, bucket, n_buckets), np.frombuffer(c, "<u4").astype(np.int64)
                if kind == ONE:
                    n = np.frombuffer(b, "<u4").reshape(-1, 2).astype(np.int64)
                    docs.append(np.repeat(n[:, 0], n[:, 1]))
                    values.append(value)
                    weights.append(weight)
                else:
                    several.append(value)
                    their.append(weight)
        empty = np.zeros(0, np.int64)
        value, weight = np.repeat(np.concatenate([empty.astype(np.uint64), *several]), times), np.repeat(np.concatenate([empty, *their]), times)
        shared = weight >= 2
        doc, value, weight = np.concatenate([*docs, holder[shared]]), np.concatenate([*values, value[shared]]), np.concatenate([*weights, weight[shared]])
        n_shared = np.bincount(doc, minlength=len(ids))
        use = keep(size, n_shared)
        inside = use[doc]
        doc, value, weight = doc[inside], value[inside], weight[inside]
        n_heavy = np.bincount(doc[weight > heavy], minlength=len(ids))
        order = np.lexsort((value, -weight, doc))
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ids)))])
        value = value[order].astype("<u8")
        prints = [value[ends[i] : ends[i + 1]].tobytes() if use[i] else None for i in range(len(ids))]
        columns = {"doc_id": pa.array(ids), "size": pa.array(size), "content": pa.array([x.tobytes() for x in content], pa.binary()), "n_shared": pa.array(n_shared.astype(np.int32)), "n_heavy": pa.array(n_heavy.astype(np.int32)), "prints": pa.array(prints, pa.binary())}
        if weighed:
            times = weight[order].astype("<u4")
            columns["weights"] = pa.array([times[ends[i] : ends[i + 1]].tobytes() if use[i] else None for i in range(len(ids))], pa.binary())
        return pa.Table.from_pydict(columns)

    return run


def shared_fingerprints(docs: DataFrame, n_buckets: int, extract, keep, heavy: int = 1 << 40, weighed: bool = False, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """doc_id, size, content, n_shared, n_heavy, prints: the shared fingerprints of 64 bits, those in most contents
    first; the first n_heavy are in more than `heavy` contents; weighed, in how many contents each is.

    docs has doc_id (not null) and text. Fingerprints of documents with the same content id are not shared by that.
    """
    n_ranges = min(n_buckets, fan)
    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(blocks(n_ranges, extract), BLOCKS)
    if n_buckets > n_ranges:
        salts = max(1, n_buckets // n_ranges // PACKED_TOGETHER)
        salted = made.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
        made = salted.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "chunk", "kind").mapInArrow(packer(n_ranges, n_buckets, block), BLOCKS)
    counted = made.groupBy("bucket").applyInArrow(counter(n_buckets), BLOCKS)
    if n_buckets > n_ranges:
        counted = counted.groupBy("chunk").applyInArrow(dealer(n_ranges, n_buckets), BLOCKS)
    columns = "doc_id bigint, size int, content binary, n_shared int, n_heavy int, prints binary" + (", weights binary" if weighed else "")
    return counted.groupBy("chunk").applyInArrow(assembler(n_ranges, keep, heavy, weighed), columns)
