"""Token ids as ORC: documents in ascending doc_id order, ids in run-length encoded integer streams, with row indexes
and a Bloom filter on doc_id, so that readers take stripes in parallel and skip those without an asked document.

Each file holds one range of doc_ids; `seq` orders rows within and across files. Texts are cut where the tokenizer always
begins anew, and each worker remembers pieces it has encoded, up to a bound.

Defined cases: a null text is empty (its only id is the end id); null doc_ids come first; rows that share a doc_id stand
side by side; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, text_bytes
from .rolling import mixed

#: Pieces a worker remembers before it starts anew, and bytes of these; it keeps one such generation besides.
REMEMBERED, REMEMBERED_BYTES = 250_000, 32_000_000
#: Bytes of text for one file.
FILE_BYTES = 24_000_000
ORC = {"orc.compress": "SNAPPY", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(16 << 20)}
#: Bytes of text that are cut at once.
TOGETHER = 3_000_000
#: Bytes of a piece that its hash covers.
HASHED = 512
#: Bytes after a blank with which something visible begins for certain (other characters may be white space).
VISIBLE = np.array([i > 32 and i not in (0xC2, 0xE1, 0xE2, 0xE3) for i in range(256)])
LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
SECOND = np.array([0x80 <= i < 0xC0 and i not in (0x97, 0xB7) for i in range(256)])
GRAPHIC = np.array([32 < i < 127 for i in range(256)])
MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def distinct(raw: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the distinct pieces raw[start:stop], which of them each piece is). Pieces of equal hash are compared."""
    size = stop - start
    words = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))  # 8 bytes from each place on

    def steps(live: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        for at in range(0, HASHED, 8):
            if not len(live):
                return
            rest = size[live] - at
            yield live, at, MASKS[np.minimum(rest, 8)]
            live = live[rest > 8]

    key = size.astype(np.uint64)
    for live, at, mask in steps(np.arange(len(size))):
        key[live] = mixed((key[live] ^ (words[start[live] + at] & mask)) * np.uint64(0x9E3779B97F4A7C15))
    which = pa.array(key).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.empty(int(which.max()) + 1 if len(which) else 0, np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)  # of places of one key the last that is written, the first, stays
    same = first[which]
    other = np.nonzero(same != np.arange(len(same)))[0]
    differ = bool((size[other] != size[same[other]]).any())
    if not differ:
        for live, at, mask in steps(other):
            differ = differ or bool((((words[start[live] + at] ^ words[start[same[live]] + at]) & mask) != 0).any())
        long = other[size[other] > HASHED].tolist()
        differ = differ or any(raw[start[i] : stop[i]] != raw[start[same[i]] : stop[same[i]]] for i in long)
    if differ:  # told apart by their bytes
        named: dict[bytes, int] = {}
        which = np.array([named.setdefault(raw[i:j], len(named)) for i, j in zip(start.tolist(), stop.tolist(), strict=True)], np.int64)
        first = np.unique(which, return_index=True)[1]
    return first, which


class PieceEncoder:
    """Ids of whole texts. Pieces of many texts are cut and told apart by numpy; Python sees distinct ones only.

    The usual byte-level pre-tokenizer always begins anew before a blank that something visible follows, between a
    Latin-1 letter and an ASCII mark, and on both sides of a single line end. Apostrophes and characters of added tokens
    are no marks here. For any other pre-tokenizer a text is one piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added, pre = spec["added_tokens"], spec["pre_tokenizer"] or {}
        self.cuts = (
            not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added)
        )
        self.words = self.cuts and not any(t["content"].isalpha() for t in added)
        self.mark = GRAPHIC & ~LETTER & np.array([not chr(i).isdigit() and chr(i) not in "'" + "".join(t["content"] for t in added) for i in range(256)])
        vocab = self.library.get_vocab()
        # tokens that begin with a blank, and bytes of each token (a character of the byte-level alphabet is a byte)
        self.opens, self.bytes = np.zeros(max(vocab.values()) + 1, bool), np.zeros(max(vocab.values()) + 1, np.int64)
        ids = np.fromiter(vocab.values(), np.int64, len(vocab))
        self.opens[ids], self.bytes[ids] = [t.startswith("\u0120") for t in vocab], [len(t) for t in vocab]
        for t in added:
            self.bytes[t["id"]] = len(t["content"].encode())
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def starts(self, x: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
        """Where pieces begin; doc_start are the places of texts that aren't empty."""
        cut = np.zeros(len(x), bool)
        if self.cuts and len(x) > 1:
            cut[:-1] = (x[:-1] == 32) & VISIBLE[x[1:]]
            first, mark = LETTER[x], self.mark[x]
            last = first.copy()
            two = np.nonzero((x[:-1] == 0xC3) & SECOND[x[1:]])[0]  # letters from U+00C0 to U+00FF
            first[two] = last[two + 1] = True
            cut[1:] |= (last[:-1] & mark[1:]) | (mark[:-1] & first[1:])
            plain = LETTER[x] | mark
            end = np.nonzero((x[1:-1] == 10) & plain[:-2] & plain[2:])[0] + 1
            cut[end] = cut[end + 1] = True
        cut[doc_start] = True
        return np.nonzero(cut)[0]

    def encode(self, new: list[bytes]) -> None:
        """Pieces with one blank, at their beginning, are encoded in one text and told apart by it. Of these, a blank and
        ASCII letters are one word to the pre-tokenizer, so the model gets them as they are, in its own alphabet."""
        rest, words, joined = [], [], []
        for p in new:
            if not self.cuts or p[:1] != b" " or len(p) < 2:
                rest.append(p)
            elif self.words and p[1:].isalpha():
                words.append(p)
            else:
                (joined if p.count(b" ") == 1 and VISIBLE[p[1]] else rest).append(p)
        for library, text, pieces in (self.plain, b"".join(words).decode().replace(" ", " \u0120")[1:], words), (self.library, b"".join(joined).decode("utf-8", "surrogatepass"), joined):
            if not pieces:
                continue
            ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at, size, asked = np.nonzero(self.opens[ids])[0], self.bytes[ids], np.array([len(p) for p in pieces])
            if np.array_equal((np.cumsum(size) - size)[at], np.cumsum(asked) - asked):  # they begin where the pieces do
                raw, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
                self.known.update(zip(pieces, [raw[i:j] for i, j in zip((4 * at).tolist(), ends, strict=True)], strict=True))
            else:
                rest += pieces
        for p, e in zip(rest, self.library.encode_batch_fast([p.decode("utf-8", "surrogatepass") for p in rest], add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, "<u4").tobytes()

    def batch(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each), each text with the end id."""
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(r) for r in raws], np.int64)
        raw = b"".join(raws)
        start = self.starts(np.frombuffer(raw, np.uint8), (np.cumsum(sizes) - sizes)[sizes > 0])
        stop = np.append(start[1:], len(raw)) if len(start) else start
        first, which = distinct(raw, start, stop)
        pieces = [raw[i:j] for i, j in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
        if len(self.known) >= REMEMBERED or self.held >= REMEMBERED_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        known = self.known
        got = list(map(known.get, pieces))
        lacked = [i for i, g in enumerate(got) if g is None]
        if lacked:
            new = [pieces[i] for i in lacked]
            before = list(map(self.older.get, new))
            known.update((p, g) for p, g in zip(new, before, strict=True) if g is not None)
            self.encode([p for p, g in zip(new, before, strict=True) if g is None])
            of_new = [known[p] for p in new]
            for i, g in zip(lacked, of_new, strict=True):
                got[i] = g
            self.held += sum(map(len, new)) + sum(map(len, of_new))
        # ids of distinct pieces, one after the other, and where each occurrence takes its own
        flat = np.frombuffer(b"".join(got), "<u4")
        length = np.fromiter(map(len, got), np.int64, len(got)) // 4
        offset = np.cumsum(length) - length
        n = length[which]
        per_doc = np.bincount(np.searchsorted(np.cumsum(sizes), start, side="right"), n, minlength=len(texts)).astype(np.int64)
        extra = 0 if end_id is None else 1
        total = int(n.sum())
        out = np.full(total + extra * len(texts), end_id or 0, "<u4")
        own = flat[np.repeat(offset[which] - (np.cumsum(n) - n), n) + np.arange(total)]
        if extra:
            inner = np.ones(len(out), bool)
            inner[np.cumsum(per_doc + 1) - 1] = False
            out[inner] = own
        else:
            out[:] = own
        return out, per_doc + extra


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids (with the end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for whole in batches:
            texts = [t or "" for t in whole.column("text").to_pylist()]
            group = np.cumsum([len(t) for t in texts]) // TOGETHER
            for g in np.unique(group).tolist():
                at = np.nonzero(group == g)[0]
                ids, n = e.batch(texts[at[0] : at[-1] + 1], end_id)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([whole.column("doc_id").slice(int(at[0]), len(at)), lists], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def write_tokens(docs: DataFrame, target: str, path: str, end_id: int) -> None:
    """Files of ascending doc_id ranges below target."""
    files = max(1, -(-text_bytes(docs) // FILE_BYTES))
    ordered = docs.select("doc_id", "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    rows = encode(ordered, path, end_id).select(F.monotonically_increasing_id().alias("seq"), "doc_id", "ids")
    rows.write.mode("overwrite").options(**ORC).orc(target)


def read_tokens(spark: SparkSession, target: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows, or only those of some documents: stripes without them are skipped by their statistics and filters."""
    rows = spark.read.orc(target)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def checked(rows: DataFrame) -> DataFrame:
    """seq, doc_id, n_tokens, ids_crc32 of stored rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at = lists.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(flat[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("seq"), b.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["seq", "doc_id", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("seq", "doc_id", "ids").mapInArrow(run, f"seq bigint, doc_id {kind}, n_tokens bigint, ids_crc32 bigint")


def token_index(rows: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32. Files start where those before them end; only their totals meet in one task."""
    slim = ws.save(checked(rows).withColumn("part", F.shiftright("seq", 33)), "read-back")
    totals = slim.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    # a row for each file; rows lie by file already, so they meet where they are, however many files there are
    return slim.withColumn("inside", inside).join(before, "part").select("doc_id", (F.col("before") + F.col("inside")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")


def token_files(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    ws = Workspace(spark, "token-orc")
    write_tokens(docs, ws.path("tokens"), path, end_id)
    ws.release()
    return token_index(read_tokens(spark, ws.path("tokens")), ws)
