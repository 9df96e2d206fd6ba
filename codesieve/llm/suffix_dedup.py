"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts in an earlier document go.

1. A window of 50 bytes has one anchor: the least hash among its 25 strings of 26 bytes. Equal windows have equal
   anchors, so windows whose anchor no document of other content has can't repeat. Anchors are counted over all documents.
2. Windows that follow each other under one anchor make a context (some 75 bytes). Contexts under shared anchors are
   packed, those that are equal in a chunk once, and meet in the bucket of their anchor. Windows under an anchor that
   very many contents have are contexts of their own, so that no bucket gathers what one anchor has in the whole corpus.
3. Equal contexts of a bucket become one. Where an anchor has several, their suffixes are sorted: multikey sorting by
   words of 8 bytes to a shallow depth of 32, then blind tries for suffixes that still agree. Suffixes that agree in 50
   bytes are one string; the smallest doc_id among them is its first. All of this compares bytes, not hashes.
4. Windows with an earlier first doc_id are removed. Equal texts are known by their MD5 digest.

Defined cases: a null or short text is no string and stays; equal texts: all but the smallest doc_id's go whole if they
have `length` bytes; rows that repeat a doc_id don't remove each other; rows without doc_id neither remove nor lose
bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices, text_bytes
from .fingerprints import BLOCKS, COLUMNS, DOCUMENTS, ONE, block_table, bucket_count, buckets_of, cuts, heads, shared_fingerprints
from .rolling import mixed, prefix_sums

LENGTH, GRAM = 50, 26
SHALLOW = 32
#: Windows of one context at most, contexts sorted together, contents with an anchor beyond which its windows go alone.
RUN, TOGETHER, HEAVY = 64, 4000, 20_000
#: Bytes of contexts in a chunk, and in a bucket.
CHUNK_BYTES = 6_000_000


def window_anchors(raw: bytes) -> np.ndarray:
    """The anchor of each window of LENGTH bytes, hashed once more: least hashes crowd at the low end, buckets are ranges."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.uint64)
    sums, down = prefix_sums(np.frombuffer(raw, np.uint8))
    h = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    wide, width = h, 1
    while 2 * width <= LENGTH - GRAM + 1:
        wide = np.minimum(wide[:-width], wide[width:])
        width *= 2
    rest = LENGTH - GRAM + 1 - width
    return mixed(np.minimum(wide[:-rest], wide[rest:]) if rest else wide)


def extract(texts: list) -> list[tuple[int, bytes, np.ndarray]]:
    out = []
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        m = window_anchors(raw)
        m = np.sort(m[np.concatenate([[True], m[1:] != m[:-1]])]) if len(m) else m
        out.append((len(raw), hashlib.md5(raw).digest(), m[np.concatenate([[True], m[1:] != m[:-1]])] if len(m) else m))
    return out


INFO = np.dtype([("low", "<i8"), ("high", "<i8"), ("size", "<u4")])
OWNER = np.dtype([("doc", "<i8"), ("mark", "V8")])
PLACE = np.dtype([("entry", "<u4"), ("owner", "<u4"), ("begin", "<u4")])
RUN_OF = np.dtype([("start", "<u2"), ("windows", "<u2")])
SPAN = np.dtype([("begin", "<i4"), ("windows", "<i4")])


def contexts_of(raw: bytes, prints: np.ndarray, n_heavy: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, begin, windows) of a text's contexts under the asked anchors. Windows under a heavy one, that is one that
    very many contents have, stand alone, under a key of their own; so no key gathers what grows with the corpus."""
    sums, down = prefix_sums(np.frombuffer(raw, np.uint8))
    m = window_anchors(raw)
    new = heads(m)
    head = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
    new |= (np.arange(len(m)) - head) % RUN == 0
    at = np.nonzero(new)[0]
    n = np.diff(np.append(at, len(m)))
    key = m[at]

    def among(asked: np.ndarray) -> np.ndarray:
        asked = np.sort(asked)
        return asked[np.minimum(np.searchsorted(asked, key), len(asked) - 1)] == key if len(asked) else np.zeros(len(key), bool)

    hot, rest = among(prints[:n_heavy]), among(prints[n_heavy:])
    begin = np.repeat(at[hot] - (np.cumsum(n[hot]) - n[hot]), n[hot]) + np.arange(n[hot].sum())
    alone = mixed((sums[begin + LENGTH] - sums[begin]) * down[begin])
    return np.concatenate([key[rest], alone]), np.concatenate([at[rest], begin]), np.concatenate([n[rest], np.ones(len(begin), np.int64)])


def contexts(n_buckets: int):
    """mapInArrow function: contexts of (doc_id, mark, text, n_heavy, prints), packed for the buckets of their keys.

    Equal contexts of a chunk go to their bucket once, with the smallest and largest doc_id that has them; the chunk
    keeps who has them where."""

    def flush(chunk: int, owners: list, held: list) -> pa.RecordBatch:
        raw = b"".join(h[0] for h in held)
        n = [len(h[1]) for h in held]
        owner = np.repeat(np.arange(len(held)), n)
        key, begin, windows = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
        start = begin + np.repeat(np.cumsum([0, *[len(h[0]) for h in held][:-1]]), n)
        named: dict[bytes, int] = {}
        which = np.array([named.setdefault(raw[i:j], len(named)) for i, j in zip(start.tolist(), (start + windows + LENGTH - 1).tolist(), strict=True)], np.int64)
        first = np.unique(which, return_index=True)[1]
        order = np.argsort(key[first], kind="stable")
        entry = np.argsort(order)[which]
        doc = np.array([o[0] for o in owners], np.int64)[owner]
        info = np.zeros(len(named), INFO)
        info["low"], info["high"] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        np.minimum.at(info["low"], entry, doc)
        np.maximum.at(info["high"], entry, doc)
        texts = list(named)
        texts = [texts[i] for i in order.tolist()]
        info["size"] = [len(t) for t in texts]
        keys = key[first][order]
        rows = []
        for b, part in cuts(buckets_of(keys, n_buckets)):
            rows.append((b, ONE, keys[part].astype("<u8").tobytes(), info[part].tobytes(), b"".join(texts[part])))
        place = np.zeros(len(owner), PLACE)
        place["entry"], place["owner"], place["begin"] = entry, owner, begin
        rows.append((n_buckets + chunk % n_buckets, DOCUMENTS, b"".join(int(d).to_bytes(8, "little", signed=True) + m for d, m in owners), place.tobytes(), b""))
        return block_table(chunk, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, owners, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in slices(batches):
            for doc, mark, text, n_heavy, prints in zip(*(b.column(c).to_pylist() for c in ("doc_id", "mark", "text", "n_heavy", "prints")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                found = contexts_of(raw, np.frombuffer(prints, "<u8"), n_heavy)
                owners.append((doc, mark))
                held.append((raw, *found))
                size += len(raw) // 4 + int(found[2].sum()) + LENGTH * len(found[2])
                if size >= CHUNK_BYTES:
                    yield flush(chunk, owners, held)
                    chunk, owners, held, size = chunk + 1, [], [], 0
        if held:
            yield flush(chunk, owners, held)

    return run


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number that sorts as they do; data ends in padding."""
    out = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[i : len(data) - 7 + i].astype(np.uint64)
    return out


def multikey(at: np.ndarray, words: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first `limit` bytes, group of each): multikey sort, a word of 8 bytes at a time. Each
    round parts the groups that still have more than one suffix by their next word, all of them at once."""
    group = np.zeros(len(at), np.int64)
    for depth in range(0, limit, 8):
        counts = np.bincount(group)
        open_ = np.nonzero(counts[group] > 1)[0]
        if not len(open_):
            break
        key = words[at[open_] + depth]
        order = np.lexsort((key, group[open_]))
        at[open_] = at[open_][order]  # groups lie side by side, so their places stay theirs
        key = key[order]
        new = np.ones(len(at), bool)
        new[1:] = group[1:] != group[:-1]
        inner = np.zeros(len(open_), bool)
        inner[1:] = (key[1:] != key[:-1]) & (group[open_][1:] == group[open_][:-1])
        new[open_] |= inner
        group = np.cumsum(new) - 1
    return at, group


def blind_trie(at: list[int], data: bytes, depth: int, length: int) -> list[list[int]]:
    """Groups of suffixes that agree from depth to length, in order. Inner nodes know only where they branch."""
    root: list | None = None  # leaf: [text, members]; inner node: [position, {byte: child}, None]
    for p in at:
        text = data[p + depth : p + length]
        if root is None:
            root = [text, [p]]
            continue
        node = root
        while len(node) == 3:  # blind descent
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == text:
            node[1].append(p)
            continue
        lcp = next(i for i, (x, y) in enumerate(zip(other, text)) if x != y)
        parent, node = None, root
        while len(node) == 3 and node[0] < lcp:
            parent, node = node, node[1][text[node[0]]]
        if len(node) == 3 and node[0] == lcp:
            node[1][text[lcp]] = [text, [p]]
            continue
        split = [lcp, {other[lcp]: node, text[lcp]: [text, [p]]}, None]
        if parent is None:
            root = split
        else:
            parent[1][text[parent[0]]] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if len(node) == 2:
            out.append(node[1])
        else:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def equal_groups(data: bytes, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, group of each): groups agree in `length` bytes."""
    words = words_at(np.frombuffer(data + bytes(16), np.uint8))
    at, group = multikey(at.copy(), words, SHALLOW)
    head = np.concatenate([[True], group[1:] != group[:-1]])
    start = np.nonzero(head)[0]
    first = at[start][group]
    differs = np.zeros(len(at), bool)
    for d in (*range(SHALLOW, length - 7, 8), length - 8):
        differs |= words[at + d] != words[first + d]
    mixed_groups = np.nonzero(np.logical_or.reduceat(differs, start))[0]
    ends = np.append(start[1:], len(at))
    for i, j in zip(start[mixed_groups].tolist(), ends[mixed_groups].tolist(), strict=True):
        where = i
        for members in blind_trie(at[i:j].tolist(), data, SHALLOW, length):
            at[where : where + len(members)] = members
            head[where] = True
            where += len(members)
    return at, np.cumsum(head) - 1


def window_firsts(texts: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest doc_id of each window of the contexts, windows of each context), by sorting their suffixes together."""
    sizes = np.array([len(t) for t in texts])
    n = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(texts)), n)
    at = (np.cumsum(sizes) - sizes)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    doc = np.zeros(int(sizes.sum()), np.int64)
    doc[at] = first[owner]
    least = doc.copy()
    order, group = equal_groups(b"".join(texts), at)
    least[order] = np.minimum.reduceat(doc[order], np.nonzero(heads(group))[0])[group]
    return least[at], n


def spread(counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places offsets[i] to offsets[i] + counts[i] for each i in turn."""
    return np.repeat(offsets - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def lost_windows(keys: np.ndarray, info: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a bucket's entries: number of runs of windows that some document of the entry loses, (start, windows) of each
    run, and the doc_id that has them first."""
    named: dict[bytes, int] = {}
    which = np.array([named.setdefault(t, len(named)) for t in texts], np.int64)  # equal contexts are one
    first = np.full(len(named), np.iinfo(np.int64).max)
    np.minimum.at(first, which, info["low"])
    key = keys[np.unique(which, return_index=True)[1]]
    order = np.argsort(key, kind="stable")
    new = heads(key[order])
    group = np.cumsum(new) - 1
    contested = order[np.bincount(group)[group] > 1]
    unlike = list(named)
    # a run for each context, or as many as its windows have different first documents
    n_runs = np.ones(len(named), np.int64)
    begins, sizes, leasts = [np.zeros(len(named), np.int64)], [np.array([len(t) - LENGTH + 1 for t in unlike])], [first]
    offsets, used = np.arange(len(named)), len(named)
    start = np.nonzero(heads(key[contested]))[0]
    bounds = [*start[heads(start // TOGETHER)].tolist(), len(contested)]  # groups stay whole
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        now = contested[i:j]
        least, n = window_firsts([unlike[k] for k in now.tolist()], first[now])
        owner = np.repeat(np.arange(len(now)), n)
        start = np.nonzero(heads(least) | heads(owner))[0]
        begins.append((np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))[start])
        sizes.append(np.diff(np.append(start, len(owner))))
        leasts.append(least[start])
        n_runs[now] = np.bincount(owner[start], minlength=len(now))
        offsets[now] = used + np.cumsum(n_runs[now]) - n_runs[now]
        used += len(start)
    begin, size, least = map(np.concatenate, (begins, sizes, leasts))
    entry = np.repeat(np.arange(len(which)), n_runs[which])
    at = spread(n_runs[which], offsets[which])
    keep = least[at] < info["high"][entry]
    at, entry = at[keep], entry[keep]
    out = np.zeros(len(at), RUN_OF)
    out["start"], out["windows"] = begin[at], size[at]
    return np.bincount(entry, minlength=len(which)), out, least[at]


def judge(n_buckets: int):
    """applyInArrow function of a bucket: blocks of contexts to blocks of what their documents lose."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= n_buckets:
            return table
        a, b, c = (table.column(x).to_pylist() for x in "abc")
        infos = [np.frombuffer(x, INFO) for x in b]
        texts: list[bytes] = []
        for raw, info in zip(c, infos, strict=True):
            end = np.cumsum(info["size"].astype(np.int64))
            texts += [raw[i:j] for i, j in zip((end - info["size"]).tolist(), end.tolist(), strict=True)]
        counts, found, least = lost_windows(np.concatenate([np.frombuffer(x, "<u8") for x in a]), np.concatenate(infos), texts)
        out, entry, at = [], 0, 0
        for info in infos:
            own = counts[entry : entry + len(info)]
            entry, stop = entry + len(info), at + int(own.sum())
            out.append((own.astype("<u4").tobytes(), found[at:stop].tobytes(), least[at:stop].astype("<i8").tobytes()))
            at = stop
        return pa.Table.from_arrays([table.column("chunk"), table.column("bucket"), table.column("kind"), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], names=COLUMNS)

    return run


def collect_spans(table: pa.Table) -> pa.Table:
    """applyInArrow function of a chunk: (doc_id, mark, spans) of documents that lose windows."""
    counts, found, least = [np.zeros(0, "<u4")], [np.zeros(0, RUN_OF)], [np.zeros(0, "<i8")]
    for _, kind, a, b, c in sorted(zip(*(table.column(x).to_pylist() for x in COLUMNS[1:]), strict=True), key=lambda r: r[:2]):
        if kind == DOCUMENTS:
            owners, place = np.frombuffer(a, OWNER), np.frombuffer(b, PLACE)
        else:
            counts.append(np.frombuffer(a, "<u4"))
            found.append(np.frombuffer(b, RUN_OF))
            least.append(np.frombuffer(c, "<i8"))
    n, found, least = np.concatenate(counts).astype(np.int64), np.concatenate(found), np.concatenate(least)
    own = n[place["entry"]]
    at = spread(own, (np.cumsum(n) - n)[place["entry"]])
    place = np.repeat(place, own)
    lost = least[at] < owners["doc"][place["owner"]]
    at, place = at[lost], place[lost]
    spans = np.zeros(len(at), SPAN)
    spans["begin"], spans["windows"] = place["begin"] + found["start"][at].astype(np.int64), found["windows"][at]
    order = np.argsort(place["owner"], kind="stable")
    owner, spans = place["owner"][order], spans[order]
    start = np.nonzero(heads(owner))[0] if len(owner) else np.zeros(0, np.int64)
    who = owners[owner[start]]
    packed = [spans[i:j].tobytes() for i, j in zip(start.tolist(), [*start[1:].tolist(), len(spans)], strict=True)] if len(start) else []
    return pa.Table.from_arrays([pa.array(who["doc"], pa.int64()), pa.array([m.tobytes() for m in who["mark"]], pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "mark", "spans"])


def strip(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[bytes, int]:
    """What is left of raw without the spans, and the number of maximal removed runs."""
    gone = np.bincount(begin, minlength=len(raw) + 1) - np.bincount(end, minlength=len(raw) + 1)
    gone = np.cumsum(gone[:-1]) > 0
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return kept, int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].any())


def remover(b: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for text, whole, spans in zip(*(b.column(c).to_pylist() for c in ("text", "whole", "spans")), strict=True):
        raw = (text or "").encode("utf-8", "surrogatepass")
        kept, n = raw, 0
        if whole and len(raw) >= LENGTH:
            kept, n = b"", 1
        elif spans:
            own = np.frombuffer(spans, SPAN)
            kept, n = strip(raw, own["begin"], own["begin"] + own["windows"] + LENGTH - 1)
        rows.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
    n, removed, spans, kept = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def content_id(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def repeated_spans(docs: DataFrame, ws: Workspace, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, spans) of documents that lose windows, and (content, original) of each text's smallest doc_id."""
    present = docs.filter("doc_id is not null")
    n_buckets = bucket_count(text_bytes(docs))
    table = ws.save(shared_fingerprints(present, n_buckets, extract, lambda size, n: n > 0, heavy), "anchors")
    originals = ws.save(table.groupBy("content").agg(F.min("doc_id").alias("original")), "originals")
    # of equal texts only the first is searched; the others go whole
    wanted = ws.save(table.filter("prints is not null").join(originals.withColumnRenamed("content", "c"), (F.col("content") == F.col("c")) & (F.col("doc_id") == F.col("original"))).select("doc_id", F.substring("content", 1, 8).alias("mark"), "n_heavy", "prints"), "wanted")
    ws.drop("anchors")
    n_bytes = wanted.agg(F.sum(F.length("prints") + (RUN - 1) * 8 * F.col("n_heavy"))).first()[0] or 0  # 8 for a context
    n_buckets = bucket_count(n_bytes * 10, 16, CHUNK_BYTES)
    texts = present.select("doc_id", "text").withColumn("mark", F.substring(content_id(F.col("text")), 1, 8))
    made = texts.join(wanted, ["doc_id", "mark"]).select("doc_id", "mark", "text", "n_heavy", "prints").mapInArrow(contexts(n_buckets), BLOCKS)
    judged = made.groupBy("bucket").applyInArrow(judge(n_buckets), BLOCKS)
    return ws.save(judged.groupBy("chunk").applyInArrow(collect_spans, "doc_id bigint, mark binary, spans binary"), "spans"), originals


def suffix_dedup(spark: SparkSession, docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    ws = Workspace(spark, "suffix-dedup")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spans, originals = repeated_spans(docs, ws, heavy)
    named = docs.withColumn("content", content_id(F.col("text")))
    copies = originals.withColumnRenamed("content", "c")
    table = ws.save(named.select("doc_id", "content").distinct().join(copies, F.col("content") == F.col("c")).filter("doc_id > original").select("doc_id", F.substring("content", 1, 8).alias("mark"), F.lit(True).alias("whole")), "copies")
    marked = table.join(spans, ["doc_id", "mark"], "full")
    rows = named.select("doc_id", "text", F.substring("content", 1, 8).alias("mark")).join(marked, ["doc_id", "mark"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield remover(b)

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
