r"""Importance resampling towards a target distribution, by hashed n-gram features.

Features of a text are its runs of 1 to n words, each hashed to a bucket. A bucket's gain is the logarithm of its
smoothed share among the target's features over its share among all features, in thousandths; a document's weight is
the sum over its features. Documents are drawn without replacement: a seeded Gumbel number is added to each weight and
the highest sums are taken, which is a draw in proportion to exp(weight).

Texts are skewed in length, so a long one is cut at word boundaries into chunks of bounded size that tasks share out. A
chunk owns the features that start in it, and carries the next n-1 words so that runs over its end are whole. Counts and
weights are sums over owned features, so those of a text's chunks add up to the text's. Chunks are counted in numpy; what
reaches the driver is one number for each bucket, whose count is a parameter. The drawn documents are numbered by ranges
of (score, doc_id), so no task sorts them all.

Defined cases: null and empty texts have no features, weight 0 and are never drawn where `least` is positive; ties go to
the smaller doc_id; repeated rows are documents of their own, drawn and ranked one by one; a row without doc_id counts
and is drawn like others (its seed text ends after the colon, and it comes last among ties); other columns are ignored;
an empty table gives no rows, an empty target gives every bucket its smoothed share.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, bound_batches, slices

#: Words in UTF-8: ASCII letters and digits, and every character beyond ASCII.
WORD, GAP = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of text that a chunk owns at least (its last word is whole).
CHUNK = 1 << 16
#: Features that a worker remembers with their bucket, and the longest that it does.
REMEMBERED, LONGEST = 100_000, 40


def chunks_of(text: bytes, n: int, size: int) -> Iterator[tuple[bytes, int]]:
    """(chunk, bytes of it that it owns): a text cut at word boundaries, each chunk with n-1 words of the next."""
    start = 0
    while True:
        gap = GAP.search(text, start + size)
        if gap is None:
            yield text[start:], len(text) - start
            return
        end = carried = gap.start()
        for k, m in enumerate(WORD.finditer(text, end)):
            if k == n - 1:
                break
            carried = m.end()
        yield text[start:carried], end - start
        start = end


class Features:
    """Counts of hashed features, with a bounded memory of hashes."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets, self.known = n, buckets, {}

    def bucket(self, feature: bytes) -> int:
        k = self.known.get(feature)
        if k is None:
            k = zlib.crc32(feature) % self.buckets
            if len(feature) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[feature] = k
        return k

    def of(self, chunk: bytes, own: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(words owned, buckets, how often each), for the features that start in the owned part."""
        low = chunk.lower()
        words = WORD.findall(low)
        owned = len(words) if own == len(chunk) else len(WORD.findall(low, 0, own))
        counts = Counter(words[:owned])
        for k in range(2, self.n + 1):
            counts.update(b" ".join(words[i : i + k]) for i in range(min(owned, len(words) - k + 1)))
        at = np.fromiter(map(self.bucket, counts), np.int64, len(counts))
        return owned, at, np.fromiter(counts.values(), np.int64, len(counts))


def pieces(docs: DataFrame, n: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(short texts, chunks of long texts): doc_id, text, own; chunks also have the text's digest and their number. Only
    long texts are moved, so that their chunks are shared out."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    long_ = F.octet_length("text") > size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for doc, text, digest in zip(*(b.column(c) for c in ("doc_id", "text", "digest")), strict=True):
                for k, (chunk, own) in enumerate(chunks_of(text.as_py(), n, size)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((doc.as_py(), pa.int64()), (digest.as_py(), pa.string()), (k, pa.int32()), (chunk, pa.binary()), (own, pa.int32()))], names=["doc_id", "digest", "chunk", "text", "own"])

    short = rows.filter(~F.coalesce(long_, F.lit(False))).withColumn("own", F.octet_length("text").cast("int"))
    cuts = rows.filter(long_).withColumn("digest", F.md5("text")).mapInArrow(cut, "doc_id bigint, digest string, chunk int, text binary, own int")
    return short, cuts.repartition("doc_id", "digest", "chunk")


def bucket_counts(docs: DataFrame, n: int, buckets: int, size: int = CHUNK) -> DataFrame:
    """(bucket, features): how many features of all texts fall in each bucket that has any. Each task adds up its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(n, buckets), np.zeros(buckets, np.int64)
        for b in slices(batches):
            for text, own in zip(b.column("text").to_pylist(), b.column("own").to_pylist(), strict=True):
                if text:
                    _, at, times = features.of(text, own)
                    np.add.at(total, at, times)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "features"])

    short, cuts = pieces(docs, n, size)
    return short.select("text", "own").unionByName(cuts.select("text", "own")).mapInArrow(count, "bucket int, features bigint").groupBy("bucket").agg(F.sum("features").alias("features"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, the floored thousandths of ln(target share / source share), with one added to each count."""
    s, t, k = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int, size: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of docs."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(n, buckets)
        for b in slices(batches):
            out = np.zeros((3, b.num_rows), np.int64)
            for i, (text, own) in enumerate(zip(b.column("text").to_pylist(), b.column("own").to_pylist(), strict=True)):
                if text:
                    owned, at, times = features.of(text, own)
                    out[:, i] = owned, times.sum(), times @ gain[at]
            kept = [c for c in b.schema.names if c not in ("text", "own")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, out)], names=[*kept, "n_words", "n_features", "weight"])

    short, cuts = pieces(docs, n, size)
    sums = "n_words bigint, n_features bigint, weight bigint"
    parts = cuts.mapInArrow(weigh, f"doc_id bigint, digest string, chunk int, {sums}")
    # rows that repeat a document have each of its chunks as often as they are
    copies = F.count_if(F.col("chunk") == 0)
    whole = parts.groupBy("doc_id", "digest").agg(copies.alias("copies"), *((F.sum(c) / copies).cast("bigint").alias(c) for c in ("n_words", "n_features", "weight")))
    again = whole.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc_id", "n_words", "n_features", "weight")
    return short.mapInArrow(weigh, f"doc_id bigint, {sums}").unionByName(again)


def gumbel(seed: int, doc_id: Column) -> Column:
    """Thousandths of a Gumbel number that seed and doc_id decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, buckets: int = 10_000, least: int = 20, seed: int = 2024, size: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those that aren't drawn. Of the
    documents with at least `least` words, `percent` in a hundred are drawn. target: text."""
    bound_batches(spark)
    ws = Workspace(spark, "resample")
    counts = []
    for name, rows in (("source", docs), ("target", target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"))):
        total = np.zeros(buckets, np.int64)
        for r in ws.save(bucket_counts(rows, n, buckets, size), name).collect():  # at most `buckets` rows
            total[r["bucket"]] = r["features"]
        counts.append(total)
    scored = ws.save(weights(docs, gains(*counts), n, size).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))), "scored")
    may = F.col("n_words") >= least
    drawn = scored.filter(may).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranges = ws.save(scored.filter(may).repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range_").agg(F.count(F.lit(1)).alias("rows_")).select("range_", (F.sum("rows_").over(Window.orderBy("range_")) - F.col("rows_")).alias("before_"))  # a row for each range
    placed = ranges.withColumn("inside_", F.row_number().over(Window.partitionBy("range_").orderBy(*order))).join(F.broadcast(sizes), "range_").withColumn("place", F.col("before_") + F.col("inside_"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank")).unionByName(scored.filter(~may).select(*columns, F.lit(None).cast("bigint").alias("rank")))
