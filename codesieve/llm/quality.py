"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics are counted by numpy for each Arrow batch. Trees are grown level by level on binned values of a bounded
sample of labelled rows (`SAMPLE_ROWS`), then flattened into arrays that whole batches walk at once. Labels, lang,
source and doc_id are no inputs; doc_id only says which rows are held out.

Defined cases: a null or empty text has all-zero statistics and gets a score; label rows without a document, with a null
label or repeated are left out or counted once (the least label stands); no labels, or one class: every score is the
share of good labels, 1 without any; repeated and null doc_ids get a score each; other columns are ignored, and kept by
`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: Labelled rows that the trees are grown on, at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 80, 4, 64, 0.15, 10
THRESHOLD = 0.7
NAMES = ("log_bytes", "log_words", "mean_word", "long_words", "upper", "digits", "spaces", "punctuation", "symbols", "high_bytes", "full_stops", "commas", "pipes", "bangs", "hashes", "line_ends", "distinct_words", "top_word", "repeated_next", "distinct_lines", "mean_line", "byte_entropy", "marked_words", "capital_words", "stops_per_line", "angles", "slashes", "markup", "distinct_pairs", "nonprinting")


def classes() -> np.ndarray:
    """Byte classes as rows of 0 and 1: upper case, digit, space, punctuation, other symbol, non-ASCII, control."""
    out = np.zeros((7, 256))
    for i in range(256):
        c = chr(i)
        k = 5 if i >= 128 else 0 if "A" <= c <= "Z" else 1 if c.isdigit() else 2 if c in " \t\n\r\x0b\x0c" else 3 if c in ".,;:!?'\"()-" else 6 if i < 32 or i == 127 else None if c.isalpha() else 4
        if k is not None:
            out[k, i] = 1
    return out


CLASSES = classes()


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = (CLASSES @ hist) / n
    words = raw.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()] or [b""]
    p = hist[hist > 0] / n
    per = hist / n
    following = sum(map(bytes.__eq__, words[1:], words[:-1]))
    marked = sum(not (48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or 97 <= w[-1] <= 122 or w[-1] >= 128) for w in words)
    capital = sum(65 <= w[0] <= 90 for w in words)
    stop = per[46] + per[33] + per[63]
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()) if len(words) else 0.0, float((lengths > 12).mean()) if len(words) else 0.0,
        *kind[:6].tolist(), float(per[46]), float(per[44]), float(per[124]), float(per[33]), float(per[35]), float(per[10]),
        len(counts) / m, max(counts.values(), default=0) / m, following / m, len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), float(-(p * np.log2(p)).sum()),
        marked / m, capital / m, float(stop * n / len(lines)), float(per[60] + per[62]), float(per[47] + per[92]), float(per[123] + per[125] + per[61] + per[59]),
        len(set(zip(words, words[1:]))) / m, float(kind[6]),
    ]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(NAMES))


@dataclass
class Forest:
    """Trees as arrays: node i splits on feature[i] at threshold[i] and goes to left[i] or left[i] + 1; leaves stay."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                inner = self.left[at] >= 0
                step = self.left[at] + (x[rows, self.feature[at]] > self.threshold[at])
                at = np.where(inner, step, at)
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = LEAST, l2: float = 1.0) -> Forest:
    """Boosted trees for logistic loss; each level sums gradients in one histogram of (node, feature, bin)."""
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 1 - 1e-4
    empty = Forest(float(np.log(mean / (1 - mean))), *[np.zeros(0, int)] * 2, np.zeros(0), np.zeros(0, int), np.zeros(0), depth)
    if not len(y) or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    n, m = x.shape
    roots, feature, threshold, left, value = [], [], [], [], []
    margin = np.full(n, empty.base)
    cells = binned + np.arange(m) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(feature))
        nodes, at = [len(feature)], np.zeros(n, np.int64)
        feature.append(0), threshold.append(0.0), left.append(-1), value.append(0.0)
        for level in range(depth + 1):
            k = len(nodes)
            active = np.nonzero(at >= 0)[0]
            flat = (cells[active] + at[active, None] * (m * bins)).ravel()
            hist = [np.bincount(flat, np.repeat(w[active], m), k * m * bins).reshape(k, m, bins).cumsum(2) for w in (g, h, np.ones(n))]
            tg, th, tn = (a[:, :, -1:] for a in hist)
            gain = hist[0] ** 2 / (hist[1] + l2) + (tg - hist[0]) ** 2 / (th - hist[1] + l2) - tg**2 / (th + l2)
            gain[(hist[2] < least) | (tn - hist[2] < least)] = -1
            to = np.full(k, -1)
            new = []
            for i, node in enumerate(nodes):
                best = int(gain[i].argmax())
                f, b = divmod(best, bins)
                value[node] = float(-rate * tg[i, 0, 0] / (th[i, 0, 0] + l2))
                if level == depth or gain[i].flat[best] <= 1e-6 or b >= len(edges[f]):
                    continue
                to[i] = len(new)
                feature[node], threshold[node], left[node] = f, float(edges[f][b]), len(feature)
                for _ in range(2):
                    new.append(len(feature))
                    feature.append(0), threshold.append(0.0), left.append(-1), value.append(0.0)
            here = at[active]
            leaf = to[here] < 0
            margin[active[leaf]] += np.array(value)[np.array(nodes)[here[leaf]]]
            go = active[~leaf]
            node = np.array(nodes)[at[go]]
            right = x[go, np.array(feature)[node]] > np.array(threshold)[node]
            child = to[at[go]] + right
            at[active[leaf]] = -1
            at[go] = child
            nodes = new
            if not nodes:
                break
    return Forest(empty.base, np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(value), depth)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Grow trees on at most sample_rows labelled rows, those with the least hash of their id."""
    ws = Workspace(spark, "quality")
    own = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality")).filter(~held_out(F.col("doc_id")))
    chosen = ws.save(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(t.as_py() for t in b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # at most sample_rows keys of 8 bytes; rows that repeat a doc_id count once, so no more rows come back
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(run, f"doc_id {kind}, quality double, x array<double>")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("r.*").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(NAMES))
    y = rows.column("quality").to_numpy()
    order = np.lexsort([*x.T, y])  # tasks end in any order; the trees shall not depend on it
    return grow(x[order], y[order])


def score(spark: SparkSession, docs: DataFrame, forest: Forest, columns: list[str] | None = None) -> DataFrame:
    """The named columns of docs and `quality_score`."""
    columns = columns or ["doc_id"]
    model = spark.sparkContext.broadcast(forest)  # some thousand nodes, set by TREES and DEPTH
    schema = docs.select(*columns).schema.add("quality_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.value.score(matrix(t.as_py() for t in b.column("text")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(s)], names=[*columns, "quality_score"])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(spark, docs, train(spark, docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs that score at least the threshold; all columns stay, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score(spark, rows, train(spark, docs, labels), ["row"]).filter(F.col("quality_score") >= threshold).select("row.*")
