"""What the operators share: the shared folder, materialised steps, text helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows and bytes in one Arrow batch; texts may be long, so far fewer than Spark's defaults.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


_own_root: str | None = None
#: Rows and bytes of text that an operator's Python code works on at once; a longer text is alone.
SLICE_ROWS, SLICE_BYTES = 200, 2_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it a session in one JVM, as in tests,
    gets a temporary folder; on a cluster that would lose data, so it is an error."""
    global _own_root
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="spark-llm-")
    return _own_root


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of bounded rows and bytes of text."""
    for b in batches:
        own = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(own)
        start = 0
        while start < b.num_rows:
            stop = int(np.searchsorted(ends, ends[start] - own[start] + size, side="right"))
            stop = max(start + 1, min(stop, start + rows))
            yield b.slice(start, stop - start)
            start = stop


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches for the session. They have to hold when a result is computed, so they stay set."""
    for k, v in ARROW.items():
        spark.conf.set(k, v)


class Workspace:
    """Named Parquet tables of one run below the shared folder. They cut lineage and survive lost executors."""

    #: Workspaces whose tables still stand.
    open: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession, label: str):
        Workspace.open.append(self)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        bound_batches(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *partition_by: str, codec: str = "zstd") -> DataFrame:
        """Write df once and return the table read back."""
        writer = df.write.mode("overwrite").option("compression", codec)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name))
        schema = df.schema
        del df, writer
        self.release()
        return self.spark.read.schema(schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark's context cleaner drop shuffle files of steps that have been written."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            self.delete(self.path(name))

    def close(self) -> None:
        """Delete all tables: whatever was made of them has to have been written elsewhere."""
        self.delete(self.root)
        Workspace.open.remove(self)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, from which partition counts follow."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; lower() would change other letters as well, so it serves pure ASCII alone."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())).otherwise(F.lower(text))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
