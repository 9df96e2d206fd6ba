"""Files below a root, listed and opened by tasks.

Spark's own reader keeps the whole listing of a tree in the driver, some hundred bytes for each file. Here tasks list
folders, level by level: names go to a table, and folders among them are what the next round lists; so the driver holds
none of them. What Spark's reader takes for hidden (names that begin with _ or .) is left out here as well. Roots with
wildcards, and stores that pyarrow doesn't know, are read by Spark's reader, which passes over files of no bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .tables import ARROW, Folder, Tables, bound_batches, pack_small_files

#: Bytes that opening a file counts for.
OPENING = 16 << 10
LISTED = "path string, folder boolean, size bigint, time timestamp"
#: Names in one batch of a listing, and bytes of files in one batch of contents; a longer file is alone.
NAMES, BYTES = 10_000, int(ARROW["spark.sql.execution.arrow.maxBytesPerBatch"].rstrip("m")) << 20


def known(root: str) -> bool:
    """Whether pyarrow reaches the store of root."""
    try:
        fs.FileSystem.from_uri(root)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def hidden(name: str) -> bool:
    """As Spark's reader says."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def inside(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, whether it is a folder, size, time in milliseconds) of what lies in folder; links are followed."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:  # one by one, as a folder may have millions
            for e in found:
                try:
                    s = e.stat()
                except FileNotFoundError:
                    continue
                yield e.name, e.is_dir(), s.st_size, s.st_mtime_ns // 1_000_000
    else:
        for i in system.get_file_info(fs.FileSelector(folder)):
            yield i.base_name, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1_000_000


def lister(base: str, pattern: str):
    """mapInArrow function: folders (path) to what lies in them; of files only those whose name matches."""
    schema = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("time", pa.timestamp("us", "UTC"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(base)
        matches = re.compile(pattern).fullmatch
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [(), (), (), ()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            for folder in b.column("path").to_pylist():
                for name, is_folder, size, time in inside(system, root + folder[len(base) :]):
                    if not hidden(name) and (is_folder or matches(name)):
                        held.append((f"{folder}/{name}", is_folder, size, time * 1000))
                        if len(held) == NAMES:
                            yield out()
        yield out()

    return run


def opener(base: str):
    """mapInArrow function: rows (path, size, and others) with the content of their files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(base)
        for b in batches:
            paths, texts, held, start = b.column("path").to_pylist(), [], 0, 0
            for i, path in enumerate(paths):
                with system.open_input_stream(root + path[len(base) :]) as f:
                    texts.append(f.read())
                held += len(texts[-1])
                if held >= BYTES or i + 1 == len(paths):
                    yield pa.RecordBatch.from_arrays([*b.slice(start, i + 1 - start).columns, pa.array(texts, pa.binary())], names=[*b.schema.names, "content"])
                    texts, held, start = [], 0, i + 1

    return run


class Tree:
    """names: (path, size, time) of files below root whose name matches glob; a path begins as root was given. Runs a
    job for each level of folders."""

    def __init__(self, spark: SparkSession, root: str, glob: str):
        self.spark, self.base = spark, root.rstrip("/")
        self.own = not re.search(r"[*?\[{]", self.base) and known(self.base) and Folder(spark, self.base).is_folder()
        pack_small_files(spark)
        bound_batches(spark)
        if self.own:
            self.names = self.walked(spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern.compile(glob).pattern())
        else:
            self.files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(self.base)
            self.names = self.files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("time"))

    def walked(self, pattern: str) -> DataFrame:
        tables, levels = Tables(self.spark, "tree"), []
        todo = self.spark.createDataFrame([(self.base,)], "path string").coalesce(1)
        while True:
            levels.append(tables.path(f"level-{len(levels)}"))
            seen = tables.save(todo.mapInArrow(lister(self.base, pattern), LISTED), f"level-{len(levels) - 1}")
            folders = seen.filter("folder").select("path")
            if not folders.limit(1).count():
                return self.spark.read.schema(LISTED).parquet(*levels).filter("not folder").select("path", "size", "time")
            todo = folders.repartition(2 * self.spark.sparkContext.defaultParallelism, "path")

    def contents(self, rows: DataFrame) -> DataFrame:
        """rows (path and size, as names has them, and whatever else) with content. Files are dealt out to tasks by their
        number and size."""
        if not self.own:
            return rows.join(self.files.select("path", "content"), "path").select(*rows.columns, "content")
        total = rows.agg(F.sum(F.col("size") + OPENING)).first()[0] or 0
        each = self.spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-total // each))
        schema = StructType([*rows.schema.fields, StructField("content", BinaryType())])
        return rows.repartition(tasks, "path").mapInArrow(opener(self.base), schema)
