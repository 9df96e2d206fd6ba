"""Steps of a job as tables in the folder that driver and executors share, and the few questions to its file system."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Rows and bytes in one Arrow batch: workers hold a batch as Python objects, and files may be long.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: What opening a file counts for when Spark deals files to tasks: with its own 4 MB a task gets 4 to 32 source files, and
#: a tree as many tasks as that makes.
SMALL_FILES = {"spark.sql.files.openCostInBytes": "64k"}


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches for the session. They have to hold when a result is computed, so they stay set."""
    for k, v in ARROW.items():
        spark.conf.set(k, v)


def pack_small_files(spark: SparkSession) -> None:
    """Many small files to a task for the session. It has to hold when a result is computed, so it stays set."""
    for k, v in SMALL_FILES.items():
        spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session in one JVM that has none gets a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-jobs-"))
    return _own[0]


class Folder:
    """A folder in whatever file system Spark reads it from. The only place that reaches into the driver's JVM."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.at = spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.system.exists(self.at)

    def is_folder(self) -> bool:
        return self.exists() and self.system.getFileStatus(self.at).isDirectory()

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.system.listStatus(self.at)] if self.exists() else []

    def rename(self, name: str) -> bool:
        """Give it another name beside its own; False if that is taken."""
        to = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at.getParent(), name)
        return not self.system.exists(to) and self.system.rename(self.at, to)

    def delete(self) -> None:
        self.system.delete(self.at, True)


class Tables:
    """Parquet tables of one run. Writing a step cuts its lineage, and what it did is done once. Results are lazy and read
    these tables, so they stand until close() or close_since() is called, when results have been written."""

    #: Runs whose tables still stand, in the order they began.
    standing: ClassVar[list[Tables]] = []

    def __init__(self, spark: SparkSession, label: str, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        Tables.standing.append(self)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def close(self) -> None:
        """Delete the run's tables."""
        Folder(self.spark, self.folder).delete()
        Tables.standing.remove(self)

    @staticmethod
    def close_since(mark: int) -> None:
        """Delete the tables of all runs that began when `mark` of them stood, inner ones of operators included."""
        for t in Tables.standing[mark:]:
            t.close()
