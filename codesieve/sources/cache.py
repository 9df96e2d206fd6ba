"""The result cache as a log with generations.

Results are appended to a folder (the tail). Compacting merges the last generation and the tail, the last record of each
key winning, into the next one: Parquet in buckets of the key, sorted in each. A manifest then names the generation and
the files of the tail that are in it. Whoever reads takes the newest complete manifest, its generation, and the files of
the tail that it doesn't name. So until the manifest is complete nothing has changed, appends may go on meanwhile, and
what a stopped compaction leaves is never read.

Generations and manifests lie in folders that begin with an underscore, which readers of the tail don't see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CACHE
from .readers import latest
from .tables import Folder

COLUMNS = [x.split(" ")[0] for x in CACHE.replace("struct<kind:string,new_severity:string,reason:string>", "struct").split(", ")]
#: Files of a generation for each config and type.
BUCKETS = 16
GENERATIONS, MANIFESTS = "_generations", "_manifests"


def generation(spark: SparkSession, path: str) -> int:
    """The newest generation with a complete manifest; 0 if there is none."""
    root = f"{path.rstrip('/')}/{MANIFESTS}"
    numbers = sorted((int(n.removeprefix("manifest-")) for n in Folder(spark, root).names() if n.startswith("manifest-") and n.removeprefix("manifest-").isdigit()), reverse=True)
    return next((n for n in numbers if Folder(spark, f"{root}/manifest-{n}/_SUCCESS").exists()), 0)


def tail_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the tail with the `file` that they stand in."""
    rows = spark.read.schema(CACHE).parquet(path)
    return rows.select(*COLUMNS, F.col("_metadata.file_path").alias("file"))


def merged_files(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.schema("file string").parquet(f"{path.rstrip('/')}/{MANIFESTS}/manifest-{n}")


def cache_rows(spark: SparkSession, path: str) -> DataFrame:
    """All records: those of the generation and of the tail that isn't in it. None before the first append."""
    path = path.rstrip("/")
    if not Folder(spark, path).exists():
        return spark.createDataFrame([], CACHE)
    n = generation(spark, path)
    if not n:
        return tail_rows(spark, path).drop("file")
    left = tail_rows(spark, path).join(merged_files(spark, path, n), "file", "left_anti").select(*COLUMNS)
    return spark.read.schema(CACHE).parquet(f"{path}/{GENERATIONS}/generation-{n}").select(*COLUMNS).unionByName(left)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The state of the cache: the last record of each key."""
    return latest(cache_rows(spark, path))


def compact_cache(spark: SparkSession, path: str, buckets: int = BUCKETS) -> int:
    """Merge the tail into the next generation and return its number. Files of the tail that it holds, and older
    generations, go afterwards, when no reader of theirs is left (see forget_merged)."""
    path = path.rstrip("/")
    n = generation(spark, path)
    files = tail_rows(spark, path).select("file").distinct()
    merged = f"{path}/{MANIFESTS}/manifest-{n + 1}"
    # which files the tail has is written first, under a name that isn't a manifest's, and then holds for all that follows
    Folder(spark, f"{merged}-open").delete()
    files.write.mode("overwrite").parquet(f"{merged}-open")
    chosen = spark.read.schema("file string").parquet(f"{merged}-open")
    new = tail_rows(spark, path).join(chosen, "file", "left_semi").select(*COLUMNS)
    if n:
        new = tail_rows(spark, path).join(chosen, "file", "left_semi").join(merged_files(spark, path, n), "file", "left_anti").select(*COLUMNS)
        new = new.unionByName(spark.read.schema(CACHE).parquet(f"{path}/{GENERATIONS}/generation-{n}").select(*COLUMNS))
    key = ["config_hash", "type", "bucket"]
    kept = latest(new).withColumn("bucket", F.pmod(F.xxhash64("target", "key"), F.lit(buckets)).cast("int"))
    kept.repartition(*key).sortWithinPartitions(*key, "target", "key").write.mode("overwrite").partitionBy(*key).parquet(f"{path}/{GENERATIONS}/generation-{n + 1}")
    Folder(spark, f"{merged}-open").rename(f"manifest-{n + 1}")  # the one step that readers see
    return n + 1


def forget_merged(spark: SparkSession, path: str) -> None:
    """Delete older generations and manifests, and the files of the tail that the newest generation holds, but for their
    names in its manifest."""
    path = path.rstrip("/")
    n = generation(spark, path)
    for k in range(1, n):
        Folder(spark, f"{path}/{GENERATIONS}/generation-{k}").delete()
        Folder(spark, f"{path}/{MANIFESTS}/manifest-{k}").delete()
    if n:
        for r in merged_files(spark, path, n).toLocalIterator():  # a name for each file, one after another
            Folder(spark, r["file"]).delete()
