"""Snapshots of source trees: many small files packed into Parquet once, and what has changed since the last time.

A snapshot has a listing (target, rel_path, size, time, digest of the text) and packs the texts of files that are new or
have other text than in the one before. Files whose size and time are as they were aren't packed or hashed again. The
packed texts are what incremental_scan reads: each snapshot adds to them what has to be looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import HIDDEN, IGNORED, TARGET, plain_path, plain_root
from .tables import Folder, Tables
from .trees import Tree

LISTING = "target string, rel_path string, size bigint, time timestamp, digest string"


def looked(tree: Tree, ignored: list[str] | None = None, hidden: bool = False) -> DataFrame:
    """target, rel_path, size, time and path of a tree's files, each target in a folder of its own. No file is opened."""
    plain = plain_root(tree.base)
    path = plain_path(F.col("path"))
    inside = path.substr(F.lit(len(plain) + 2), F.length(path))
    rows = tree.names.select(F.regexp_extract(inside, TARGET, 1).alias("target"), F.regexp_extract(inside, TARGET, 2).alias("rel_path"), "size", "time", "path").filter("rel_path <> ''")
    for pattern in (IGNORED if ignored is None else ignored) + ([] if hidden else [HIDDEN]):
        rows = rows.filter(~F.col("rel_path").rlike(pattern))
    return rows


def listed(spark: SparkSession, root: str, glob: str = "*.rs", **which) -> DataFrame:
    """target, rel_path, size, time and content of files below root."""
    tree = Tree(spark, root, glob)
    return tree.contents(looked(tree, **which)).drop("path")


def number(spark: SparkSession, folder: str) -> int:
    """The newest whole snapshot in folder; 0 if there is none."""
    numbers = sorted((int(n.removeprefix("snapshot-")) for n in Folder(spark, folder).names() if n.startswith("snapshot-") and n.removeprefix("snapshot-").isdigit()), reverse=True)
    return next((n for n in numbers if Folder(spark, f"{folder}/snapshot-{n}/_SUCCESS").exists()), 0)


def listing(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return spark.read.schema(LISTING).parquet(f"{folder}/snapshot-{n}") if n else spark.createDataFrame([], LISTING)


def take_snapshot(spark: SparkSession, root: str, folder: str, glob: str = "*.rs", **which) -> int:
    """Take the next snapshot of the files below root and return its number. Texts of new and changed files are added to
    the packed ones (target, rel_path, content, snapshot); the listing is written last, and only with it the snapshot is
    there: one that was stopped is taken again under the same number, over what it had packed."""
    tables = Tables(spark, "snapshot")
    n = number(spark, folder)
    old = listing(spark, folder, n).select("target", "rel_path", F.col("size").alias("old_size"), F.col("time").alias("old_time"), F.col("digest").alias("old_digest"))
    tree = Tree(spark, root, glob)
    same = F.coalesce((F.col("size") == F.col("old_size")) & (F.col("time") == F.col("old_time")), F.lit(False))
    here = looked(tree, **which).join(old, ["target", "rel_path"], "left").withColumn("same", same)
    here = tables.save(here.select("target", "rel_path", "size", "time", "path", "old_digest", "same"), "here")
    kept = here.filter("same").select("target", "rel_path", "size", "time", F.col("old_digest").alias("digest"))
    read = tree.contents(here.filter("not same").drop("same"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    packed = f"{folder}/packed/snapshot={n + 1}"
    read.select("target", "rel_path", "size", "time", "old_digest", text.alias("content")).withColumn("digest", F.sha2(F.encode("content", "UTF-8"), 256)).write.mode("overwrite").parquet(packed)
    again = spark.read.parquet(packed).select("target", "rel_path", "size", "time", "digest")
    kept.unionByName(again).write.mode("overwrite").parquet(f"{folder}/snapshot-{n + 1}")
    tables.close()
    return n + 1


def changes(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """(target, rel_path, kind, digest): files that snapshot n has and n-1 has not (added), has with other text
    (changed), or no longer has (gone, with the digest they had). Files that are as they were have no row."""
    new, old = listing(spark, folder, n), listing(spark, folder, n - 1).select("target", "rel_path", F.col("digest").alias("old"))
    both = new.join(old, ["target", "rel_path"], "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("digest").isNull(), "gone").when(F.col("digest") != F.col("old"), "changed")
    return both.select("target", "rel_path", kind.alias("kind"), F.coalesce("digest", "old").alias("digest")).filter("kind is not null")


def packed_files(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """target, rel_path and content of files that snapshot n added or changed."""
    rows = spark.read.parquet(f"{folder}/packed/snapshot={n}")
    return rows.filter(F.col("old_digest").isNull() | (F.col("old_digest") != F.col("digest"))).select("target", "rel_path", "content")
