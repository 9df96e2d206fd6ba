"""Exact dedup by a streaming aggregation whose keyed state lies in RocksDB and never expires.

State of a digest: how many rows had it, and the row that stays (most code points, then smallest doc_id) with its
content locator (file). Rows that hit a digest already held are compared in full with the text at the group's locator;
should texts that differ share a digest, their groups are formed again from the texts themselves.

Defined cases: a null text counts as empty; empty texts are one group; repeated rows are one group, and rows of a group
that also share the doc_id are one document, kept or dropped together; rows that share a doc_id but not their text are
rows of different groups; rows without doc_id count in their group but always stay, with no keep_id; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

SPACE = " \t\n\x0b\x0c\r"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # a store for each partition: no files of megabytes reserved in advance, and closed once its batch is committed
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: A key's rows are spread over so many tasks while texts are compared.
COPIES_PER_TASK = 500


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def dedup_stream(spark: SparkSession, path: str, schema: str, ws: Workspace, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """Run all files below path through the keyed state; (digest, group_size, best) where best orders rows by worth.

    Each micro-batch appends the state rows it changed; counts and best rows only grow, so the latest is the largest.
    A batch that is run again after a failure replaces its own output.
    """
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        # as a pattern, so that a single file is as good as a folder of them
        rows = reader.parquet(f"{path[:-1]}[{path[-1]}]")
        state = rows.groupBy(digest(normalised(F.col("text"))).alias("digest")).agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max(F.when(F.col("doc_id").isNotNull(), F.struct(F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), (-F.col("doc_id").cast("bigint")).alias("rank"), F.col("_metadata.file_path").alias("locator")))).alias("best"),
        )
        out = ws.path("state")

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", ws.path("stream")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema_out = "digest string, group_size bigint, best struct<chars:int, rank:bigint, locator:string>"
    try:
        table = spark.read.schema(schema_out).parquet(f"{out}/batch=*")
    except Exception as e:  # no batch ran: there was no row
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = spark.createDataFrame([], schema_out)
    return table.groupBy("digest").agg(F.max("group_size").alias("group_size"), F.max("best").alias("best"))


def resolve(docs: DataFrame, state: DataFrame, ws: Workspace, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs, which are read from files: doc_id, keep_id, group_size, kept, text_sha256."""
    text = normalised(F.col("text"))
    id_, chars = F.col("doc_id").cast("bigint").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).alias("chars")
    # written, so that the join below has a shuffle on both sides, of which Spark can split a hot digest's
    state = ws.save(state.filter("group_size > 1"), "groups")
    groups = state.select("digest", "group_size", (-F.col("best.rank")).alias("keep_id"))
    slim = docs.select(id_, digest(text).alias("digest"), sha256(text).alias("text_sha256"))
    own = F.col("group_size").isNull() | F.col("doc_id").isNull()
    ruled = ws.save(slim.join(groups, "digest", "left").withColumn("keep_id", F.when(own, F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("bigint"))), "ruled")
    hits = ruled.filter("group_size > 1 and doc_id is not null").select("doc_id", "digest", "group_size").distinct()

    # full texts of hits only: rows that share a doc_id are told apart by their digest
    row = [id_, text.alias("norm"), chars, F.col("_metadata.file_path").alias("file")]
    known = docs.select(*row).join(hits, "doc_id").filter(digest(F.col("norm")) == F.col("digest"))
    nameless = docs.filter("doc_id is null").select(*row).withColumn("digest", digest(F.col("norm"))).join(groups.select("digest", "group_size"), "digest")
    texts = ws.save(known.unionByName(nameless), "hit_texts")
    spread = F.ceil(F.col("group_size") / COPIES_PER_TASK).cast("int")
    # beside each the text that its group keeps: the locator names its row, so only that row's text is looked for, and a
    # digest that most rows share is no key here. Groups without any id keep some text, which tasks choose among theirs first
    best = state.select("digest", "group_size", "best.locator", F.col("best.chars").alias("best_chars"), (-F.col("best.rank")).alias("doc_id"))
    named = texts.filter("doc_id is not null").join(best.filter("doc_id is not null").drop("group_size"), ["doc_id", "digest"]).filter((F.col("file") == F.col("locator")) & (F.col("chars") == F.col("best_chars")))
    some = texts.filter("doc_id is null").join(best.filter("doc_id is null").select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("norm").alias("norm"), F.first("group_size").alias("group_size"))
    kept_texts = named.select("digest", "norm", "group_size").dropDuplicates(["digest"]).unionByName(some).select("digest", F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"), F.col("norm").alias("kept_norm"))
    differing = ws.save(texts.withColumn("salt", F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), spread).cast("int")).join(kept_texts, ["digest", "salt"]).filter("norm <> kept_norm").select("digest").distinct(), "differing")

    # digests under which texts differ are grouped by their texts; rows without an id are counted, never ranked
    again = texts.join(differing, "digest", "left_semi").select("doc_id", "digest", "norm", "chars")
    exact = again.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.when(F.col("doc_id").isNotNull(), F.struct("chars", (-F.col("doc_id")).alias("rank")))).alias("best"))
    redone = again.join(exact, ["digest", "norm"]).select("doc_id", F.when(F.col("doc_id").isNotNull(), -F.col("best.rank")).alias("keep_id"), "group_size", sha256(F.col("norm")).alias("text_sha256"))
    kept = ruled.join(differing, "digest", "left_anti").select("doc_id", "keep_id", "group_size", "text_sha256")
    return kept.unionByName(redone).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(True)).alias("kept"), "text_sha256")


def exact_dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    ws = Workspace(spark, "exact-dedup")
    docs = spark.read.parquet(path)
    schema = docs.select("doc_id", "text")._jdf.schema().toDDL()
    return resolve(docs, dedup_stream(spark, path, schema, ws, digest, files_per_batch), ws, digest)
