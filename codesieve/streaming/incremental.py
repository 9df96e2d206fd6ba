"""Scans that go on where they stopped: a stream over source files that works only on what the cache lacks, and a second
stream over the files of which a call failed.

The streams keep no state of their own. Three tables beside each other are the state: the cache, the log of replies, and
the files to try again. A batch that is run again finds its replies in the log, so none is paid for twice, and its results
in the cache. A source file whose call failed is behind the first stream's checkpoint; it is written to the table of
failed files, which the second stream reads, and to which what fails again comes back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..jobs.scan import scan
from ..operators.model import Asking
from ..schemas import FILES
from ..sources.readers import latest
from ..sources.cache import cache_rows
from ..sources.tables import Folder, Tables
from ..sources.writers import append_cache

COLUMNS = [x.split(" ")[0] for x in FILES.split(", ")]


def failed_files(cache: str) -> str:
    return cache.rstrip("/") + "-failed"


def reply_log(cache: str) -> str:
    return cache.rstrip("/") + "-replies"


def scan_batch(files: DataFrame, batch_id: int, cache: str, config: str, client: Callable, unit: str, mode: str, judged: bool, asking: Asking) -> None:
    """Scan a batch of files with what the cache knows of their targets; add new results to it, and files of which a
    call failed to the table of those."""
    spark, mark = files.sparkSession, len(Tables.standing)
    tables = Tables(spark, "incremental-scan")
    own = tables.save(files.select(*COLUMNS).distinct(), "files")
    known = latest(cache_rows(spark, cache).filter(f"config_hash = '{config}'").join(own.select("target").distinct(), "target", "left_semi"))
    done = scan(own, known, config, client, tables, unit, mode, judged, batch_id, asking)
    append_cache(done.records, cache)
    own.join(done.failed, ["target", "crate", "rel_path"], "left_semi").write.mode("append").parquet(failed_files(cache))
    Tables.close_since(mark)


def started(files: DataFrame, cache: str, checkpoint: str, config: str, client: Callable, unit: str, mode: str, judged: bool, asking: Asking) -> StreamingQuery:
    how = asking if asking.log else replace(asking, log=f"{reply_log(cache)}/{config}")
    return files.writeStream.foreachBatch(lambda df, i: scan_batch(df, i, cache, config, client, unit, mode, judged, how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_scan(spark: SparkSession, source: str, cache: str, checkpoint: str, config: str, client: Callable, unit: str = "ast-function", mode: str = "safety", files_per_batch: int = 1000, judged: bool = True, asking: Asking = Asking()) -> StreamingQuery:
    """Start the stream over Parquet files of sources; it ends when all that is there has been read."""
    files = spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return started(files, cache, checkpoint, config, client, unit, mode, judged, asking)


def retry_failed(spark: SparkSession, cache: str, checkpoint: str, config: str, client: Callable, unit: str = "ast-function", mode: str = "safety", files_per_batch: int = 1000, judged: bool = True, asking: Asking = Asking()) -> StreamingQuery:
    """Start the stream over files of which a call failed, with a checkpoint of its own: chunks and findings of them that
    have a result by now are left alone. It ends when all that failed before its start has been tried once more."""
    failed = failed_files(cache)
    if not Folder(spark, failed).exists():
        spark.createDataFrame([], FILES).write.mode("append").parquet(failed)
    files = spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_batch).parquet(failed)
    return started(files, cache, checkpoint, config, client, unit, mode, judged, asking)
