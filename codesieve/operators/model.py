"""The model call: a bounded number of calls at once, and a log of replies, so that none is paid for twice."""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass
from itertools import batched, groupby

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Folder, bound_batches

REQUEST = "target string, request_key string, system_prompt string, user_prompt string, temperature double, max_tokens int"
RESPONSE = "target string, request_key string, text string, input_tokens bigint, output_tokens bigint, error string"
FIELDS = pa.schema([("target", pa.string()), ("request_key", pa.string()), ("text", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("error", pa.string())])
#: Parts of a run's log; a task looks only into those of its own requests.
SHARDS = 64
#: Replies, and bytes of these, whose files a task makes into one.
MERGED, MERGED_BYTES = 2000, 8_000_000


def backoff(attempt: int) -> float:
    """Seconds before attempt 1, 2, ... is made again."""
    return min(0.5 * 2 ** (attempt - 1), 30.0)


@dataclass(frozen=True)
class Asking:
    """How a model is called: at most in_flight calls at once, per_task of them in one task, each with so many attempts
    and a wait before each further one. With a log, a folder that tasks and driver share, replies are appended `group` at
    a time."""

    in_flight: int = 16
    per_task: int = 4
    attempts: int = 5
    delay: Callable[[int], float] = backoff
    group: int = 16
    log: str | None = None

    def within(self, name: str) -> Asking:
        """The same, its log in a folder below."""
        return Asking(self.in_flight, self.per_task, self.attempts, self.delay, self.group, f"{self.log}/{name}" if self.log else None)


def read_replies(spark: SparkSession, log: str) -> DataFrame:
    """Replies in a log, one for each request; none before its first write."""
    if not Folder(spark, log).exists():
        return spark.createDataFrame([], RESPONSE)
    # a run that is under way makes its files into larger ones meanwhile
    rows = spark.read.schema(RESPONSE).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").parquet(log)
    return rows.groupBy("target", "request_key").agg(F.min(F.struct("text", "input_tokens", "output_tokens", "error")).alias("r")).select("target", "request_key", "r.*")


class Shard:
    """A run's replies to the requests of one shard: Parquet files, each complete when it has its name. A group is a file
    when it has come; `merge` makes those since the last time into one and then deletes them, so that readers open few
    files however many groups there were. Whoever is stopped in between leaves replies that stand twice."""

    def __init__(self, log: str, run: str, shard: int):
        self.system, root = fs.FileSystem.from_uri(log)
        self.folder = f"{root}/run={run}/shard={shard}"
        self.recent: list[tuple[str, pa.Table]] = []
        self.rows = self.size = 0

    def replies(self) -> Iterator[pa.Table]:
        """What earlier attempts of the task have logged; some may stand twice."""
        seen: set[str] = set()
        more = True
        while more:
            more = False
            for info in self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
                if info.base_name.startswith("replies-") and info.path not in seen:
                    seen.add(info.path)
                    try:
                        table = pq.read_table(info.path, filesystem=self.system, schema=FIELDS)
                    except FileNotFoundError:  # an attempt that isn't dead has merged it
                        more = True
                    else:
                        yield table

    def append(self, rows: list[dict]) -> None:
        if rows:
            table = pa.Table.from_pylist(rows, schema=FIELDS)
            self.recent.append((self.write(table), table))
            self.rows, self.size = self.rows + table.num_rows, self.size + table.nbytes
            if self.rows >= MERGED or self.size >= MERGED_BYTES:
                self.merge()

    def write(self, table: pa.Table) -> str:
        name = f"{uuid.uuid4().hex}.parquet"
        self.system.create_dir(self.folder)
        pq.write_table(table, f"{self.folder}/_{name}", filesystem=self.system)
        self.system.move(f"{self.folder}/_{name}", f"{self.folder}/replies-{name}")
        return f"{self.folder}/replies-{name}"

    def merge(self) -> None:
        if len(self.recent) > 1:
            self.write(pa.concat_tables([t for _, t in self.recent]))
            for path, _ in self.recent:
                self.system.delete_file(path)
        self.recent, self.rows, self.size = [], 0, 0


def complete(requests: DataFrame, client: Callable[[], Callable[[dict], dict]], asking: Asking = Asking()) -> DataFrame:
    """Call a model once for each request (target, request_key). client() makes, in each thread of a worker, a function
    from a request to {text, input_tokens, output_tokens}. What still fails after the attempts has its error and no text.

    With a log, requests that it answers aren't asked, and each reply is written there when it has come, in groups: a
    task that is run again, and a second look at the result, find them. Only replies of a group that was under way when a
    worker was killed are lost; errors are never logged. Without a log, whoever reads the result twice calls twice."""
    spark = requests.sparkSession
    bound_batches(spark)
    own = requests.select(*(x.split()[0] for x in REQUEST.split(", ")))
    known = None
    if asking.log and Folder(spark, asking.log).exists():
        known = read_replies(spark, asking.log).join(own.select("target", "request_key").distinct(), ["target", "request_key"], "left_semi")
        own = own.join(known.select("target", "request_key"), ["target", "request_key"], "left_anti")
    run_id, tasks = uuid.uuid4().hex[:12], max(1, asking.in_flight // asking.per_task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = threading.local()

        def ask(request: dict) -> dict:
            if not hasattr(local, "call"):
                local.call = client()
            row = {"target": request["target"], "request_key": request["request_key"], "text": None, "input_tokens": None, "output_tokens": None, "error": None}
            for attempt in range(asking.attempts):
                if attempt:
                    time.sleep(asking.delay(attempt))
                try:
                    return row | {k: v for k, v in local.call(request).items() if k in ("text", "input_tokens", "output_tokens")} | {"error": None}
                except Exception as e:  # whatever a client raises is that request's error
                    row["error"] = f"{type(e).__name__}: {e}"
            return row

        def key(request: dict) -> bytes:
            return hashlib.md5(f"{request['target']}\0{request['request_key']}".encode()).digest()

        rows = (r for b in batches for r in b.to_pylist())
        with ThreadPoolExecutor(asking.per_task) as pool:
            for shard, mine in groupby(rows, key=lambda r: r["shard"]):
                done: set[bytes] = set()
                log = Shard(asking.log, run_id, shard) if asking.log else None
                for table in log.replies() if log else ():
                    keys = list(map(key, table.select(["target", "request_key"]).to_pylist()))
                    fresh = [k not in done and not done.add(k) for k in keys]
                    yield from table.filter(pa.array(fresh, pa.bool_())).to_batches()

                def pending(mine=mine, done=done) -> Iterator[dict]:
                    for r in mine:
                        if (k := key(r)) not in done:
                            done.add(k)
                            yield r

                for group in batched(pending(), asking.group):
                    calls = [pool.submit(ask, r) for r in group]
                    wait(calls)  # also if one dies: what the others were paid for is kept
                    out = [c.result() for c in calls if c.exception() is None]
                    if log:
                        log.append([r for r in out if r["error"] is None])
                    for c in calls:
                        c.result()
                    yield pa.RecordBatch.from_pylist(out, schema=FIELDS)
                if log:
                    log.merge()

    shard = F.pmod(F.xxhash64("target", "request_key"), F.lit(SHARDS)).cast("int")
    fresh = own.withColumn("shard", shard).repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard").mapInArrow(run, RESPONSE)
    return fresh if known is None else fresh.unionByName(known)
