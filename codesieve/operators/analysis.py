"""The analysis step: keys, requests, the model call, strict replies with checked evidence, and run statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import object_in, parse_findings
from ..functions.text import collapse_ws
from ..schemas import DECISION, FINDING
from ..sources.tables import bound_batches
from . import model

TEMPERATURE, MAX_TOKENS = 0.1, 2048
SYSTEM = {
    "safety": "You review Rust code for memory-safety and injection bugs. Answer with one JSON object that has a list named findings.",
    "logic": "You review Rust code for logic bugs, exhaustion of resources and unsound concurrency. Answer with one JSON object that has a list named findings.",
    "panic": "You review Rust code for paths on which it can crash. Answer with one JSON object that has a list named findings.",
}


def chunk_key(crate: Column, rel_path: Column, start: Column, end: Column, content: Column) -> Column:
    """Where a chunk lies and what it says, so that an edit makes a new key."""
    return F.concat(crate, F.lit("/"), rel_path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("#"), F.substring(F.sha1(content), 1, 12))


def with_chunk_key(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_key", chunk_key(*(F.col(c) for c in ("crate", "rel_path", "start_line", "end_line", "content"))))


def config_hash(project_path: Column, provider: Column, model: Column, unit: Column, mode: Column, judge: Column, crates: Column) -> Column:
    """Names a scan's settings; the order of crates doesn't matter."""
    key = F.struct(project_path.alias("projectPath"), provider.alias("provider"), model.alias("model"), unit.alias("unit"), mode.alias("mode"), judge.alias("judge"), F.array_sort(crates).alias("crates"))
    return F.substring(F.sha2(F.to_json(key), 256), 1, 12)


def analysis_requests(chunks: DataFrame, mode: str = "safety", system: dict[str, str] | None = None) -> DataFrame:
    """One request for each chunk, keyed by chunk_key."""
    system = system or SYSTEM
    user = F.concat_ws(
        "\n", F.concat(F.lit("Package "), "crate"), F.concat(F.lit("Source "), "rel_path", F.lit(", from line "), F.col("start_line").cast("string"), F.lit(" to "), F.col("end_line").cast("string")),
        F.concat(F.lit("Rules that fired: "), F.when(F.size("hints") > 0, F.array_join("hints", " ")).otherwise("-")), F.lit("~~~"), F.col("content"), F.lit("~~~"), F.lit("Reply with JSON and nothing else."),
    )
    return with_chunk_key(chunks).select("target", F.col("chunk_key").alias("request_key"), F.lit(system.get(mode, system["safety"])).alias("system_prompt"), user.alias("user_prompt"), F.lit(TEMPERATURE).alias("temperature"), F.lit(MAX_TOKENS).alias("max_tokens"))


def split_cached(chunks: DataFrame, cache: DataFrame, config: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with a cached result, chunks that are pending), of one join over the keys of each target.

    cache has the last record of each key: target, config_hash, type, key, findings, input_tokens, output_tokens.
    """
    own = cache.filter((F.col("config_hash") == config) & (F.col("type") == "chunk")).select("target", F.col("key").alias("chunk_key"), F.lit(True).alias("cached"), F.col("findings").alias("cached_findings"), "input_tokens", "output_tokens")
    keyed = with_chunk_key(chunks)
    rows = keyed.join(own, ["target", "chunk_key"], "left")
    return rows.filter("cached").drop("cached"), rows.filter("cached is null").select(keyed.columns)


def cached_findings(cached: DataFrame) -> DataFrame:
    """Findings of chunks that split_cached found, as findings_from_responses gives them: the crate is the chunk's."""
    fields = ",".join(x.strip().replace(" ", ":") for x in FINDING.split(","))
    stored = F.from_json("cached_findings", f"array<struct<{fields}>>")
    return cached.select("target", "crate", "chunk_key", F.posexplode(stored).alias("ord", "f")).select("target", "crate", "chunk_key", F.col("ord").cast("bigint").alias("ord"), "f.*")


def chunk_records(responses: DataFrame, findings: DataFrame, config: str, seq: int) -> DataFrame:
    """Cache records of valid calls with the findings they gave, in their order and without the crate. responses:
    target, chunk_key, error, input_tokens, output_tokens; a reply's findings are as few as a reply can hold."""
    fields = [x.strip().split(" ")[0] for x in FINDING.split(",")]
    listed = findings.groupBy("target", "chunk_key").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("f")))).alias("all"))
    rows = responses.filter("error is null").join(listed, ["target", "chunk_key"], "left")
    return rows.select(
        "target", F.lit(config).alias("config_hash"), F.lit("chunk").alias("type"), F.col("chunk_key").alias("key"), F.coalesce(F.to_json(F.col("all.f")), F.lit("[]")).alias("findings"), F.lit(None).cast(DECISION).alias("decision"),
        F.coalesce("input_tokens", F.lit(0)).cast("bigint").alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).cast("bigint").alias("output_tokens"), F.lit(seq).cast("bigint").alias("seq"),
    )


def complete(requests: DataFrame, client: Callable[[], Callable[[dict], dict]], in_flight: int = 16, attempts: int = 5, **how) -> DataFrame:
    """model.complete with its settings as keywords."""
    return model.complete(requests, client, model.Asking(in_flight=in_flight, attempts=attempts, **how))


def verify_evidence(evidence: Column, content: Column) -> Column:
    """Whether the evidence stands in the content, white space aside. content is already collapsed."""
    return F.contains(content, collapse_ws(evidence))


def stands_in(evidence: Column, content: Column) -> Column:
    """As verify_evidence, of content as it is: mostly evidence stands there literally, and the content isn't collapsed.

    Collapsed evidence begins and ends with something visible and has single blanks only, so where content has it, the
    collapsed content has it too. Content that ends with U+0085 is always collapsed: before that, an end of line to
    regular expressions though no white space here, a blank goes."""
    return (F.contains(content, collapse_ws(evidence)) & ~F.endswith(content, F.lit("\u0085"))) | verify_evidence(evidence, collapse_ws(content))


def findings_from_responses(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """Findings of valid replies whose evidence is in their chunk, with the chunk's crate.

    chunks: target, crate, chunk_key, content; responses: target, chunk_key, text, error. `ord` numbers a reply's
    findings. Both sides grow with the files, so they are sorted and never broadcast: Spark takes a table for as small as
    its few read columns are in Parquet."""
    bound_batches(responses.sparkSession)
    parsed = responses.filter("error is null").select("target", "chunk_key", parse_findings(object_in(F.col("text"))).alias("p")).filter("p.ok and size(p.findings) > 0")
    rows = chunks.select("target", "crate", "chunk_key", "content").hint("merge").join(parsed, ["target", "chunk_key"])
    return rows.select("target", "crate", "chunk_key", "content", F.posexplode("p.findings").alias("ord", "f")).filter(stands_in(F.col("f.evidence"), F.col("content"))).select("target", "crate", "chunk_key", F.col("ord").cast("bigint").alias("ord"), "f.*")


def run_stats(responses: DataFrame) -> DataFrame:
    """Six counters per target. responses: target, step (analyze or judge), cached, error, input_tokens, output_tokens.

    Failed calls count nowhere; cache hits count as calls and apart."""
    good = responses.filter("error is null")

    def calls(step: str, cached: bool) -> Column:
        return F.count_if((F.col("step") == step) & (F.col("cached") if cached else F.lit(True)))

    counted = good.groupBy("target").agg(
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), calls("analyze", False).alias("analyze_calls"), calls("judge", False).alias("judge_calls"),
        calls("analyze", True).alias("analyze_cache_hits"), calls("judge", True).alias("judge_cache_hits"),
    )
    return responses.select("target").distinct().join(counted, "target", "left").na.fill(0)


def progress(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """target, finished, total, percent (floored; 100 if there is nothing to do). Both have target and chunk_key."""
    total = chunks.groupBy("target").agg(F.count(F.lit(1)).alias("total"))
    finished = chunks.join(done.select("target", "chunk_key").distinct(), ["target", "chunk_key"], "left_semi").groupBy("target").agg(F.count(F.lit(1)).alias("finished"))
    both = total.join(finished, "target", "left").withColumn("finished", F.coalesce("finished", F.lit(0)))
    return both.select("target", "finished", "total", F.when(F.col("total") == 0, 100).otherwise(F.floor(F.col("finished") * 100 / F.col("total"))).cast("bigint").alias("percent"))
