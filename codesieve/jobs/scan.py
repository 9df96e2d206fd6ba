"""Whole jobs: a scan from files to findings, and an evaluation from report texts to gates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, chunking, corpus, evaluation, judge, ordering
from ..operators.model import Asking, complete
from ..sources import readers, writers
from ..sources.cache import read_cache
from ..sources.tables import Tables


#: The order in which findings are discovered: files, chunks, places in a reply.
DISCOVERY = ["crate", "rel_path", "chunk_line", "chunk_end", "chunk_key", "reply"]


@dataclass
class Scan:
    """found: judged findings as discovered; calls: what run_stats counts; records: what the cache has not yet; failed:
    (target, crate, rel_path) of files of which a call failed."""

    found: DataFrame
    calls: DataFrame
    records: DataFrame
    failed: DataFrame

    @cached_property
    def findings(self) -> DataFrame:
        """In the canonical order, with `place`, `ord` and `finding_id` in their target."""
        return ordering.ranked_findings(judge.identified(self.found, DISCOVERY).drop(*(c for c in DISCOVERY if c != "crate")))


def scan(files: DataFrame, cache: DataFrame, config: str, client: Callable, tables: Tables, unit: str = "ast-function", mode: str = "safety", judged: bool = True, seq: int = 0, asking: Asking = Asking()) -> Scan:
    """Files to findings: chunks, cached results or model calls, checked evidence, the judge, the canonical order.

    cache holds the last record of each key. Replies are written before anything reads them, so each is paid for once;
    with a log in `asking`, also where a task or the whole job is run again. Findings with equal keys are judged once."""
    chunks = tables.save(analysis.with_chunk_key(chunking.chunk(files, unit, mode)), "chunks")
    cached, pending = analysis.split_cached(chunks, cache, config)
    replies = tables.save(complete(analysis.analysis_requests(pending, mode), client, asking.within("analyze")), "replies").withColumnRenamed("request_key", "chunk_key")
    fresh = tables.save(analysis.findings_from_responses(pending, replies), "fresh")
    place = chunks.select("target", "crate", "chunk_key", "rel_path", F.col("start_line").alias("chunk_line"), F.col("end_line").alias("chunk_end")).distinct()
    found = fresh.unionByName(analysis.cached_findings(cached)).withColumnRenamed("ord", "reply").join(place, ["target", "crate", "chunk_key"])
    found = tables.save(found, "found")
    records = analysis.chunk_records(replies, fresh, config, seq)
    tokens = ["input_tokens", "output_tokens"]
    none = F.lit(None).cast("string").alias("error")
    calls = replies.select("target", F.lit("analyze").alias("step"), F.lit(False).alias("cached"), "error", *tokens).unionByName(cached.select("target", F.lit("analyze").alias("step"), F.lit(True).alias("cached"), none, *tokens))
    failed = chunks.join(replies.filter("error is not null").select("target", "chunk_key"), ["target", "chunk_key"], "left_semi").select("target", "crate", "rel_path")
    if judged:
        earlier = tables.save(judge.cached_decisions(found, cache, config), "earlier")
        asked = judge.judge_requests(found, files, chunks, decided=earlier).dropDuplicates(["target", "request_key"])
        verdicts = tables.save(complete(asked, client, asking.within("judge")), "verdicts")
        decided = tables.save(judge.decisions_from(verdicts), "decided")
        records = records.unionByName(judge.judge_records(decided, config, seq))
        keyed = judge.with_finding_key(judge.judge_candidates(found))
        hits = keyed.select("target", "finding_key").join(earlier, ["target", "finding_key"])
        calls = calls.unionByName(verdicts.select("target", F.lit("judge").alias("step"), F.lit(False).alias("cached"), "error", *tokens)).unionByName(hits.select("target", F.lit("judge").alias("step"), F.lit(True).alias("cached"), none, *tokens))
        unjudged = verdicts.filter("error is not null").select("target", F.col("request_key").alias("finding_key"))
        failed = failed.unionByName(keyed.join(unjudged, ["target", "finding_key"], "left_semi").select("target", "crate", "rel_path"))
        found = judge.apply_decisions(found, earlier.drop(*tokens).unionByName(decided.drop("reason", *tokens)))
    return Scan(found, calls, records, failed.distinct())


@dataclass
class Projects:
    """What lies below a root: crates and their files; problems: projects without a readable manifest at their root."""

    files: DataFrame
    crates: DataFrame
    projects: DataFrame
    problems: DataFrame


def projects(spark: SparkSession, root: str, tables: Tables, crates: list[str] | None = None, limit: int = 0, files: DataFrame | None = None) -> Projects:
    """Projects in folders below root, or those of the named crates: manifests, crates, files of each crate, and the
    first `limit` of each target if that isn't 0. files: the texts, if they needn't be read from there."""
    manifests = tables.save(readers.read_manifests(spark, root), "manifests")
    targets = manifests.select("target", F.concat(F.lit(readers.plain_root(root) + "/"), "target").alias("root")).distinct()
    named = tables.save(corpus.filter_crates(corpus.resolve_crates(targets, manifests), crates or []), "crates")
    own = files if files is not None else readers.read_sources(spark, root)
    inside = corpus.limit_files(corpus.attribute_files(own, named), named, limit)
    return Projects(tables.save(inside.select("target", "crate", "rel_path", "content"), "sources"), named, corpus.project_info(targets, manifests), corpus.bad_targets(targets, manifests))


def listing_root(spark: SparkSession, root: str, tables: Tables, unit: str = "ast-function", mode: str = "safety", crates: list[str] | None = None, limit: int = 0) -> DataFrame:
    """What a scan of the projects below root would send to the model, without the text."""
    return chunking.chunk_listing(chunking.chunk(projects(spark, root, tables, crates, limit).files, unit, mode))


def scan_root(spark: SparkSession, root: str, config: str, client: Callable, tables: Tables, cache: str, folder: str, unit: str = "ast-function", mode: str = "safety", crates: list[str] | None = None, limit: int = 0, judged: bool = True, provider: str = "provider", model: str = "model", asking: Asking = Asking()) -> Scan:
    """Scan all projects below root: results go to the cache, HTML reports to files of their own names in folder."""
    own = projects(spark, root, tables, crates, limit)
    done = scan(own.files, read_cache(spark, cache), config, client, tables, unit, mode, judged, asking=asking)
    writers.append_cache(done.records, cache)
    info = F.array(F.struct(F.lit("Model").alias("name"), F.lit(model).alias("value")), F.struct(F.lit("Unit").alias("name"), F.lit(unit).alias("value")))
    runs = own.projects.join(own.problems.select("target"), "target", "left_anti").select("target", F.concat(F.lit("Scan of "), "project_name").alias("title"), info.alias("info"), writers.report_name(F.col("target"), F.lit(provider), F.lit(model)).alias("name"))
    pages = writers.html_report(runs, tables.save(done.findings, "findings")).join(runs.select("target", "name"), "target")
    writers.write_reports(pages, folder)
    return done


@dataclass
class Evaluation:
    summary: DataFrame
    gates: DataFrame
    report: DataFrame
    problems: DataFrame


def evaluate_reports(texts: DataFrame, entries: DataFrame, targets: DataFrame, tables: Tables, min_recall: float | None = None, min_precision: float | None = None) -> Evaluation:
    """Report texts (report, the target's name, page and text) to figures, gates and reports.
    problems: reports without a findings array, and whatever is wrong with the truth."""
    found, broken = readers.reports_from(texts)
    found = tables.save(found, "found")  # matching looks at findings twice, and texts are slow to parse
    matches = tables.save(evaluation.match_findings(found.withColumnRenamed("report", "target"), entries, targets), "matches")
    summary = tables.save(evaluation.evaluate(matches, entries, targets), "summary")
    problems = evaluation.validate_ground_truth(targets, entries).unionByName(broken.select(F.col("report").alias("target"), F.lit(None).cast("string").alias("id"), "problem"))
    return Evaluation(summary, evaluation.gate(summary, min_recall, min_precision), evaluation.eval_report(summary, matches, entries, targets), problems)
