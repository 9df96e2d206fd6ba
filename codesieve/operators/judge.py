"""The second opinion on critical findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import object_in, parse_verdict
from ..functions.text import number_text
from .ordering import placed

TEMPERATURE, MAX_TOKENS = 0.1, 1024
SYSTEM = "You check a reported bug against the whole file. Answer with one JSON object: verdict, new_severity, reason, confidence."


def finding_key(file: Column, start: Column, end: Column, rule_id: Column, evidence: Column) -> Column:
    return F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("#"), rule_id, F.lit("#"), F.substring(F.sha1(evidence), 1, 8))


def with_finding_key(findings: DataFrame) -> DataFrame:
    return findings.withColumn("finding_key", finding_key(*(F.col(c) for c in ("file", "line_start", "line_end", "rule_id", "evidence"))))


def identified(found: DataFrame, where: list[str]) -> DataFrame:
    """found with `ord`, from 0 in its target by the columns `where` (the order of discovery), and `finding_id`: its key
    and which of the findings with that key in its target it is. So equal findings stay apart, and an id means the same
    finding in another run as long as what it says and where stays the same."""
    placed_ = placed(with_finding_key(found), ["target"], where, "ord").withColumn("ord", F.col("ord") - 1)
    again = placed(placed_, ["target", "finding_key"], ["ord"], "occurrence", ident=["target", "ord"])
    return again.withColumn("finding_id", F.concat("finding_key", F.lit("#"), F.col("occurrence").cast("string"))).drop("finding_key", "occurrence")


def judge_candidates(findings: DataFrame, enabled: bool = True) -> DataFrame:
    return findings.filter((F.col("severity") == "critical") & F.lit(enabled))


def cached_decisions(findings: DataFrame, cache: DataFrame, config: str) -> DataFrame:
    """Decisions that the cache has for critical findings: target, finding_key, kind, new_severity, input_tokens,
    output_tokens; a row for each key. They hold also where the finding's file is gone."""
    own = cache.filter((F.col("config_hash") == config) & (F.col("type") == "judge")).select("target", F.col("key").alias("finding_key"), F.col("decision.kind").alias("kind"), F.col("decision.new_severity").alias("new_severity"), "input_tokens", "output_tokens")
    return own.join(with_finding_key(judge_candidates(findings)).select("target", "finding_key"), ["target", "finding_key"], "left_semi")


def judge_requests(findings: DataFrame, files: DataFrame, chunks: DataFrame, enabled: bool = True, decided: DataFrame | None = None) -> DataFrame:
    """Requests for critical findings whose file had a chunk and text, but for those with a decision (target,
    finding_key). Findings are few and files are wide: only the files asked for are read, and each once."""
    asked = with_finding_key(judge_candidates(findings, enabled))
    if decided is not None:
        asked = asked.join(decided.select("target", "finding_key"), ["target", "finding_key"], "left_anti")
    known = files.join(chunks.select("target", "rel_path").distinct(), ["target", "rel_path"], "left_semi").filter("content <> ''")
    rows = asked.join(known.select("target", F.col("rel_path").alias("file"), F.col("content").alias("file_content")), ["target", "file"])
    user = F.concat_ws(
        "\n", F.concat(F.lit("Claim: "), "rule_id", F.lit(" ("), "severity", F.lit(", sure to "), number_text(F.col("confidence")), F.lit(")")), F.concat(F.lit("Place: "), "file", F.lit(" "), F.col("line_start").cast("string"), F.lit(" to "), F.col("line_end").cast("string")),
        F.concat(F.lit("Reason given: "), "summary"), F.lit("Quoted:"), F.lit("~~~"), F.col("evidence"), F.lit("~~~"), F.lit("The file as it is:"), F.lit("~~~"), F.col("file_content"), F.lit("~~~"), F.lit("Reply with JSON and nothing else."),
    )
    return rows.select("target", F.col("finding_key").alias("request_key"), F.lit(SYSTEM).alias("system_prompt"), user.alias("user_prompt"), F.lit(TEMPERATURE).alias("temperature"), F.lit(MAX_TOKENS).alias("max_tokens"))


def parse_verdicts(responses: DataFrame, text: str = "text") -> DataFrame:
    """responses with `verdict`, a struct, null if the reply isn't valid."""
    return responses.withColumn("verdict", parse_verdict(object_in(F.col(text)))["verdict"])


def decide(severity: Column, verdict: Column) -> Column:
    """struct(kind, new_severity, reason): drop what is rejected, downgrade to another severity, keep all else."""
    lower = (verdict["verdict"] == "downgrade") & verdict["new_severity"].isNotNull() & (verdict["new_severity"] != severity)
    kind = F.when(verdict["verdict"] == "reject", "drop").when(lower, "downgrade").otherwise("keep")
    return F.struct(kind.alias("kind"), F.when(lower, verdict["new_severity"]).alias("new_severity"), F.when(kind != "keep", verdict["reason"]).alias("reason"))


def apply_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """findings without dropped ones and with new severities. decisions: target, finding_key, kind, new_severity.

    Only critical findings are judged; those without a decision stay."""
    keyed = with_finding_key(findings)
    own = decisions.select("target", "finding_key", F.col("kind").alias("judged"), F.col("new_severity").alias("judged_severity"))
    rows = keyed.join(own, ["target", "finding_key"], "left").withColumn("judged", F.when(F.col("severity") == "critical", F.col("judged")))
    return rows.filter(F.coalesce(F.col("judged") != "drop", F.lit(True))).withColumn("severity", F.when(F.col("judged") == "downgrade", F.col("judged_severity")).otherwise(F.col("severity"))).select(*findings.columns)


def decisions_from(responses: DataFrame) -> DataFrame:
    """Decisions of valid calls about critical findings (target, request_key, text, error, tokens): target, finding_key,
    kind, new_severity, reason, tokens. A reply that can't be read keeps its finding."""
    rows = parse_verdicts(responses.filter("error is null")).select("target", F.col("request_key").alias("finding_key"), decide(F.lit("critical"), F.col("verdict")).alias("d"), "input_tokens", "output_tokens")
    kind = F.coalesce("d.kind", F.lit("keep"))
    return rows.select("target", "finding_key", kind.alias("kind"), "d.new_severity", "d.reason", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens")))


def judge_records(decisions: DataFrame, config: str, seq: int) -> DataFrame:
    """Cache records of decisions."""
    return decisions.select("target", F.lit(config).alias("config_hash"), F.lit("judge").alias("type"), F.col("finding_key").alias("key"), F.lit(None).cast("string").alias("findings"), F.struct("kind", "new_severity", "reason").alias("decision"), "input_tokens", "output_tokens", F.lit(seq).cast("bigint").alias("seq"))
