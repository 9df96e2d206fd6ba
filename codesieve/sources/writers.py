"""Reports and the result cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_name, escape_html, fixed
from ..operators.ordering import PAGE, beside, in_pages, order, placed
from .named_files import write_named
from .tables import Tables

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
FIELDS = ["rule_id", "severity", "cwe", "crate", "file", "line_start", "line_end", "summary", "evidence", "fix_suggestion", "confidence"]
CSS = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.4em;vertical-align:top}pre{background:#eee;padding:.5em}.critical{color:#900}.high{color:#c30}.medium{color:#a60}.low{color:#05a}.info{color:#555}"


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def counted(rows: DataFrame, size: int) -> DataFrame:
    """(target, n, pages) of placed rows."""
    return rows.groupBy("target").agg(F.max("place").alias("n")).withColumn("pages", F.ceil(F.col("n") / size).cast("int"))


def listed(findings: DataFrame, item: Column, name: str, size: int) -> DataFrame:
    """(target, page, pages, n, <name>): all findings in the canonical order, `size` to a page; n counts the target's."""
    rows = placed(findings, ["target"], order())
    return beside(in_pages(rows, item, name, size), counted(rows, size))


def with_pages(runs: DataFrame, findings: DataFrame, item: Column, name: str, size: int) -> DataFrame:
    """runs, a row for each page as in listed; one without findings has a page as well, without items."""
    rows = placed(findings, ["target"], order())
    own = Tables(findings.sparkSession, "runs").save(runs.join(counted(rows, size), "target", "left"), "runs")
    some = beside(in_pages(rows, item, name, size), own.filter("n is not null"))
    none = own.filter("n is null").withColumns({"page": F.lit(1), "pages": F.lit(1), "n": F.lit(0).cast("bigint"), name: F.lit(None).cast(some.schema[name].dataType)})
    return some.unionByName(none)


def findings_json(findings: DataFrame, generated_at: Column, size: int = PAGE) -> DataFrame:
    """(target, page, json): the findings of a page, their number in all and when they were written."""
    rows = listed(findings, F.struct(*FIELDS), "findings", size)
    return rows.select("target", "page", F.to_json(F.struct("findings", iso(generated_at).alias("generated_at"), F.col("n").alias("findings_total"), "page", "pages")).alias("json"))


def scan_report(runs: DataFrame, findings: DataFrame, size: int = PAGE) -> DataFrame:
    """(target, page, report): one nested JSON text for each page of findings. runs: target, started_at, finished_at,
    project and model structs, config struct, input_tokens, output_tokens, analyze_calls, judge_calls; a target without
    a run has no report."""
    rows = with_pages(runs, findings, F.struct(*FIELDS), "findings", size)
    kind = f"array<{findings.select(F.struct(*FIELDS).alias('f')).schema['f'].dataType.simpleString()}>"
    scan = F.struct(iso(F.col("started_at")).alias("started_at"), iso(F.col("finished_at")).alias("finished_at"), (F.unix_millis("finished_at") - F.unix_millis("started_at")).alias("duration_ms"))
    tokens = F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), (F.col("input_tokens") + F.col("output_tokens")).alias("total"), "analyze_calls", "judge_calls")
    report = F.struct(scan.alias("scan"), "project", "model", "config", tokens.alias("tokens"), F.col("n").alias("findings_total"), "page", "pages", F.coalesce("findings", F.expr(f"cast(array() as {kind})")).alias("findings"))
    return rows.select("target", "page", F.to_json(report).alias("report"))


def html_row(named: bool = True) -> Column:
    e = {c: escape_html(F.col(c)) for c in ("severity", "rule_id", "cwe", "crate", "file", "summary", "evidence", "fix_suggestion")}
    lines = F.when(F.col("line_end") != F.col("line_start"), F.concat(F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))).otherwise(F.col("line_start").cast("string"))
    prefix = F.when(F.coalesce("crate", F.lit("")) != "", F.concat(e["crate"], F.lit(" · "))).otherwise("")
    cwe = F.when(F.coalesce("cwe", F.lit("")) != "", F.concat(F.lit("<br><small>"), e["cwe"], F.lit("</small>"))).otherwise("")
    cells = [
        F.lit('<tr><td class="'), e["severity"], F.lit('">'), e["severity"], F.lit("</td><td>"), e["rule_id"], cwe, F.lit("</td><td>"), prefix, e["file"], F.lit(":"), lines, F.lit("</td><td>"), e["summary"],
        F.lit("<details><pre>"), e["evidence"], F.lit("</pre><p>"), e["fix_suggestion"], F.lit("</p></details></td><td>"), fixed(F.col("confidence"), 2), F.lit("</td></tr>"),
    ]
    return F.concat(*cells)


def html_rows(findings: DataFrame) -> DataFrame:
    """(target, ord, row): a table row for each finding; nothing is gathered."""
    return findings.select("target", "ord", html_row().alias("row"))


def html_report(runs: DataFrame, findings: DataFrame, size: int = PAGE) -> DataFrame:
    """(target, page, html): self-contained pages. runs: target, title and info, an array of struct(name, value); a
    target without a run has no page."""
    rows = with_pages(runs, findings, html_row(), "rows", size)
    info = F.array_join(F.transform("info", lambda x: F.concat(F.lit("<dt>"), escape_html(x["name"]), F.lit("</dt><dd>"), escape_html(x["value"]), F.lit("</dd>"))), "\n")
    table = F.when(F.col("n") > 0, F.concat(F.lit("<table><tr><th>Severity</th><th>Rule</th><th>Place</th><th>Summary</th><th>Confidence</th></tr>\n"), F.array_join("rows", "\n"), F.lit("\n</table>"))).otherwise("<p>No findings.</p>")
    title = escape_html(F.col("title"))
    number = F.when(F.col("pages") > 1, F.concat(F.lit("<p>Page "), F.col("page").cast("string"), F.lit(" of "), F.col("pages").cast("string"), F.lit("</p>\n"))).otherwise("")
    page = F.concat(F.lit('<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>'), title, F.lit(f"</title><style>{CSS}</style></head><body>\n<h1>"), title, F.lit("</h1>\n<dl>"), info, F.lit("</dl>\n<h2>"), F.col("n").cast("string"), F.lit(" finding(s)</h2>\n"), number, table, F.lit("\n</body></html>\n"))
    return rows.select("target", "page", page.alias("html"))


def report_name(project: Column, provider: Column, model: Column) -> Column:
    return F.concat(F.concat_ws("-", clean_name(project), clean_name(provider), clean_name(model)), F.lit(".html"))


def report_format(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".json"), "json").otherwise("html")


def page_name(name: Column, page: Column) -> Column:
    """The name of a report's page: the first has the report's, the others their number before the ending."""
    return F.when(page == 1, name).otherwise(F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("."), page.cast("string"), F.regexp_extract(name, r"\.[^.]*$", 0)))


def write_reports(pages: DataFrame, folder: str) -> None:
    """Write pages (name, page, and the text in html or report) as files of their own names."""
    text = next(c for c in ("html", "report", "json") if c in pages.columns)
    write_named(pages.select(page_name(F.col("name"), F.col("page")).alias("name"), F.col(text).alias("content")), folder)


def append_cache(records: DataFrame, path: str) -> None:
    """Add records; the crate isn't kept, as it is stamped again when they are read."""
    records.select("target", "config_hash", "type", "key", "findings", "decision", "input_tokens", "output_tokens", "seq").write.mode("append").partitionBy("config_hash", "type").parquet(path)
