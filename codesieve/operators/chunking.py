"""From files to chunks: rule hits by line, and the chunks of each unit. All of it is row-local.

Rules of the catalogue are looked up by one pass of an automaton over each file (functions/literals.py). A user's own
rules are Spark's regular expressions, so with such a rule all lines go through rlike."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import Scanner
from ..functions.rules import any_rule, hints_in, rules
from ..functions.rust_items import Unbalanced, items
from ..functions.text import lines_of
from ..sources.tables import bound_batches

BEFORE, AFTER = 10, 80
# Comment lines that set context apart from a function's body.
USES_HEADER = "// --- file-level uses (context) ---"
SCOPE_HEADER = "// --- enclosing scope (context) ---"
KEYS = ["target", "crate", "rel_path"]
ITEMS = "array<struct<start_line:int,end_line:int,headers:array<string>>>"


def gated(files: DataFrame, mode: str, extra: list[tuple[str, str]] | None) -> DataFrame:
    """Files that hold a hit at all, by one look at the whole content."""
    return files.filter(any_rule(F.col("content"), rules(mode, extra)))


def hit_lines(files: DataFrame, mode: str, extra: list[tuple[str, str]] | None) -> DataFrame:
    """Files with a hit: keys, content, n_lines, and hits, an array of (line from 0, hints in the rules' order)."""
    catalogue = rules(mode, extra)
    if extra:
        rows = gated(files, mode, extra).select(*KEYS, "content", lines_of(F.col("content")).alias("lines"))
        # few lines hit, so they are named only after a look at all
        some = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda t: any_rule(t["x"], catalogue))
        named = F.filter(F.transform(some, lambda t: F.struct(t["i"].alias("i"), hints_in(t["x"], catalogue).alias("h"))), lambda t: F.size(t["h"]) > 0)
        # one list or none: a filter on hits would be pushed down and find them twice
        return rows.select(*KEYS, "content", F.size("lines").alias("n_lines"), F.explode(F.filter(F.array(named), lambda h: F.size(h) > 0)).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(catalogue)
        kind = pa.list_(pa.struct([("i", pa.int32()), ("h", pa.list_(pa.string()))]))
        for b in batches:
            at, sizes, hits = [], [], []
            for k, content in enumerate(b.column("content")):
                text = content.as_py()
                if text and (found := scanner.hits(text)):
                    at.append(k)
                    sizes.append(text.count("\n") + 1)
                    hits.append([{"i": i, "h": h} for i, h in found])
            kept = b.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in (*KEYS, "content")), pa.array(sizes, pa.int32()), pa.array(hits, kind)], names=[*KEYS, "content", "n_lines", "hits"])

    bound_batches(files.sparkSession)
    return files.select(*KEYS, "content").mapInArrow(run, f"{declared(files)}, n_lines int, hits array<struct<i:int,h:array<string>>>")


def declared(files: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.select(*KEYS, "content").schema)


def line_hits(files: DataFrame, mode: str = "safety", extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per line and hint: keys, line (from 1), hint."""
    lines = hit_lines(files, mode, extra).select(*KEYS, F.explode("hits").alias("t"))
    return lines.select(*KEYS, (F.col("t.i") + 1).alias("line"), F.explode("t.h").alias("hint"))


def file_chunks(files: DataFrame, mode: str = "safety", extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """A chunk for each file with a hit: all of it."""
    hints = F.array_distinct(F.flatten(F.transform("hits", lambda t: t["h"])))
    return hit_lines(files, mode, extra).select(*KEYS, F.lit(1).alias("start_line"), F.col("n_lines").alias("end_line"), "content", hints.alias("hints"))


def window_chunks(files: DataFrame, mode: str = "safety", before: int = BEFORE, after: int = AFTER, extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """Windows around hit lines; windows that overlap or touch are one chunk."""
    rows = hit_lines(files, mode, extra).withColumn("lines", lines_of(F.col("content")))
    named = F.col("hits")
    last = F.size("lines") - 1
    windows = F.transform(named, lambda t: F.struct(F.greatest(t["i"] - before, F.lit(0)).alias("s"), F.least(t["i"] + after, last).alias("e"), t["h"].alias("h")))
    rows = rows.withColumn("hits", windows)

    # both ends grow from window to window, so a chunk begins where a window stands apart from the one before it
    def begins(k: Column) -> Column:
        return (k <= F.size("hits")) & ((k == 1) | (F.get("hits", k - 1)["s"] > F.get("hits", F.greatest(k - 2, F.lit(0)))["e"] + 1))

    rows = rows.withColumn("first", F.filter(F.sequence(F.lit(1), F.greatest(F.size("hits"), F.lit(1))), begins))

    def island(k: Column, j: Column) -> Column:
        end = F.coalesce(F.get("first", j + 1) - 1, F.size("hits"))
        hints = F.array_distinct(F.flatten(F.transform(F.slice("hits", k, end - k + 1), lambda w: w["h"])))
        return F.struct(F.element_at("hits", k)["s"].alias("s"), F.element_at("hits", end)["e"].alias("e"), hints.alias("h"))

    islands = F.transform("first", island)
    return rows.withColumn("w", F.explode(islands)).select(*KEYS, (F.col("w.s") + 1).alias("start_line"), (F.col("w.e") + 1).alias("end_line"), F.array_join(F.slice("lines", F.col("w.s") + 1, F.col("w.e") - F.col("w.s") + 1), "\n").alias("content"), F.col("w.h").alias("hints"))


def windows_of(hits: list[tuple[int, list[str]]], n_lines: int, before: int = BEFORE, after: int = AFTER) -> list[dict]:
    """Windows around hits of one file, as window_chunks makes them."""
    out: list[dict] = []
    for i, hints in hits:
        start, end = max(i - before, 0) + 1, min(i + after, n_lines - 1) + 1
        if out and start <= out[-1]["end_line"] + 1:
            out[-1]["end_line"] = end
            out[-1]["hints"] += [h for h in hints if h not in out[-1]["hints"]]
        else:
            out.append({"start_line": start, "end_line": end, "headers": [], "hints": list(hints)})
    return out


def with_items(files: DataFrame, mode: str | None = None) -> DataFrame:
    """files with parse_ok, functions and use_lines. With a mode: only files in which a literal of its rules stands, and
    of their functions those with a hit, with `hints`. A match may span lines of a function, so its whole text is looked
    at, for the rules whose literals stand in its lines. Of a file that can't be parsed windows stand for functions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules(mode)) if mode else None
        kind = pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("headers", pa.list_(pa.string())), *([("hints", pa.list_(pa.string()))] if mode else [])]))
        for b in batches:
            at, ok, functions, uses = [], [], [], []
            for k, content in enumerate(b.column("content").to_pylist()):
                some = list(scanner.candidates(content or "")) if scanner else []
                if scanner and not some:
                    continue
                at.append(k)
                try:
                    found, used = items(content or "")
                    ok.append(True)
                    functions.append(scanner.functions(content, some, found) if scanner else [f._asdict() for f in found])
                    uses.append(used)
                except Unbalanced:
                    ok.append(False)
                    functions.append(windows_of(scanner.hits(content), content.count("\n") + 1) if scanner else [])
                    uses.append([])
            kept = b.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in (*KEYS, "content")), pa.array(ok, pa.bool_()), pa.array(functions, kind), pa.array(uses, pa.list_(pa.int32()))], names=[*KEYS, "content", "parse_ok", "functions", "use_lines"])

    functions = ITEMS[:-2] + ",hints:array<string>>>" if mode else ITEMS
    bound_batches(files.sparkSession)
    return files.select(*KEYS, "content").mapInArrow(run, f"{declared(files)}, parse_ok boolean, functions {functions}, use_lines array<int>")


def preamble(lines: Column, use_lines: Column, headers: Column, start: Column, end: Column, body: Column) -> Column:
    """The body, under leading use lines and enclosing headers if there are any; line numbers are the file's."""
    uses = F.filter(F.transform(use_lines, lambda i: F.element_at(lines, i)), lambda s: s != "")
    none = F.expr("cast(array() as array<string>)")
    parts = F.concat(F.when(F.size(uses) > 0, F.concat(F.array(F.lit(USES_HEADER)), uses)).otherwise(none), F.when(F.size(headers) > 0, F.concat(F.array(F.lit(SCOPE_HEADER)), F.transform(headers, lambda h: F.concat(F.lit("// "), h)))).otherwise(none))
    marker = F.concat(F.lit("// --- function body @ lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" ---"))
    return F.when(F.size(parts) > 0, F.concat_ws("\n", F.array_join(parts, "\n"), marker, body)).otherwise(body)


def function_chunks(parsed: DataFrame, mode: str = "safety", extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """A chunk for each function whose lines hold a hit. parsed comes from with_items, with the same mode or none."""
    return ranged(parsed.filter("parse_ok"), mode, extra)


def ranged(parsed: DataFrame, mode: str, extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """A chunk for each range of lines in `functions`."""
    rows = parsed.withColumn("lines", lines_of(F.col("content"))).select(*KEYS, "lines", "use_lines", F.explode("functions").alias("f"))
    rows = rows.withColumn("body", F.array_join(F.slice("lines", F.col("f.start_line"), F.col("f.end_line") - F.col("f.start_line") + 1), "\n"))
    named = "hints" in parsed.schema["functions"].dataType.elementType.names
    rows = rows.withColumn("hints", F.col("f.hints") if named else hints_in(F.col("body"), rules(mode, extra))).filter(F.size("hints") > 0)
    return rows.select(*KEYS, F.col("f.start_line").alias("start_line"), F.col("f.end_line").alias("end_line"), preamble(F.col("lines"), F.col("use_lines"), F.col("f.headers"), F.col("f.start_line"), F.col("f.end_line"), F.col("body")).alias("content"), "hints")


def chunk(files: DataFrame, unit: str = "ast-function", mode: str = "safety", extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """Chunks of a unit: file, function (windows) or ast-function (functions; windows where a file can't be parsed)."""
    if unit == "file":
        return file_chunks(files, mode, extra)
    if unit == "function":
        return window_chunks(files, mode, extra=extra)
    if unit != "ast-function":
        raise ValueError(f"unknown unit {unit!r}")
    if not extra:
        return ranged(with_items(files, mode), mode)
    parsed = with_items(gated(files, mode, extra))
    return function_chunks(parsed, mode, extra).unionByName(window_chunks(parsed.filter("not parse_ok"), mode, extra=extra))


def chunk_listing(chunks: DataFrame) -> DataFrame:
    """What a scan would send, without the text."""
    return chunks.select(*KEYS, "start_line", "end_line", F.array_join("hints", ", ").alias("hints"))


def hint_counts(chunks: DataFrame) -> DataFrame:
    return chunks.select("target", "crate", F.explode("hints").alias("hint")).groupBy("target", "crate", "hint").agg(F.count(F.lit(1)).alias("chunks"))
