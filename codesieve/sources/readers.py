"""Readers of source trees, manifests, reports, ground truth and cache logs."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DECISION, ENTRY, FINDING
from .tables import bound_batches
from .trees import Tree

#: Relative paths that are never sources.
IGNORED = [r"(^|/)target/", r"^node_modules/"]
HIDDEN = r"(^|/)\."
TARGET = r"^([^/]+)/(.*)$"
#: Entries of a truth file that are Python objects at once.
PART = 1000


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/")


def plain_root(root: str) -> str:
    """A root as plain_path gives paths below it."""
    base = root.rstrip("/")
    return "/" + base.split(":", 1)[-1].lstrip("/") if ":" in base else base


def below(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path (absolute), inside (relative to root) and content of files below root."""
    tree = Tree(spark, root, glob)
    plain = plain_root(root)
    path = plain_path(F.col("path"))
    return tree.contents(tree.names).select(path.alias("path"), path.substr(F.lit(len(plain) + 2), F.length(path)).alias("inside"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def read_sources(spark: SparkSession, root: str, ignored: list[str] | None = None, hidden: bool = False) -> DataFrame:
    """files of all projects below root, each in a folder of its own: target, path, rel_path, content."""
    rows = below(spark, root, "*.rs").select("path", F.regexp_extract("inside", TARGET, 1).alias("target"), F.regexp_extract("inside", TARGET, 2).alias("rel_path"), "content").filter("rel_path <> ''")
    for pattern in (IGNORED if ignored is None else ignored) + ([] if hidden else [HIDDEN]):
        rows = rows.filter(~F.col("rel_path").rlike(pattern))
    return rows.select("target", "path", "rel_path", "content")


def manifest(text: str) -> dict:
    """The parts of a package manifest that matter here."""
    try:
        doc = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return {"package_name": None, "is_workspace": None, "members": [], "exclude": [], "parse_ok": False}
    package, workspace = doc.get("package"), doc.get("workspace")
    name = package.get("name") if isinstance(package, dict) else None
    inner = workspace if isinstance(workspace, dict) else {}

    def strings(key: str) -> list[str]:
        return [x for x in inner.get(key) or [] if isinstance(x, str)]

    return {"package_name": name if isinstance(name, str) else None, "is_workspace": "workspace" in doc, "members": strings("members"), "exclude": strings("exclude"), "parse_ok": True}


def read_manifests(spark: SparkSession, root: str, name: str = "Cargo.toml") -> DataFrame:
    """target, dir (absolute) and the parsed manifest of every package below root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("target", pa.string()), ("dir", pa.string()), ("package_name", pa.string()), ("is_workspace", pa.bool_()), ("members", pa.list_(pa.string())), ("exclude", pa.list_(pa.string())), ("parse_ok", pa.bool_())])
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"target": r["target"], "dir": r["dir"], **manifest(r["content"] or "")} for r in b.to_pylist()], schema=schema)

    rows = below(spark, root, name).select(F.regexp_extract("inside", TARGET, 1).alias("target"), F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "content")
    return rows.mapInArrow(run, "target string, dir string, package_name string, is_workspace boolean, members array<string>, exclude array<string>, parse_ok boolean")


def reports_from(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of report texts (report, text): an object with a list `findings`, or a bare list. With `page`,
    of reports in numbered pages, `ord` counts through a report's pages."""
    trimmed = F.regexp_replace("text", r"^\s+", "")
    # a text that begins with a bracket is no array, though get_json_object gives both alike
    is_array = F.from_json("text", "findings array<string>")["findings"].isNotNull()
    body = F.when(trimmed.startswith("["), trimmed).when(is_array, F.get_json_object("text", "$.findings"))
    fields = ",".join(x.strip().replace(" ", ":") for x in ("crate string, " + FINDING).split(","))
    page = F.col("page") if "page" in texts.columns else F.lit(0)
    rows = texts.select("report", page.cast("bigint").alias("page"), body.alias("body")).withColumn("list", F.when(F.col("body").startswith("["), F.from_json("body", f"array<struct<{fields}>>")))
    # outer, as Spark would else filter by the list's size before, and parse each text twice for that
    findings = rows.select("report", "page", F.posexplode_outer("list").alias("ord", "f")).filter("ord is not null").select("report", (F.shiftleft("page", 32) + F.col("ord")).alias("ord"), "f.*")
    return findings, rows.filter("list is null").select("report", F.lit("no findings array").alias("problem"))


def read_reports(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of the JSON reports at path; `report` is the file's name without its ending."""
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)
    findings, errors = reports_from(spark.read.text(path, wholetext=True).select(name.alias("report"), F.col("value").alias("text")))
    if strict and not errors.isEmpty():
        raise ValueError(f"no findings array in {[r['report'] for r in errors.limit(20).collect()]}")
    return findings, errors


def truth_from(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, entries, problems) of YAML texts (file, text), one for each target. Missing aliases are an empty list;
    types aren't checked here but in validate_ground_truth, where a value of another type is missing. A text that isn't
    YAML, or no mapping, is a row of problems (file, problem), and all others are read."""
    entry = "array<struct<" + ",".join(x.strip().replace(" ", ":") for x in ENTRY.split(",")) + ">>"
    kinds = {"string": str, "int": int, "boolean": bool, "array<string>": list}
    fields = [x.strip().split(" ") for x in ENTRY.split(",")]

    def typed(v: object, kind: str) -> object:
        if kind == "array<string>":
            return [x if isinstance(x, str) else str(x) for x in v if x is not None] if isinstance(v, list) else None
        return v if isinstance(v, kinds[kind]) and not (kind == "int" and (isinstance(v, bool) or abs(v) >= 1 << 31)) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        from ..functions import truth_yaml

        arrow = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        listed = pa.list_(pa.struct([(n, arrow[k]) for n, k in fields]))
        schema = pa.schema([("file", pa.string()), ("problem", pa.string()), ("target", pa.string()), ("line_slack", pa.int32()), ("severity_order", pa.list_(pa.string())), ("schema_version", pa.int32()), ("first", pa.int64()), ("entries", listed)])

        def parsed(text: str) -> tuple[dict, list[pa.Array]]:
            """A file's own values, and its entries in parts: Arrow holds them until it is known that all can be read."""
            parts, few = [], []

            def begin() -> None:
                parts.clear(), few.clear()

            def pack() -> None:
                parts.append(pa.array([list(few)], listed))
                few.clear()

            def sink(e: object) -> None:
                if isinstance(e, dict):
                    few.append({n: typed([] if n == "aliases" and n not in e else e.get(n), k) for n, k in fields})
                    if len(few) == PART:
                        pack()

            try:
                doc = truth_yaml.load(text, begin, sink)
            except (yaml.YAMLError, ValueError, RecursionError) as e:
                return {"problem": f"not YAML: {type(e).__name__}"}, [pa.array([[]], listed)]
            if not isinstance(doc, dict):
                return {"problem": "no mapping"}, [pa.array([[]], listed)]
            if few or not parts:
                pack()
            policy = doc["match_policy"] if isinstance(doc.get("match_policy"), dict) else {}
            return {"target": typed(doc.get("target"), "string"), "line_slack": typed(policy.get("line_slack"), "int"), "severity_order": typed(policy.get("severity_order"), "array<string>"), "schema_version": typed(doc.get("schema_version"), "int")}, parts

        for b in batches:
            for file, text in zip(b.column("file"), b.column("text"), strict=True):
                own, parts = parsed(text.as_py() or "")
                for k, part in enumerate(parts):
                    row = {"file": file.as_py(), "first": k * PART} | own
                    yield pa.RecordBatch.from_arrays([part if n == "entries" else pa.array([row.get(n)], schema.field(n).type) for n in schema.names], schema=schema)

    bound_batches(texts.sparkSession)
    rows = texts.select("file", "text").mapInArrow(run, f"file string, problem string, target string, line_slack int, severity_order array<string>, schema_version int, first bigint, entries {entry}")
    good = rows.filter("problem is null")
    entries = good.select("target", "first", F.posexplode("entries").alias("at", "e")).select("target", (F.col("first") + F.col("at")).cast("int").alias("ord"), "e.*")
    return good.filter("first = 0").select("target", "line_slack", "severity_order", "schema_version"), entries, rows.filter("problem is not null").select("file", "problem")


def read_truth_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, entries, problems) of the YAML files at path. Spark's readers pass over files of no bytes."""
    return truth_from(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def read_ground_truth(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(targets, entries) of the YAML files at path that can be read; strict raises if one can't."""
    targets, entries, problems = read_truth_files(spark, path)
    if strict and (some := problems.limit(20).collect()):
        raise ValueError("bad ground truth: " + "; ".join(f"{r['file']}: {r['problem']}" for r in some))
    return targets, entries


def latest(records: DataFrame) -> DataFrame:
    """The last record of each key. Only keys and places take part until one is chosen."""
    return records.groupBy("target", "config_hash", "type", "key").agg(F.max_by(F.struct("findings", "decision", "input_tokens", "output_tokens", "seq"), "seq").alias("r")).select("target", "config_hash", "type", "key", "r.*")


def records_from(lines: DataFrame) -> DataFrame:
    """Cache records of log lines (target, config_hash, seq, value): blank and broken lines and other types are left out."""
    schema = f"type string, chunkKey string, findingKey string, findings string, decision {DECISION}, inputTokens bigint, outputTokens bigint, torn string"
    r = F.from_json(F.trim("value"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "torn"})
    rows = lines.select("target", "config_hash", "seq", r.alias("r")).filter("r.torn is null and r.type in ('chunk', 'judge')")
    key = F.when(F.col("r.type") == "chunk", F.col("r.chunkKey")).otherwise(F.col("r.findingKey"))
    return rows.select("target", "config_hash", F.col("r.type").alias("type"), key.alias("key"), F.col("r.findings").alias("findings"), F.col("r.decision").alias("decision"), F.col("r.inputTokens").alias("input_tokens"), F.col("r.outputTokens").alias("output_tokens"), "seq").filter("key is not null")


def read_cache_log(spark: SparkSession, path: str, config: str, target: str) -> DataFrame:
    """The state that a project's line log holds: its last record of each key. Lines count in the order of the files'
    names, and in a file in their own; `seq` says no more than that, so it is null."""
    # Spark deals blocks of files by size: a line's place is its file, its block, and its place in the block
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(F.lit(target).alias("target"), F.lit(config).alias("config_hash"), place.alias("seq"), "value")
    return latest(records_from(lines)).withColumn("seq", F.lit(None).cast("bigint"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The state of the Parquet cache (see cache.read_cache)."""
    from .cache import read_cache as read

    return read(spark, path)
