"""Tables of this library's shapes, derived from the given tables by arithmetic that SQL shares (see queries.py)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.model import Asking
from ..schemas import SEVERITIES

#: Risky code by remainder, appended to lines.
TOKENS = {0: " unsafe {", 1: " x.unwrap();", 2: " y as u32;", 3: " HashMap::new();", 4: " loop {", 5: " let _ = f();", 6: " m.lock();"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token(number: Column) -> Column:
    out = F.lit("")
    for k, t in TOKENS.items():
        out = F.when(number == k, t).otherwise(out)
    return out


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each document, a risky token at the end of some lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l"))
    content = F.array_join(F.transform("l", lambda x, i: F.concat(x, token((F.col("doc_id") * 31 + i) % 13))), "\n")
    return d.select(F.col("lang").alias("target"), F.col("source").alias("crate"), F.concat(F.lit("src/d"), "doc_id", F.lit(".rs")).alias("rel_path"), content.alias("content"))


def long_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document twelve times over, with few hits, so that windows stay apart or touch."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.flatten(F.array_repeat(F.split(F.coalesce("text", F.lit("")), "\n", -1), 12)).alias("l"))
    hit = lambda i: ((i * 7919 + F.col("doc_id")) % 97 == 0) | ((i * 31 + F.col("doc_id")) % 389 == 0)
    content = F.array_join(F.transform("l", lambda x, i: F.concat(x, F.when(hit(i), token(i % 4)).otherwise(""))), "\n")
    return d.select(F.col("lang").alias("target"), F.col("source").alias("crate"), F.concat(F.lit("src/d"), "doc_id", F.lit(".rs")).alias("rel_path"), content.alias("content"))


def function_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line a function of three lines; with odd doc_id inside an impl under a use line."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l"))
    body = F.array_join(F.transform("l", lambda x, i: F.concat(F.lit("fn f"), i.cast("string"), F.lit("() {\n  g(); // "), F.regexp_replace(x, "[^A-Za-z0-9 ]", ""), token((F.col("doc_id") * 31 + i) % 5 + F.when((F.col("doc_id") + i) % 3 == 0, 0).otherwise(100)), F.lit("\n}"))), "\n")
    # braces of tokens stand in comments
    content = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("use std::fs;\nimpl T {\n"), body, F.lit("\n}\n"))).otherwise(body)
    return d.select(F.col("lang").alias("target"), F.col("source").alias("crate"), F.concat(F.lit("src/d"), "doc_id", F.lit(".rs")).alias("rel_path"), content.alias("content"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each line item. Items that share order and line are numbered, so that ord is unique."""
    li = table(spark, sf_dir, "lineitem")
    k = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*(c for c in li.columns if c not in ("l_orderkey", "l_linenumber"))))
    start = (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("int")
    return li.withColumn("k", k).select(
        F.concat(F.lit("t"), (F.col("l_suppkey") % 20).cast("string")).alias("target"), F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit("c"), (F.col("l_suppkey") % 4).cast("string"))).alias("crate"),
        F.when(F.col("l_returnflag") == "A", "SQL_Injection").when(F.col("l_returnflag") == "N", "weak crypto").otherwise("sqli").alias("rule_id"),
        F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), F.month("l_shipdate") % 5 + 1).alias("severity"), F.when(F.col("l_linenumber") % 3 == 0, "CWE-89").alias("cwe"),
        F.concat(F.lit("src/f"), (F.col("l_partkey") % 50).cast("string"), F.lit(".rs")).alias("file"), start.alias("line_start"), (start + F.col("l_suppkey") % 5).cast("int").alias("line_end"),
        F.concat(F.lit("<s> & "), F.col("l_partkey").cast("string")).alias("summary"), F.concat(F.lit("e "), F.col("l_partkey").cast("string")).alias("evidence"), F.lit("f").alias("fix_suggestion"), (F.col("l_discount") * 10).alias("confidence"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000 + F.col("k")).cast("bigint").alias("ord"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    start = (F.col("p_size") + 10).cast("int")
    return p.select(
        F.concat(F.lit("t"), (key % 20).cast("string")).alias("target"), key.cast("int").alias("ord"), F.concat(F.lit("p"), key.cast("string")).alias("id"), F.concat(F.lit("src/f"), (F.floor(key / 20) % 50).cast("string"), F.lit(".rs")).alias("file"),
        start.alias("line_start"), (start + key % 7).cast("int").alias("line_end"), F.when(key % 3 == 0, "sql-injection").when(key % 3 == 1, "weak-crypto").otherwise("toctou").alias("category"), F.lit(None).cast("string").alias("cwe"),
        F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), (key % 5 + 1).cast("int")).alias("severity"), (key % 4 != 0).alias("must_detect"), F.when(key % 2 == 0, F.array(F.lit("sqli"))).otherwise(F.array(F.lit("weak_crypto"))).alias("aliases"), F.lit(None).cast("string").alias("notes"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty targets, and one without findings or entries."""
    own = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 21).alias("n")).distinct()
    return own.select(F.concat(F.lit("t"), F.col("n").cast("string")).alias("target"), F.lit(5).alias("line_slack"), F.array(*(F.lit(s) for s in SEVERITIES)).alias("severity_order"), F.lit(1).alias("schema_version"))


def crate_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, manifests, files): a workspace for each region, a member for each nation, a file for each customer."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    root = F.concat(F.lit("/w/t"), F.col("r_regionkey").cast("string"))
    top = region.select(F.concat(F.lit("t"), F.col("r_regionkey").cast("string")).alias("target"), root.alias("root"))
    even = F.col("r_regionkey") % 2 == 0
    none = F.expr("cast(array() as array<string>)")
    own = region.select(F.concat(F.lit("t"), F.col("r_regionkey").cast("string")).alias("target"), root.alias("dir"), F.when(even, F.col("r_name")).alias("package_name"), F.lit(True).alias("is_workspace"), F.when(even, F.array(F.lit("m*"))).otherwise(F.array(F.lit("m1"), F.lit("./m6"), F.lit("m999"), F.lit("m1?"))).alias("members"), F.array(F.lit("m3"), F.lit("m12")).alias("exclude"), F.lit(True).alias("parse_ok"))
    member = nation.select(F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("target"), F.concat(F.lit("/w/t"), F.col("n_regionkey").cast("string"), F.lit("/m"), F.col("n_nationkey").cast("string")).alias("dir"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("package_name"), F.lit(False).alias("is_workspace"), none.alias("members"), none.alias("exclude"), (F.col("n_nationkey") % 9 != 8).alias("parse_ok"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    inside = F.concat(F.when(F.col("c_custkey") % 11 == 0, F.lit("x")).otherwise(F.concat(F.lit("m"), F.col("n_nationkey").cast("string"))), F.lit("/src/c"), F.col("c_custkey").cast("string"), F.lit(".rs"))
    rows = c.select(F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("target"), F.concat(F.lit("/w/t"), F.col("n_regionkey").cast("string"), F.lit("/"), inside).alias("path"), inside.alias("rel_path"))
    return top, own.unionByName(member), rows


#: Evidence that stands in no file.
NOWHERE = "@@nowhere@@"


def model(reached: bool = False, repeats: bool = False):
    """A stand-in for a model, which answers by arithmetic on a file's number and its lines: some calls fail (unless it
    is `reached`), some evidence isn't there, some findings are given twice (if it `repeats`), and the judge rejects,
    lowers or confirms."""

    def call(request: dict) -> dict:
        prompt = request["user_prompt"]
        if request["max_tokens"] == 1024:
            n = int(re.search(r"^Place: \S+ \d+ to (\d+)$", prompt, re.MULTILINE)[1])
            answer = [{"verdict": "reject"}, {"verdict": "downgrade", "new_severity": "low"}, {"verdict": "confirm"}][n % 3]
            return {"text": "So: " + json.dumps(answer | {"reason": "as counted", "confidence": 1}), "input_tokens": n, "output_tokens": 1}
        head = re.match(r"Package .*\nSource (.*), from line \d+ to (\d+)\nRules that fired: (.*)\n~~~\n", prompt)
        doc, n = int(re.search(r"\d+", head[1])[0]), int(head[2])
        if doc % 7 == 3 and not reached:
            raise TimeoutError("no answer")
        evidence = NOWHERE if doc % 5 == 1 else prompt[head.end() :].rpartition("\n~~~\n")[0][:12]
        found = {"rule_id": head[3].split(" ")[0], "severity": ["critical", "high", "low"][doc % 3], "file": head[1], "line_start": 1, "line_end": n, "summary": "s", "evidence": evidence, "fix_suggestion": "f", "confidence": 0.5}
        return {"text": "```json\n" + json.dumps({"findings": [found] * (2 if repeats and doc % 6 == 5 else 1)}) + "\n```", "input_tokens": n, "output_tokens": 7}

    return call


def reached():
    """The stand-in, none of whose calls fails."""
    return model(reached=True)


def repeating():
    """The stand-in, which gives some findings twice."""
    return model(repeats=True)


#: The stand-in's calls fail at once: nothing is gained by waiting.
ASKING = Asking(delay=lambda attempt: 0.0)


def truth_of_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entries, targets) for the findings of a scan of files: an entry for every second file."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0")
    key = F.col("doc_id")
    aliases = F.when(key % 3 == 0, F.array(F.lit("unsafe"))).when(key % 3 == 1, F.array(F.lit("PANIC"))).otherwise(F.array(F.lit("cast"), F.lit("unsafe")))
    entries = d.select(
        F.col("lang").alias("target"), key.cast("int").alias("ord"), F.concat(F.lit("e"), key.cast("string")).alias("id"), F.concat(F.lit("src/d"), key.cast("string"), F.lit(".rs")).alias("file"), F.lit(2).alias("line_start"), F.lit(3).alias("line_end"), F.lit("Kept").alias("category"),
        F.lit(None).cast("string").alias("cwe"), F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), (key % 5 + 1).cast("int")).alias("severity"), (key % 5 != 0).alias("must_detect"), aliases.alias("aliases"), F.lit(None).cast("string").alias("notes"),
    )
    targets = table(spark, sf_dir, "documents").select(F.col("lang").alias("target")).distinct()
    return entries, targets.select("target", F.lit(5).alias("line_slack"), F.array(*(F.lit(s) for s in SEVERITIES)).alias("severity_order"), F.lit(1).alias("schema_version"))


def crowded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, entries, targets): all in one file and under one rule, on lines of a long file; some span much of it."""
    start = ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 100_000 + 1).cast("int")
    length = (F.col("l_quantity").cast("bigint") % 7 + F.when(F.col("l_suppkey") % 50 == 0, 700).otherwise(0)).cast("int")
    place = {"target": F.lit("t1"), "file": F.lit("src/long.rs")}
    li = table(spark, sf_dir, "lineitem")
    found = li.groupBy(*li.columns).agg(F.count(F.lit(1)).alias("n")).select("l_orderkey", start.alias("line_start"), (start + length).alias("line_end"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).withColumns(place | {"rule_id": F.lit("Long Rule"), "severity": F.lit("low")})
    k = F.col("p_partkey")
    begin = (k * 53 % 100_000 + 1).cast("int")
    end = (begin + F.col("p_size") % 9 + F.when(k % 97 == 0, 3000).otherwise(0)).cast("int")
    entries = table(spark, sf_dir, "part").select(k.cast("int").alias("ord"), F.concat(F.lit("p"), k.cast("string")).alias("id"), begin.alias("line_start"), end.alias("line_end"), F.lit("long-rule").alias("category"), F.lit("low").alias("severity"), (k % 4 != 0).alias("must_detect"), F.expr("cast(null as array<string>)").alias("aliases")).withColumns(place)
    return found, entries, targets(spark, sf_dir).filter("target = 't1'")
