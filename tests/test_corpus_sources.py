import json
import os

import pytest
from pyspark.sql import functions as F

from codesieve.operators import corpus
from codesieve.schemas import FILES, FINDINGS
from codesieve.sources import readers, writers
from codesieve.streaming.incremental import incremental_scan


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def project(tmp_path):
    write(tmp_path, {
        "p/Cargo.toml": '[package]\nname = "root"\n[workspace]\nmembers = ["crates/*", "./tool", "gone"]\nexclude = ["crates/old"]\n',
        "p/crates/a/Cargo.toml": '[package]\nname = "a"\n', "p/crates/old/Cargo.toml": '[package]\nname = "old"\n', "p/crates/bad/Cargo.toml": "[[[", "p/tool/Cargo.toml": "[package]\nname = 3\n",
        "p/src/lib.rs": "fn a() { unsafe {} }\n", "p/crates/a/src/x.rs": b"caf\xff", "p/crates/old/src/o.rs": "o", "p/target/gen.rs": "g", "p/crates/a/target/g.rs": "g", "p/.hidden/h.rs": "h", "p/tool/t.rs": "t",
        "q/Cargo.toml": "[package]\nversion = '1'\n", "q/main.rs": "fn main() {}\n\n",
    })
    return tmp_path


def test_crates_and_files(spark, project):
    manifests = readers.read_manifests(spark, str(project))
    targets = spark.createDataFrame([("p", f"{project}/p"), ("q", f"{project}/q"), ("none", "/none")], "target string, root string")
    crates = corpus.resolve_crates(targets, manifests)
    assert sorted((r.target, r.name, r.root_dir.removeprefix(f"{project}/")) for r in crates.collect()) == [("p", "a", "p/crates/a"), ("p", "root", "p"), ("p", "tool", "p/tool"), ("q", "q", "q")]
    assert [r.target for r in corpus.bad_targets(targets, manifests).collect()] == ["none"]
    assert {r.target: (r.project_name, r.is_workspace) for r in corpus.project_info(targets, manifests).collect()} == {"p": ("root", True), "q": ("q", False)}
    files = corpus.attribute_files(readers.read_sources(spark, str(project)), crates)
    got = {r.rel_path: (r.target, r.crate, r.content) for r in files.collect()}
    assert {k: v[1] for k, v in got.items()} == {"src/lib.rs": "root", "crates/a/src/x.rs": "a", "crates/old/src/o.rs": "root", "tool/t.rs": "tool", "main.rs": "q"}
    assert got["crates/a/src/x.rs"][2] == "caf�"
    assert [r.rel_path for r in corpus.limit_files(files.filter("target = 'p'"), crates, 1).collect()] == ["crates/a/src/x.rs"]
    assert corpus.limit_files(files, crates, 0).count() == 5
    assert {r.target: (r.files, r.lines) for r in corpus.corpus_stats(files).collect()} == {"p": (4, 4), "q": (1, 2)}
    inner = corpus.attribute_files(readers.read_sources(spark, str(project)), corpus.filter_crates(crates, ["root"]))
    assert {r.crate for r in inner.collect()} == {"root"}
    with pytest.raises(ValueError):
        corpus.filter_crates(crates, ["nope"])


def test_reports(spark, tmp_path):
    f = {"rule_id": "r", "severity": "low", "file": "f", "line_start": 1, "line_end": 1, "summary": "", "evidence": "", "fix_suggestion": "", "confidence": 1}
    write(tmp_path, {"full.json": json.dumps({"scan": {}, "findings": [f, f]}), "bare.json": json.dumps([f]), "bad.json": "{}", "empty.json": '{"findings": []}'})
    findings, errors = readers.read_reports(spark, str(tmp_path))
    assert sorted((r.report, r.ord) for r in findings.collect()) == [("bare", 0), ("full", 0), ("full", 1)]
    assert [r.report for r in errors.collect()] == ["bad"]
    with pytest.raises(ValueError):
        readers.read_reports(spark, str(tmp_path), strict=True)


def test_ground_truth(spark, tmp_path):
    write(tmp_path, {"t.yaml": "target: t\nschema_version: 1\nmatch_policy:\n  line_slack: 5\n  severity_order: [critical, high, medium, low, info]\nfindings:\n  - {id: a, file: f, line_start: 1, line_end: 2, category: c, severity: low, must_detect: true}\n  - {id: b, file: f, line_start: x, line_end: 2, category: c, severity: low, must_detect: false, aliases: [d]}\n"})
    targets, entries = readers.read_ground_truth(spark, str(tmp_path))
    assert targets.first().line_slack == 5
    assert [(r.ord, r.id, r.line_start, r.aliases) for r in entries.orderBy("ord").collect()] == [(0, "a", 1, []), (1, "b", None, ["d"])]


def test_cache_log(spark, tmp_path):
    lines = ['{"type":"meta"}', '{"type":"chunk","chunkKey":"k","findings":[],"inputTokens":1,"outputTokens":1}', "", '{"type":"chunk","chunkKey":"k","findings":[1],"inputTokens":2,"outputTokens":1}', '{"type":"judge","findingKey":"k","decision":{"kind":"keep"},"inputTokens":3,"outputTokens":1}', '{"type":"chunk","chu']
    write(tmp_path, {"log.jsonl": "\n".join(lines)})
    got = {(r.type, r.key): (r.findings, r.input_tokens) for r in readers.read_cache_log(spark, str(tmp_path / "log.jsonl"), "h", "t").collect()}
    assert got == {("chunk", "k"): ("[1]", 2), ("judge", "k"): (None, 3)}


def test_cache_log_of_several_files(spark, tmp_path):
    """The last file wins, whichever is larger and in whatever blocks Spark reads them."""
    def line(n, pad=0):
        return json.dumps({"type": "chunk", "chunkKey": "k", "findings": [], "inputTokens": n, "outputTokens": 1, "pad": "x" * pad})

    write(tmp_path, {"a.jsonl": line(1), "b.jsonl": "\n".join([line(2)] + [line(3, 2000)] * 50 + [line(4)])})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "20000b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert [(r.target, r.input_tokens) for r in readers.read_cache_log(spark, str(tmp_path), "h", "t").collect()] == [("t", 4)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def findings(spark):
    return spark.createDataFrame([("t", "c", "r", "low", None, "a.rs", 1, 1, "<b>", "e", "x", 0.125, 0), ("t", None, "r", "critical", "CWE-1", "a.rs", 1, 3, "s", "e", "x", 1.0, 1)], FINDINGS)


def test_reports_out(spark):
    runs = spark.createDataFrame([("t", "P & Q"), ("u", "U")], "target string, title string").withColumn("info", F.array(F.struct(F.lit("a").alias("name"), F.lit("<").alias("value"))))
    pages = {r.target: r.html for r in writers.html_report(runs, findings(spark)).collect()}
    assert "No findings." in pages["u"] and "<title>P &amp; Q</title>" in pages["t"] and "<dd>&lt;</dd>" in pages["t"]
    assert pages["t"].index("critical") < pages["t"].index("&lt;b&gt;") and "a.rs:1-3" in pages["t"] and "c · a.rs:1<" in pages["t"] and "0.13" in pages["t"]
    assert "http" not in pages["t"]
    doc = json.loads(writers.findings_json(findings(spark), F.lit("2024-01-02 03:04:05").cast("timestamp")).first().json)
    assert doc["generated_at"] == "2024-01-02T03:04:05.000Z" and [f["severity"] for f in doc["findings"]] == ["critical", "low"]
    run = spark.createDataFrame([("t", 100, 50, 3, 1), ("u", 0, 0, 0, 0)], "target string, input_tokens bigint, output_tokens bigint, analyze_calls bigint, judge_calls bigint")
    run = run.withColumn("started_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).withColumn("finished_at", F.lit("2024-01-01 00:00:05").cast("timestamp"))
    for c in ("project", "model", "config"):
        run = run.withColumn(c, F.struct(F.lit(1).alias("x")))
    reports = {r.target: json.loads(r.report) for r in writers.scan_report(run, findings(spark)).collect()}
    assert reports["t"]["scan"]["duration_ms"] == 5000 and reports["t"]["tokens"]["total"] == 150 and len(reports["t"]["findings"]) == 2 and reports["u"]["findings"] == []
    names = spark.range(1).select(writers.report_name(F.lit("a/b"), F.lit(".."), F.lit("m 1")), writers.report_format(F.lit("x.JSON")), writers.report_format(F.lit("x"))).first()
    assert tuple(names) == ("a-b-scan-m-1.html", "json", "html")


def test_reports_page_by_page(spark):
    f = spark.createDataFrame([("t", "c", "r", "low", None, "a.rs", i, i, f"s{i:02}", "e", "x", 0.5, i) for i in range(7)], FINDINGS).repartition(3)
    runs = spark.createDataFrame([("t", "T"), ("u", "U")], "target string, title string").withColumn("info", F.array(F.struct(F.lit("a").alias("name"), F.lit("b").alias("value"))))
    pages = {(r.target, r.page): r.html for r in writers.html_report(runs, f, size=3).collect()}
    assert sorted(pages) == [("t", 1), ("t", 2), ("t", 3), ("u", 1)] and "0 finding(s)" in pages["u", 1]
    for k in (1, 2, 3):
        assert "7 finding(s)" in pages["t", k] and f"Page {k} of 3" in pages["t", k]
        assert [i for i in range(7) if f">s{i:02}<" in pages["t", k]] == list(range(7))[3 * k - 3 : 3 * k]
    docs = {r.page: json.loads(r.json) for r in writers.findings_json(f, F.lit("2024-01-02 03:04:05").cast("timestamp"), size=3).collect()}
    assert [x["line_start"] for k in sorted(docs) for x in docs[k]["findings"]] == list(range(7)) and docs[3]["findings_total"] == 7


def test_report_queries_hold_every_finding(spark):
    from codesieve.jobs import inputs, queries

    sf = "/root/testdata/sf0.001"
    want = {r.target: r["count"] for r in inputs.findings(spark, sf).groupBy("target").count().collect()}
    listed, rows = {}, {}
    for r in queries.scan_report(spark, sf).collect():
        doc = json.loads(r.report)
        assert doc["findings_total"] == want.get(r.target, 0) and doc["page"] == r.page and len(doc["findings"]) <= 500
        assert doc["tokens"]["total"] == doc["tokens"]["input"] + doc["tokens"]["output"]
        listed[r.target] = listed.get(r.target, 0) + len(doc["findings"])
    for r in queries.html_report(spark, sf).collect():
        assert f"<h2>{want.get(r.target, 0)} finding(s)</h2>" in r.html
        rows[r.target] = rows.get(r.target, 0) + r.html.count("<tr><td ")
    assert {t: n for t, n in listed.items() if n} == {t: n for t, n in rows.items() if n} == want and max(want.values()) > 500


def test_incremental_scan(spark, tmp_path):
    source, cache, checkpoint = (str(tmp_path / x) for x in ("source", "cache", "checkpoint"))

    def client():
        return lambda request: {"text": "{}", "input_tokens": 1, "output_tokens": 1}

    def scan(*contents):
        spark.createDataFrame([("t", "c", f"{i}.rs", c) for i, c in enumerate(contents)], FILES).write.mode("append").parquet(source)
        incremental_scan(spark, source, cache, checkpoint, "h", client).awaitTermination()
        return spark.read.parquet(cache).count()

    assert scan("fn a() { unsafe {} }", "fn b() {}") == 1
    assert scan("fn a() { unsafe {} }", "fn b() { x.unwrap() }") == 2  # one is known, one was edited
    assert readers.read_cache(spark, cache).count() == 2
    assert os.path.exists(checkpoint)
