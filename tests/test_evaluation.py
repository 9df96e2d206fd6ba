import json

import pytest
from pyspark.sql import functions as F

from codesieve.operators import evaluation as ev
from codesieve.schemas import ENTRIES, FINDINGS, SEVERITIES, TRUTH


def truth(spark, *entries, slack=5):
    rows = [("t", i, e.get("id", f"e{i}"), e.get("file", "f"), e.get("a", 10), e.get("b", 15), e.get("category", "sql-injection"), None, e.get("severity", "high"), e.get("must", True), e.get("aliases", ["sqli"]), None) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, ENTRIES), spark.createDataFrame([("t", slack, SEVERITIES, 1), ("empty", slack, SEVERITIES, 1)], TRUTH)


def reported(spark, *findings):
    return spark.createDataFrame([("t", "c", f.get("rule", "sqli"), f.get("severity", "high"), None, f.get("file", "f"), f.get("a", 10), f.get("b", 10), "s", "e", "x", 0.5, i) for i, f in enumerate(findings)], FINDINGS)


@pytest.mark.parametrize(("finding", "kind"), [
    ({"a": 5, "b": 5}, "must"), ({"a": 4, "b": 4}, "none"), ({"a": 20, "b": 20}, "must"), ({"a": 21, "b": 30}, "none"), ({"rule": "SQL_Injection"}, "must"), ({"rule": "sql  injection"}, "must"),
    ({"rule": "other"}, "none"), ({"file": "F"}, "none"),
])
def test_match(spark, finding, kind):
    e, t = truth(spark, {})
    assert [r.match_kind for r in ev.match_findings(reported(spark, finding), e, t).collect()] == [kind]


def test_nearest_midpoint_then_first_entry(spark):
    e, t = truth(spark, {"a": 10, "b": 10}, {"a": 14, "b": 14, "must": False}, {"a": 12, "b": 16})
    got = {r.ord: (r.matched_id, r.match_kind) for r in ev.match_findings(reported(spark, {"a": 11, "b": 11}, {"a": 14, "b": 14}, {"a": 12, "b": 12}), e, t).collect()}
    assert got == {0: ("e0", "must"), 1: ("e1", "bonus"), 2: ("e0", "must")}


def test_metrics(spark):
    e, t = truth(spark, {}, {"file": "g"}, {"file": "h", "must": False, "severity": "low"})
    f = reported(spark, {}, {}, {"file": "h", "severity": "info"}, {"file": "nowhere"})
    m = ev.match_findings(f, e, t)
    got = {r.target: r.asDict() for r in ev.evaluate(m, e, t, pooled=True).collect()}
    own = got["t"]
    assert (own["must_total"], own["must_hit"], own["bonus_total"], own["bonus_hit"], own["reported_total"], own["true_positives"], own["false_positives"]) == (2, 1, 1, 1, 4, 3, 1)
    assert (own["recall"], own["precision"]) == (0.5, 0.75)
    assert (got["empty"]["recall"], got["empty"]["precision"]) == (1.0, 1.0)
    assert got[None]["reported_total"] == 4
    assert [r.id for r in ev.missed_entries(m, e).collect()] == ["e1"]
    assert [r.file for r in ev.false_positives(m).collect()] == ["nowhere"]
    cells = {(r.expected, r.reported): r.findings for r in ev.severity_matrix(m, t).filter("target = 't'").collect()}
    assert len(cells) == 25 and cells["high", "high"] == 2 and cells["low", "info"] == 1 and sum(cells.values()) == 3
    wide = {r.expected: r.asDict() for r in ev.severity_matrix_wide(ev.severity_matrix(m, t)).filter("target = 't'").collect()}
    assert wide["low"]["info"] == 1 and wide["high"]["low"] == 0
    summary = ev.evaluate(m, e, t)
    gates = {r.target: (r.failures, r.passed) for r in ev.gate(summary, 0.8, 0.7).collect()}
    assert gates["t"] == (["recall 50.0% < min 80.0%"], False) and gates["empty"] == ([], True)
    assert all(r.passed for r in ev.gate(summary).collect())
    report = json.loads(ev.eval_report(summary, m, e, t).filter("target = 't'").first().report)
    assert report["must"]["missed"][0]["id"] == "e1" and report["reported"]["false_positives"][0]["file"] == "nowhere" and report["severity_confusion"][1][1] == 2
    lines = {"t": [], "empty": []}
    for r in ev.eval_text(summary, m, e, t).orderBy("target", "section", "place").collect():
        lines[r.target].append(r.line)
    assert lines["t"][:4] == ["Results for t", "recall: 1 of 2, 50.0%", "precision: 3 of 4, 75.0%", "extra entries found: 1 of 1"]
    assert [x.split(" | ")[0] for x in lines["t"][4:8]] == ["not found: 1", "e1", "reported without cause: 1", "nowhere 10 to 10"]
    assert len(lines["t"]) == 13 and lines["t"][9] == "high reported as: critical 0, high 2, medium 0, low 0, info 0"
    assert lines["empty"] == ["Results for empty", "recall: 0 of 0, 100.0%", "precision: 0 of 0, 100.0%"]


def test_report_page_by_page(spark):
    e, t = truth(spark, *({"file": f"m{i}"} for i in range(3)))
    m = ev.match_findings(reported(spark, *({"file": f"w{i}"} for i in range(5))), e, t)
    got = {(r.target, r.page): json.loads(r.report) for r in ev.eval_report(ev.evaluate(m, e, t), m, e, t, size=2).collect()}
    assert sorted(got) == [("empty", 1), ("t", 1), ("t", 2), ("t", 3)]
    pages = [got["t", k] for k in (1, 2, 3)]
    assert [x["file"] for p in pages for x in p["reported"]["false_positives"]] == [f"w{i}" for i in range(5)] and [x["id"] for p in pages for x in p["must"]["missed"]] == ["e0", "e1", "e2"]
    assert {(p["pages"], p["reported"]["total"], p["must"]["total"]) for p in pages} == {(3, 5, 3)} and got["empty", 1]["reported"]["false_positives"] == []


def test_repeated_severity_counts_at_its_last_place(spark):
    e, _ = truth(spark, {})
    order = ["critical", "high", "high", "low", "info"]
    t = spark.createDataFrame([("t", 5, order, 1)], TRUTH)
    cells = {(r.row, r.column): r.findings for r in ev.severity_matrix(ev.match_findings(reported(spark, {}), e, t), t).collect()}
    assert cells[2, 2] == 1 and cells[1, 1] == 0


def test_validation(spark):
    e, t = truth(spark, {"id": "x"}, {"id": "x", "a": 0}, {"id": "", "b": 1}, {"severity": "bad", "file": ""})
    got = {(r.id, r.problem) for r in ev.validate_ground_truth(t, e).collect()}
    assert got == {("x", "id is not unique"), ("x", "line_start is not positive"), ("", "id is empty"), ("", "line_end is before line_start"), ("e3", "unknown severity"), ("e3", "file is empty")}
    with pytest.raises(ValueError):
        ev.validate_ground_truth(t, e, strict=True)
    bad = spark.createDataFrame([("u", -1, ["high"], 1)], TRUTH)
    assert ev.validate_ground_truth(bad, e.limit(0)).count() == 2


def test_stability(spark):
    f = reported(spark, {}, {"a": 20, "b": 20}, {}, {"rule": "SQLI"}, {"file": "z"}).withColumn("run", F.when(F.col("ord") < 2, 0).when(F.col("ord") < 3, 1).otherwise(2))
    r = ev.stability(f).first()
    assert r.pairs == 3 and r.jaccard == pytest.approx((1 / 2 + 1 / 3 + 1 / 2) / 3)
    nothing = spark.createDataFrame([("t", 0), ("t", 1)], "target string, run int").select("target", "run", *(F.lit(None).cast(k).alias(n) for n, k in (("file", "string"), ("rule_id", "string"), ("line_start", "int"), ("line_end", "int"))))
    assert ev.stability(nothing).first().jaccard == 1.0


def test_patched_control(spark):
    e, t = truth(spark, {}, {"file": "g"})
    before, after = (ev.match_findings(f, e, t) for f in (reported(spark, {}, {"file": "g"}), reported(spark, {"file": "g"})))
    assert {r.id: r.fixed for r in ev.patched_control(before, after, e).collect()} == {"e0": True, "e1": False}
