import json
import random

import pytest
from pyspark.sql import functions as F

from codesieve.functions.replies import Invalid, finding, findings, object_in, verdict
from codesieve.functions.text import clean_name, collapse_ws, count_lines, escape_html, fixed, normalize_rule, number_text, percent
from codesieve.operators import analysis, judge, ordering
from codesieve.schemas import CACHE, CHUNKS, FILES, FINDINGS

GOOD = {"rule_id": "r", "severity": "high", "file": "f", "line_start": 1, "line_end": 2, "summary": "s", "evidence": "let  x", "fix_suggestion": "y", "confidence": 0.5}


def column(spark, kind, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_text_helpers(spark):
    assert column(spark, "string", ["", "a\nb\nc\n", "a\nb\nc", "\n"], count_lines) == [0, 3, 3, 1]
    assert column(spark, "string", ["a/b c", "..x..", "", "/", "a b"], clean_name) == ["a-b-c", "x", "scan", "scan", "a-b"]
    assert column(spark, "string", [" a \n b ", ""], collapse_ws) == ["a b", ""]
    assert column(spark, "string", ["SQL__ Injection", " a"], normalize_rule) == ["sql-injection", "-a"]
    assert column(spark, "string", ["<a href='x'>&\""], escape_html) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;"]
    assert column(spark, "double", [0.145, 0.125, 0.375, 1.0, 0.5, 1234.5], lambda c: fixed(c, 2)) == ["0.14", "0.13", "0.38", "1.00", "0.50", "1234.50"]
    assert column(spark, "double", [0.8, 1.0, 0.0625], percent) == ["80.0%", "100.0%", "6.3%"]
    assert column(spark, "double", [1.0, 0.0001, 0.25, 0.0], number_text) == ["1", "0.0001", "0.25", "0"]


def test_evidence_is_looked_for_before_contents_are_collapsed(spark):
    """The same answers as of collapsed contents, and no look at all contents for null ones of these."""
    rng = random.Random(5)
    texts = [None, "", "a \x85", "a \x85b", "a\x85", "a  b", "a b"] + ["".join(rng.choice(" \n\t\x85\xa0ab") for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    both = t.crossJoin(t.select(F.col("t").alias("e"))).select("t", "e", analysis.verify_evidence(F.col("e"), collapse_ws(F.col("t"))).alias("want"), analysis.stands_in(F.col("e"), F.col("t")).alias("got"))
    assert both.filter("want").count() > 1000 and both.filter("coalesce(want, false) <> coalesce(got, false)").collect() == []
    chunks, replies = spark.createDataFrame([], "target string, crate string, chunk_key string, content string"), spark.createDataFrame([], "target string, chunk_key string, text string, error string")
    plan = analysis.findings_from_responses(chunks, replies)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(regexp_replace(regexp_replace(content" not in plan


def test_object_in_prose(spark):
    assert column(spark, "string", ['x {"a":{}} y', "}{", "none", "{", None], object_in) == ['{"a":{}}', None, None, None, None]


@pytest.mark.parametrize("change", [{"severity": "severe"}, {"cwe": None}, {"line_start": -1}, {"line_start": 1.5}, {"line_start": True}, {"confidence": 1.5}, {"confidence": True}, {"rule_id": 5}, {"evidence": None}])
def test_one_bad_finding_voids_the_reply(change):
    with pytest.raises(Invalid):
        findings({"findings": [GOOD, GOOD | change]})


def test_lenient_where_numbers_are_whole():
    assert finding(GOOD | {"line_start": 1.0, "line_end": 1e2, "other": 1})["line_end"] == 100
    assert verdict({"verdict": "confirm", "reason": "r", "confidence": 1})["new_severity"] is None
    with pytest.raises(Invalid):
        verdict({"verdict": "downgrade", "new_severity": None, "reason": "r", "confidence": 1})


def chunks(spark, *contents):
    return spark.createDataFrame([("t", "c", f"src/{i}.rs", 1, 2, c, ["unsafe", "panic"] if i == 0 else []) for i, c in enumerate(contents)], CHUNKS)


def test_findings_need_their_evidence(spark):
    c = analysis.with_chunk_key(chunks(spark, "fn a() { let\n x }", "// context\nlet x", "other"))
    keys = {r.rel_path: r.chunk_key for r in c.collect()}
    reply = json.dumps({"findings": [GOOD, GOOD | {"evidence": "gone"}, GOOD | {"evidence": " "}]})
    kind = "target string, chunk_key string, text string, error string"
    responses = spark.createDataFrame([("t", keys["src/0.rs"], "ok: " + reply, None), ("t", keys["src/1.rs"], reply.replace("0.5", "NaN"), None), ("t", keys["src/2.rs"], reply, "timeout")], kind)
    got = analysis.findings_from_responses(c, responses).orderBy("ord").collect()
    assert [(r.ord, r.evidence, r.crate) for r in got] == [(0, "let  x", "c"), (2, " ", "c")]


def test_targets_with_the_same_file_stay_apart(spark):
    both = chunks(spark, "let x").unionByName(chunks(spark, "let x").withColumn("target", F.lit("u")))
    c = analysis.with_chunk_key(both)
    key = c.first().chunk_key
    reply = json.dumps({"findings": [GOOD]})
    responses = spark.createDataFrame([("t", key, reply, None, 1, 1), ("u", key, reply, None, 2, 2)], "target string, chunk_key string, text string, error string, input_tokens bigint, output_tokens bigint")
    found = analysis.findings_from_responses(c, responses)
    assert sorted(r.target for r in found.collect()) == ["t", "u"]
    records = analysis.chunk_records(responses, found, "h", 1)
    assert sorted((r.target, r.key, r.input_tokens) for r in records.collect()) == [("t", key, 1), ("u", key, 2)]
    cached, pending = analysis.split_cached(both, records.filter("target = 'u'"), "h")
    assert [r.target for r in pending.collect()] == ["t"]
    again = analysis.cached_findings(cached).collect()
    assert [(r.target, r.crate, r.ord, r.evidence, r.cwe, r.confidence) for r in again] == [("u", "c", 0, "let  x", None, 0.5)]


def test_requests_and_keys(spark):
    got = analysis.analysis_requests(chunks(spark, "a", "b"), "logic").orderBy("request_key").collect()
    assert got[0].user_prompt.split("\n")[:5] == ["Package c", "Source src/0.rs, from line 1 to 2", "Rules that fired: unsafe panic", "~~~", "a"]
    assert "Rules that fired: -" in got[1].user_prompt and got[0].system_prompt == analysis.SYSTEM["logic"]
    assert got[0].request_key == "c/src/0.rs:1-2#86f7e437faa5"


def test_config_hash_ignores_order_of_crates(spark):
    def h(crates, model="m"):
        cols = [F.lit(x) for x in ("/p", "prov", model, "file", "safety")]
        return spark.range(1).select(analysis.config_hash(*cols, F.lit(True), F.array(*map(F.lit, crates)))).first()[0]

    assert h(["b", "a"]) == h(["a", "b"]) != h(["a"])
    assert len(h(["a"])) == 12 and h(["a"]) != h(["a"], "n")


def test_complete_and_cache(spark):
    def client():
        def call(request):
            if "src/1.rs" in request["request_key"]:
                raise TimeoutError("slow")
            return {"text": request["user_prompt"][:8], "input_tokens": 3}

        return call

    c = chunks(spark, "a", "b")
    got = {r.request_key: r for r in analysis.complete(analysis.analysis_requests(c), client, in_flight=2, attempts=2).collect()}
    assert sorted((r.text, r.error) for r in got.values() if r.text) == [("Package ", None)]
    assert [r.error for r in got.values() if r.error] == ["TimeoutError: slow"]
    key = next(k for k, r in got.items() if r.text)
    cache = spark.createDataFrame([("t", "h", "chunk", key, "[]", None, 3, 0, 1), ("t", "other", "chunk", "x", "[]", None, 1, 1, 1), ("u", "h", "chunk", "x", "[]", None, 1, 1, 1)], CACHE)
    cached, pending = analysis.split_cached(c, cache, "h")
    assert [r.chunk_key for r in cached.collect()] == [key] and pending.count() == 1


def test_run_stats_and_progress(spark):
    rows = [("t", "analyze", False, None, 5, None), ("t", "analyze", True, None, 1, 1), ("t", "judge", False, None, None, 2), ("t", "judge", False, "x", 9, 9), ("u", "judge", False, "x", 9, 9)]
    got = {r.target: tuple(r)[1:] for r in analysis.run_stats(spark.createDataFrame(rows, "target string, step string, cached boolean, error string, input_tokens bigint, output_tokens bigint")).collect()}
    assert got == {"t": (6, 3, 2, 1, 1, 0), "u": (0, 0, 0, 0, 0, 0)}
    keys = spark.createDataFrame([("t", str(i)) for i in range(3)], "target string, chunk_key string")
    assert tuple(analysis.progress(keys, keys.limit(2)).first()) == ("t", 2, 3, 66)


def found(spark, rows):
    return spark.createDataFrame([("t", c, "r", s, None, f, a, a, "", "e", "", conf, i) for i, (c, s, f, a, conf) in enumerate(rows)], FINDINGS)


def test_decisions(spark):
    v = "struct<verdict:string,new_severity:string,reason:string,confidence:double>"
    values = [("reject", None, "why", 1.0), ("downgrade", "low", "why", 1.0), ("downgrade", "critical", "why", 1.0), ("downgrade", None, "why", 1.0), ("confirm", "low", "why", 1.0), None]
    got = column(spark, v, values, lambda c: judge.decide(F.lit("critical"), c)["kind"])
    assert got == ["drop", "downgrade", "keep", "keep", "keep", "keep"]
    f = found(spark, [("c", "critical", "a", 1, 0.5), ("c", "critical", "b", 1, 0.5), ("c", "high", "c", 1, 0.5), ("c", "critical", "d", 1, 0.5)])
    keys = {r.file: r.finding_key for r in judge.with_finding_key(f).collect()}
    decisions = spark.createDataFrame([("t", keys["a"], "drop", None), ("t", keys["b"], "downgrade", "low"), ("t", keys["c"], "drop", None)], "target string, finding_key string, kind string, new_severity string")
    assert sorted((r.file, r.severity) for r in judge.apply_decisions(f, decisions).collect()) == [("b", "low"), ("c", "high"), ("d", "critical")]


def test_judge_requests(spark):
    f = found(spark, [("c", "critical", "src/0.rs", 1, 1.0), ("c", "critical", "nowhere", 1, 0.5), ("c", "low", "src/0.rs", 1, 0.5), ("c", "critical", "src/1.rs", 1, 0.5)])
    files = spark.createDataFrame([("t", "c", "src/0.rs", "whole"), ("t", "c", "src/1.rs", "")], FILES)
    got = judge.judge_requests(f, files, chunks(spark, "a", "b")).collect()
    assert len(got) == 1 and "\nwhole\n" in got[0].user_prompt and "sure to 1)" in got[0].user_prompt
    assert judge.judge_requests(f, files, chunks(spark, "a"), enabled=False).count() == 0


def test_cached_decisions(spark):
    f = found(spark, [("c", "critical", "a", 1, 0.5), ("c", "critical", "gone", 1, 0.5), ("c", "high", "b", 1, 0.5)])
    keys = {r.file: r.finding_key for r in judge.with_finding_key(f).collect()}
    cache = spark.createDataFrame([("t", "h", "judge", keys["gone"], None, ("drop", None, "r"), 4, 5, 1), ("u", "h", "judge", keys["a"], None, ("drop", None, "r"), 4, 5, 1), ("t", "h", "judge", keys["b"], None, ("drop", None, "r"), 4, 5, 1)], CACHE)
    known = judge.cached_decisions(f, cache, "h")
    assert [(r.finding_key, r.kind, r.input_tokens) for r in known.collect()] == [(keys["gone"], "drop", 4)]
    files = spark.createDataFrame([("t", "c", "a", "whole"), ("t", "c", "gone", "x")], FILES)
    assert [r.request_key for r in judge.judge_requests(f, files, files, decided=known).collect()] == [keys["a"]]
    replies = spark.createDataFrame([("t", keys["a"], '{"verdict":"reject","reason":"r","confidence":1}', None, 1, None), ("t", "k", "no json", None, 2, 2), ("t", "l", None, "timeout", None, None)], "target string, request_key string, text string, error string, input_tokens bigint, output_tokens bigint")
    made = judge.decisions_from(replies)
    assert sorted((r.finding_key, r.kind, r.output_tokens) for r in made.collect()) == sorted([(keys["a"], "drop", 0), ("k", "keep", 2)])
    assert {(r.type, r.decision.kind) for r in judge.judge_records(made, "h", 1).collect()} == {("judge", "drop"), ("judge", "keep")}


def test_order(spark):
    f = found(spark, [(None, "low", "a", 1, 0.9), ("c", "critical", "b", 2, 0.5), ("c", "critical", "b", 1, 0.5), ("d", "critical", "a", 9, 0.9), ("c", "info", "a", 1, 1.0), ("c", "critical", "b", 1, 0.5)])
    assert [r.ord for r in ordering.sort_findings(f).collect()] == [3, 2, 5, 1, 0, 4]
    assert sorted(r.ord for r in ordering.top_findings(f, 2).collect()) == [2, 3]
    groups = {(r.crate, r.ord): (r.group_place, r.crate_place, r.crate_findings) for r in ordering.findings_by_crate(f).collect()}
    assert groups["d", 3] == (1, 1, 1) and groups["c", 2] == (2, 1, 4) and groups["(unknown crate)", 0] == (3, 1, 1)
    assert {(r.target, r.crate): r.findings for r in ordering.crate_totals(f).collect()}[None, None] == 6
    assert ordering.sort_findings(f.limit(0)).count() == 0


def test_what_variant_cannot_tell(spark):
    """Why replies are validated by a helper: Spark's JSON parser takes text behind the object, and refuses names that
    stand twice, of which the last counts here. All else that the helper tells apart it tells apart as well."""
    from codesieve.functions.replies import object_in, parse_verdict

    base = '{"verdict":"reject","reason":"r","confidence":%s}'
    cases = [base % "1", base % "1.0", base % "1e0", base % '"1"', base % "true", base % "null", base % "NaN", base % "01", base % "1,", base % "1" + " }", base % '1,"confidence":1']
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, text string")
    kind = F.expr("schema_of_variant(try_variant_get(try_parse_json(text), '$.confidence', 'variant'))")
    by_variant = {r.k for r in rows.select("k", kind.alias("kind")).collect() if r.kind and r.kind.split("(")[0] in ("BIGINT", "DECIMAL", "DOUBLE")}
    strict = {r.k for r in rows.select("k", parse_verdict(object_in(F.col("text")))["verdict"].alias("v")).collect() if r.v}
    assert strict == {0, 1, 2, 10} and by_variant == {0, 1, 2, 9}
