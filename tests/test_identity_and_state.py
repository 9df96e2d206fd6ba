"""Identity of findings, matching in bins, the reply log, retries, the cache's generations, snapshots and named files."""

import itertools
import json
import os
import random
import sys
import threading
import time
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from codesieve.jobs import scan as jobs
from codesieve.operators import analysis, evaluation, judge, model, ordering
from codesieve.operators.model import Asking
from codesieve.schemas import CACHE, FILES, FINDINGS
from codesieve.sources import cache as caches
from codesieve.sources import named_files, readers, snapshot, writers
from codesieve.sources.tables import Tables
from codesieve.streaming import incremental

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
SEVERITIES = ["critical", "high", "medium", "low", "info"]
ENTRY = "target string, ord int, id string, file string, line_start int, line_end int, category string, severity string, must_detect boolean, aliases array<string>"
TARGET = "target string, line_slack int, severity_order array<string>"
AT_ONCE = Asking(delay=lambda attempt: 0.0, attempts=2)


def reply(request, times=1, severity="low"):
    name = request["user_prompt"].split("\n")[1].split(",")[0].removeprefix("Source ")
    one = {"rule_id": "unsafe", "severity": severity, "file": name, "line_start": 1, "line_end": 1, "summary": "s", "evidence": "unsafe", "fix_suggestion": "f", "confidence": 0.5}
    return {"text": json.dumps({"findings": [one] * times}), "input_tokens": 1, "output_tokens": 1}


def sources(spark, **texts):
    return spark.createDataFrame([("t", "c", f"{k}.rs", v) for k, v in texts.items()], FILES)


# identity ------------------------------------------------------------------------------------------------------------

def test_a_scan_can_be_scored(spark):
    """Two files with a hit each, truth only in one; one finding is given twice."""
    files = sources(spark, a="unsafe { 1 }", b="unsafe { 2 }", z="fn f() {}")
    none = spark.createDataFrame([], CACHE)
    done = jobs.scan(files, none, "h", lambda: lambda r: reply(r, 2 if "b.rs" in r["request_key"] else 1), Tables(spark, "t"), unit="file", asking=AT_ONCE)
    found = {r.finding_id: r for r in done.findings.collect()}
    assert [k.split("#")[0] + "#" + k.split("#")[-1] for k in sorted(found)] == ["a.rs:1-1#1", "b.rs:1-1#1", "b.rs:1-1#2"]
    assert sorted(r.ord for r in found.values()) == [0, 1, 2] and sorted(r.place for r in found.values()) == [1, 2, 3]
    entries = spark.createDataFrame([("t", 0, "e", "a.rs", 1, 1, "unsafe", "low", True, [])], ENTRY)
    targets = spark.createDataFrame([("t", 5, SEVERITIES)], TARGET)
    matches = evaluation.match_findings(done.findings, entries, targets, strict=True)
    assert Counter((r.file, r.matched_id) for r in matches.collect()) == {("a.rs", "e"): 1, ("b.rs", None): 2}
    r = evaluation.evaluate(matches, entries, targets).first()
    assert (r.recall, r.precision, r.reported_total) == (1.0, 1 / 3, 3)


def test_shared_ids(spark):
    rows = [("t", None, "unsafe", "low", None, f, 1, 1, "", "", "", 0.5, 7) for f in ("a.rs", "b.rs")]
    f = spark.createDataFrame(rows, FINDINGS)
    entries = spark.createDataFrame([("t", 0, "e", "a.rs", 1, 1, "unsafe", "low", True, None)], ENTRY)
    targets = spark.createDataFrame([("t", 0, SEVERITIES)], TARGET)
    assert {r.file: r.matched_id for r in evaluation.match_findings(f, entries, targets).collect()} == {"a.rs": "e", "b.rs": None}
    with pytest.raises(ValueError, match="t/7"):
        evaluation.match_findings(f, entries, targets, strict=True)


def test_ids_hold_when_other_findings_come(spark):
    rows = [("t", "c", "r", "low", None, f, 1, 1, "", e, "", 0.5, 0) for f, e in (("b", "x"), ("b", "x"), ("c", "y"))]
    some = spark.createDataFrame(rows, FINDINGS).withColumn("where", F.col("file"))
    more = some.unionByName(spark.createDataFrame([(*rows[0][:5], "a", *rows[0][6:])], FINDINGS).withColumn("where", F.col("file")))
    first, second = ({r.finding_id: r.file for r in judge.identified(x.drop("ord"), ["where"]).collect()} for x in (some, more))
    assert len(first) == 3 and len(second) == 4 and first.items() <= second.items()


@pytest.mark.parametrize("ident", [None, ["k", "id"]])
def test_places(spark, ident):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(50), i, "text") for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, id int, other string").filter("id >= 0" if ident is None else "k is not null").repartition(4)
    got = {r.id: r.place for r in ordering.placed(df, ["k"], [F.desc("v"), F.col("id")], ident=ident, uses=["v"]).collect()}
    want = {}
    for k in ("hot", "b", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        want |= {r[2]: n + 1 for n, r in enumerate(own) if ident is None or k is not None}
    assert got == want
    assert dict(ordering.placed(df, ["k"], ["v"]).dtypes)["place"] == "bigint"


# matching ------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("large", [0, 3, 100])
def test_matching_in_bins_and_rows(spark, large):
    rng = random.Random(large)

    def span():
        a = rng.choice([1, 7, 8, 9, 63, 64, 65, 500, rng.randrange(1, 3000)])
        return a, a + rng.choice([0, 0, 1, 6, 7, 8, 63, 64, 2000])

    names = ["SQL Injection", "sql_injection", "toctou"]
    found = [("t" if rng.random() < 0.9 else "u", None, rng.choice(names), "low", None, rng.choice(["a", "a", "b"]), *span(), "", "", "", 0.5, i) for i in range(300)]
    truth = [(rng.choice(["t", "t", "u"]), i, f"e{i}", rng.choice(["a", "a", "b"]), *span(), rng.choice(["sql-injection", "toctou"]), "low", rng.random() < 0.5, rng.choice([None, [], ["TOCTOU", "toctou"]])) for i in range(80)]
    slack = {"t": 5, "u": 0}
    pairs = set()
    for f, e in itertools.product(found, truth):
        mine = {x.lower().replace("_", "-").replace(" ", "-") for x in [e[6], *(e[9] or [])]}
        if f[0] == e[0] and f[5] == e[3] and f[2].lower().replace("_", "-").replace(" ", "-") in mine and f[7] >= e[4] - slack[f[0]] and f[6] <= e[5] + slack[f[0]]:
            pairs.add((f[12], e[2], abs((e[4] + e[5]) / 2 - (f[6] + f[7]) / 2), e[1]))
    frames = spark.createDataFrame(found, FINDINGS), spark.createDataFrame(truth, ENTRY), spark.createDataFrame([(t, s, SEVERITIES) for t, s in slack.items()], TARGET)
    got = [(r.ord, r.entry.id) for r in evaluation.match_candidates(*frames, large=large).collect()]
    assert len(got) == len(set(got)) and set(got) == {p[:2] for p in pairs}
    best = {}
    for o, i, far, n in pairs:
        best[o] = min(best.get(o, (far, n, i)), (far, n, i))
    rows = evaluation.match_findings(*frames, large=large).collect()
    assert len(rows) == len(found) and {r.ord: r.matched_id for r in rows} == {f[12]: best[f[12]][2] if f[12] in best else None for f in found}


def test_work_of_a_crowded_file_follows_its_matches(spark):
    """20,000 places and 2,000 entries of one file: 40 million pairs, of which few overlap, meet in few."""
    places = spark.range(20_000).select(F.lit("t").alias("target"), F.lit("f").alias("file"), F.lit("n").alias("name"), (F.col("id") * 10 + 1).cast("int").alias("line_start"), (F.col("id") * 10 + 3).cast("int").alias("line_end"))
    entry = F.struct(F.col("id"), (F.col("id") * 100 + 1).cast("int").alias("line_start"), (F.col("id") * 100 + 2).cast("int").alias("line_end"), F.lit(0).alias("line_slack"))
    named = spark.range(2000).select(F.lit("t").alias("target"), F.lit("f").alias("file"), F.lit("n").alias("name"), entry.alias("entry"))
    assert evaluation.meetings(places, named).count() == 2000


def test_stability_of_many_runs(spark):
    rng = random.Random(4)
    sets = {run: {f"f{k}" for k in range(30) if rng.random() < 0.6} for run in range(12)} | {12: set(), 13: set()}
    rows = [("t", run, f, "R u", 1, 2) for run, s in sets.items() for f in (s or [None]) for _ in range(2)]
    got = evaluation.stability(spark.createDataFrame(rows, "target string, run int, file string, rule_id string, line_start int, line_end int")).first()
    shares = [1.0 if not a | b else len(a & b) / len(a | b) for a, b in itertools.combinations(sets.values(), 2)]
    assert got.pairs == 91 and abs(got.jaccard - sum(shares) / 91) < 1e-9


# the model call ------------------------------------------------------------------------------------------------------

def requests(spark, n):
    return spark.range(n).select(F.lit("t").alias("target"), F.concat(F.lit("k"), "id").alias("request_key"), F.lit("s").alias("system_prompt"), F.lit("u").alias("user_prompt"), F.lit(0.1).alias("temperature"), F.lit(9).alias("max_tokens"))


def counting(folder, dies=None, fails=()):
    """A client that notes each call as a file; at the dies-th call of a process the task dies."""
    def client():
        def call(request):
            key = request["request_key"]
            if key in fails:
                raise TimeoutError("no answer")
            if dies is not None and len(os.listdir(folder)) >= dies and not os.path.exists(f"{folder}-died"):
                open(f"{folder}-died", "w").close()
                raise SystemExit("the worker is gone")
            open(f"{folder}/{key}-{time.time_ns()}-{threading.get_ident()}", "w").close()
            return {"text": key, "input_tokens": 1, "output_tokens": 2}

        return call

    return client


def paid(folder):
    return Counter(x.split("-")[0] for x in os.listdir(folder))


def test_a_dying_task_pays_once(spark, tmp_path):
    calls = str(tmp_path / "calls")
    os.mkdir(calls)
    asking = Asking(8, 4, delay=lambda a: 0.0, group=4, log=str(tmp_path / "log"))
    got = model.complete(requests(spark, 60).unionByName(requests(spark, 5)), counting(calls, dies=25), asking)
    with pytest.raises(Exception, match="gone|SystemExit|Python worker"):
        got.collect()
    assert os.path.exists(f"{calls}-died") and paid(calls)
    rows = got.select("*").collect()  # the same job once more
    assert Counter(r.request_key for r in rows) == {f"k{i}": 1 for i in range(60)} and {r.text for r in rows} == {f"k{i}" for i in range(60)}
    assert got.select("text").count() == 60  # a second look
    again = model.complete(requests(spark, 70), counting(calls), asking)  # another job
    assert again.count() == 70
    assert paid(calls) == {f"k{i}": 1 for i in range(70)}


def test_a_log_has_few_files(spark, tmp_path):
    """However many groups there were; and replies that stand twice, as a stopped merge leaves them, count once."""
    calls, log = str(tmp_path / "calls"), tmp_path / "log"
    os.mkdir(calls)
    asking = Asking(8, 4, delay=lambda a: 0.0, group=2, log=str(log))
    got = model.complete(requests(spark, 500), counting(calls), asking)
    assert got.count() == 500
    folders = Counter(os.path.dirname(f) for f in log.rglob("*.parquet"))
    assert len(folders) == model.SHARDS and set(folders.values()) == {1}
    assert model.read_replies(spark, str(log)).count() == 500
    for f in list(log.rglob("replies-*.parquet")):
        f.with_name("replies-again.parquet").write_bytes(f.read_bytes())
    assert Counter(r.request_key for r in got.select("*").collect()) == {f"k{i}": 1 for i in range(500)}
    assert model.complete(requests(spark, 500), counting(calls), asking).count() == 500
    assert paid(calls) == {f"k{i}": 1 for i in range(500)}


def test_errors_are_asked_again(spark, tmp_path):
    calls = str(tmp_path / "calls")
    os.mkdir(calls)
    asking = Asking(4, 2, attempts=2, delay=lambda a: 0.0, log=str(tmp_path / "log"))
    got = {r.request_key: r for r in model.complete(requests(spark, 9), counting(calls, fails={"k3", "k4"}), asking).collect()}
    assert {k for k, r in got.items() if r.error} == {"k3", "k4"} and got["k3"].error == "TimeoutError: no answer"
    got = {r.request_key: r for r in model.complete(requests(spark, 9), counting(calls), asking).collect()}
    assert all(r.error is None and (r.text, r.output_tokens) == (k, 2) for k, r in got.items()) and paid(calls) == {f"k{i}": 1 for i in range(9)}


def test_calls_in_flight(spark, tmp_path):
    """No more than in_flight calls run at once, and more than one in a task."""
    def client():
        def call(request):
            began = time.time()
            time.sleep(0.05)
            with open(f"{tmp_path}/{request['request_key']}", "w") as f:
                f.write(f"{began} {time.time()} {os.getpid()}")
            return {"text": "x"}

        return call

    model.complete(requests(spark, 40), client, Asking(6, 3)).collect()
    spans = [tuple(map(float, (tmp_path / x).read_text().split())) for x in os.listdir(tmp_path)]
    at_once = [sum(a <= s[0] < b for a, b, _ in spans) for s in spans]
    assert len(spans) == 40 and 1 < max(at_once) <= 6


def test_waits_between_attempts(spark, tmp_path):
    def client():
        def call(request):
            with open(f"{tmp_path}/calls", "a") as f:
                f.write(f"{time.time()}\n")
            raise ConnectionError

        return call

    assert model.complete(requests(spark, 1), client, Asking(attempts=3, delay=lambda a: 0.2 * a)).first().error.startswith("ConnectionError")
    at = [float(x) for x in (tmp_path / "calls").read_text().split()]
    assert len(at) == 3 and at[1] - at[0] >= 0.2 and at[2] - at[1] >= 0.4
    assert [model.backoff(k) for k in (1, 2, 3, 20)] == [0.5, 1.0, 2.0, 30.0]


# streams -------------------------------------------------------------------------------------------------------------

def noting(folder, fails=(), dies=None, severity="critical"):
    def client():
        def call(request):
            key = request["request_key"].split("/")[-1].split(":")[0] + ("-judge" if request["max_tokens"] == 1024 else "")
            if key in fails:
                raise TimeoutError("no answer")
            if key == dies and not os.path.exists(f"{folder}-died"):
                open(f"{folder}-died", "w").close()
                raise SystemExit("gone")
            open(f"{folder}/{key}~{time.time_ns()}", "w").close()
            if request["max_tokens"] == 1024:
                return {"text": '{"verdict":"reject","reason":"r","confidence":1}', "input_tokens": 1, "output_tokens": 1}
            return reply(request, severity=severity)

        return call

    return client


def test_failed_files_are_tried_again(spark, tmp_path):
    calls, source, cache = (str(tmp_path / x) for x in ("calls", "source", "cache"))
    os.mkdir(calls)
    sources(spark, a="unsafe { 1 }", b="unsafe { 2 }", c="unsafe { 3 }", d="fn f() {}").write.parquet(source)

    def run(start, name, client, *first):
        start(spark, *first, cache, str(tmp_path / name), "h", client, unit="file", asking=AT_ONCE).awaitTermination()
        return {(r.type, r.key.split("/")[-1].split(":")[0]) for r in caches.read_cache(spark, cache).collect()}

    assert run(incremental.incremental_scan, "one", noting(calls, fails={"b.rs", "c.rs-judge"}), source) == {("chunk", "a.rs"), ("chunk", "c.rs"), ("judge", "a.rs")}
    assert run(incremental.incremental_scan, "one", noting(calls), source) == {("chunk", "a.rs"), ("chunk", "c.rs"), ("judge", "a.rs")}  # behind the checkpoint
    assert run(incremental.retry_failed, "two", noting(calls, fails={"b.rs-judge"})) == {("chunk", "a.rs"), ("chunk", "b.rs"), ("chunk", "c.rs"), ("judge", "a.rs"), ("judge", "c.rs")}
    whole = {(k, f"{f}.rs") for k in ("chunk", "judge") for f in "abc"}
    assert run(incremental.retry_failed, "two", noting(calls)) == whole
    assert run(incremental.retry_failed, "two", noting(calls)) == whole
    assert Counter(x.split("~")[0] for x in os.listdir(calls)) == {f"{f}.rs{j}": 1 for f in "abc" for j in ("", "-judge")}


def test_a_stopped_batch_pays_once(spark, tmp_path):
    calls, source, cache = (str(tmp_path / x) for x in ("calls", "source", "cache"))
    os.mkdir(calls)
    sources(spark, **{f"f{i}": f"unsafe {{ {i} }}" for i in range(12)}).write.parquet(source)
    asking = Asking(4, 4, attempts=1, group=2)
    with pytest.raises(Exception, match=r"(?s).*"):
        incremental.incremental_scan(spark, source, cache, str(tmp_path / "point"), "h", noting(calls, dies="f7.rs"), unit="file", asking=asking).awaitTermination()
    assert os.path.exists(f"{calls}-died") and os.listdir(calls)
    incremental.incremental_scan(spark, source, cache, str(tmp_path / "point"), "h", noting(calls), unit="file", asking=asking).awaitTermination()
    assert Counter(x.split("~")[0] for x in os.listdir(calls)) == {f"f{i}.rs{j}": 1 for i in range(12) for j in ("", "-judge")}
    assert caches.read_cache(spark, cache).count() == 24


# cache ---------------------------------------------------------------------------------------------------------------

def records(spark, *rows):
    return spark.createDataFrame([("t", "h", "chunk", k, "[]", None, n, 0, n) for k, n in rows], CACHE)


def state(spark, path):
    return {r.key: r.input_tokens for r in caches.read_cache(spark, path).collect()}


def test_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    assert state(spark, path) == {}
    writers.append_cache(records(spark, ("a", 1), ("b", 2)), path)
    writers.append_cache(records(spark, ("a", 3)), path)
    want = {"a": 3, "b": 2}
    assert state(spark, path) == want
    assert caches.compact_cache(spark, path, buckets=2) == 1 and state(spark, path) == want
    writers.append_cache(records(spark, ("b", 4), ("c", 5), ("a", 2)), path)
    want = {"a": 3, "b": 4, "c": 5}
    assert state(spark, path) == want

    class Stopped(Exception):
        pass

    def stopped(self, name):
        raise Stopped

    with monkeypatch.context() as m:
        m.setattr(caches.Folder, "rename", stopped)
        with pytest.raises(Stopped):
            caches.compact_cache(spark, path)
    assert caches.generation(spark, path) == 1 and state(spark, path) == want  # half of it is there, and isn't read
    writers.append_cache(records(spark, ("d", 6)), path)
    want["d"] = 6
    assert state(spark, path) == want
    assert caches.compact_cache(spark, path) == 2 and state(spark, path) == want
    caches.forget_merged(spark, path)
    assert state(spark, path) == want and not [f for _, _, fs in os.walk(path + "/config_hash=h") for f in fs if f.endswith(".parquet")]
    writers.append_cache(records(spark, ("d", 7)), path)
    assert state(spark, path) == want | {"d": 7} and readers.read_cache(spark, path).count() == 4
    assert caches.compact_cache(spark, path) == 3 and state(spark, path) == want | {"d": 7}


# sources and files ---------------------------------------------------------------------------------------------------

def test_a_broken_truth_file_among_good_ones(spark, tmp_path):
    good = "target: {}\nmatch_policy: {{line_slack: 5, severity_order: [critical, high, medium, low, info]}}\nfindings:\n  - {{id: a, file: f, line_start: 1, line_end: 2, category: c, severity: low, must_detect: true, aliases: [1, x]}}\n  - 7\n"
    for name, text in {"a": good.format("ta"), "b": good.format("tb"), "bad": "a: [b\n: :", "list": "- 1\n", "odd": "target: to\nmatch_policy: 3\nfindings: no\n", "none": "# nothing\n"}.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    targets, entries, problems = readers.read_truth_files(spark, str(tmp_path))
    assert sorted(r.target for r in targets.collect()) == ["ta", "tb", "to"]
    assert sorted((r.target, r.ord, r.id, tuple(r.aliases)) for r in entries.collect()) == [("ta", 0, "a", ("1", "x")), ("tb", 0, "a", ("1", "x"))]
    assert {r.file.split("/")[-1]: r.problem.split(":")[0] for r in problems.collect()} == {"bad.yaml": "not YAML", "list.yaml": "no mapping", "none.yaml": "no mapping"}
    assert readers.read_ground_truth(spark, str(tmp_path))[0].count() == 3
    with pytest.raises(ValueError, match="bad.yaml"):
        readers.read_ground_truth(spark, str(tmp_path), strict=True)


def test_a_text_is_no_array_of_findings(spark):
    texts = spark.createDataFrame([("s", '{"findings": "[{}]"}'), ("n", '{"findings": null}'), ("a", '{"findings": [{"rule_id": "r"}]}'), ("b", ' [{"rule_id": "r"}]'), ("x", "no json")], "report string, text string")
    found, errors = readers.reports_from(texts)
    assert sorted(r.report for r in found.collect()) == ["a", "b"] and sorted(r.report for r in errors.collect()) == ["n", "s", "x"]


def test_named_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"d/{i}.html", f"é{i}") for i in range(20)] + [("empty", None)], "name string, content string").repartition(4)
    named_files.write_named(rows, folder)
    named_files.write_named(rows, folder)  # once more is the same
    got = {os.path.relpath(os.path.join(at, f), folder): open(os.path.join(at, f), encoding="utf-8").read() for at, _, fs in os.walk(folder) for f in fs}
    assert got == {f"d/{i}.html": f"é{i}" for i in range(20)} | {"empty": "", named_files.DONE: "21"}
    with pytest.raises(ValueError, match="stand twice"):
        named_files.write_named(rows.unionByName(rows), folder)
    with pytest.raises(Exception, match="no file can be named"):
        named_files.write_named(spark.createDataFrame([("../x", "")], "name string, content string"), folder)
    assert not os.path.exists(tmp_path / "x")


def test_snapshots_feed_the_stream(spark, tmp_path):
    root, folder, cache = tmp_path / "tree", str(tmp_path / "snapshots"), str(tmp_path / "cache")

    def put(name, text):
        (root / "t/src").mkdir(parents=True, exist_ok=True)
        (root / "t/src" / name).write_text(text)

    def client():
        return reply

    def go():
        n = snapshot.take_snapshot(spark, str(root), folder)
        snapshot.packed_files(spark, folder, n).withColumn("crate", F.lit("c")).select("target", "crate", "rel_path", "content").write.mode("append").parquet(str(tmp_path / "packed"))
        incremental.incremental_scan(spark, str(tmp_path / "packed"), cache, str(tmp_path / "point"), "h", client, unit="file", asking=AT_ONCE).awaitTermination()
        return {(r.rel_path, r.kind) for r in snapshot.changes(spark, folder, n).collect()}, spark.read.parquet(cache).count()

    for name in "abc":
        put(f"{name}.rs", f"unsafe {{ {name} }}")
    put("x.txt", "no source")
    assert go() == ({(f"src/{n}.rs", "added") for n in "abc"}, 3)
    os.remove(root / "t/src/a.rs")
    put("b.rs", "unsafe { other }")
    put("d.rs", "unsafe { d }")
    os.utime(root / "t/src/c.rs", (1, 1))  # read again, but says the same
    assert go() == ({("src/a.rs", "gone"), ("src/b.rs", "changed"), ("src/d.rs", "added")}, 5)
    assert go() == (set(), 5) and snapshot.number(spark, folder) == 3
    assert sorted(r.rel_path for r in snapshot.listing(spark, folder, 3).collect()) == ["src/b.rs", "src/c.rs", "src/d.rs"]


def test_tables_of_a_run_can_go(spark):
    mark = len(Tables.standing)
    tables = Tables(spark, "t")
    kept = tables.save(spark.range(3), "x")
    ordering.placed(kept, [], ["id"]).count()
    folders = [t.folder for t in Tables.standing[mark:]]
    assert len(folders) == 2 and all(map(os.path.exists, folders))
    Tables.close_since(mark)
    assert len(Tables.standing) == mark and not any(map(os.path.exists, folders))


def test_report_pages_have_names(spark):
    rows = spark.createDataFrame([("a-b-m.html", 1), ("a-b-m.html", 12), ("none", 2)], "name string, page int")
    assert [r[0] for r in rows.select(writers.page_name(F.col("name"), F.col("page"))).collect()] == ["a-b-m.html", "a-b-m.12.html", "none.2"]


def test_calls_by_keyword(spark):
    assert analysis.complete(requests(spark, 2), lambda: lambda r: {"text": "x"}, in_flight=1, attempts=1).count() == 2


def test_a_tree_is_scanned_from_its_root(spark, tmp_path):
    for name, text in {
        "p/Cargo.toml": '[package]\nname = "root"\n[workspace]\nmembers = ["x"]\n', "p/x/Cargo.toml": '[package]\nname = "inner"\n', "p/src/a.rs": "fn a() { unsafe {} }\n", "p/x/src/b.rs": "fn b() { unsafe {} }\n", "p/x/src/c.rs": "fn c() {}\n",
        "q/src/lone.rs": "fn l() { unsafe {} }\n", "bad/Cargo.toml": "[[[", "bad/d.rs": "fn d() { unsafe {} }\n",
    }.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    root, tables = str(tmp_path / "tree"), Tables(spark, "t")
    listed = jobs.listing_root(spark, root, tables)
    assert sorted((r.target, r.crate, r.rel_path, r.start_line, r.hints) for r in listed.collect()) == [("p", "inner", "x/src/b.rs", 1, "unsafe"), ("p", "root", "src/a.rs", 1, "unsafe")]
    assert [r.rel_path for r in jobs.listing_root(spark, root, Tables(spark, "t"), crates=["inner"]).collect()] == ["x/src/b.rs"]
    assert [r.rel_path for r in jobs.listing_root(spark, root, Tables(spark, "t"), limit=1).collect()] == ["x/src/b.rs"]
    assert [(r.target, r.problem) for r in jobs.projects(spark, root, Tables(spark, "t")).problems.collect()] == [("bad", "no readable root manifest")]
    cache, reports = str(tmp_path / "cache"), str(tmp_path / "reports")

    def client():
        return lambda r: reply(r)

    done = jobs.scan_root(spark, root, "h", client, tables, cache, reports, model="m 1", asking=AT_ONCE)
    assert sorted((r.crate, r.file) for r in done.findings.collect()) == [("inner", "x/src/b.rs"), ("root", "src/a.rs")]
    assert sorted(x for x in os.listdir(reports) if not x.startswith((".", "_"))) == ["p-provider-m-1.html"]
    page = (tmp_path / "reports/p-provider-m-1.html").read_text()
    assert "Scan of root" in page and "2 finding(s)" in page and "x/src/b.rs:1" in page
    again = jobs.scan_root(spark, root, "h", client, Tables(spark, "t"), cache, reports, asking=AT_ONCE)
    assert analysis.run_stats(again.calls).first().analyze_cache_hits == 2
