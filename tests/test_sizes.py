"""What has to hold at sizes that tests don't have: plans without broadcasts of what grows, bounded steps, and ties."""

from pyspark.sql import functions as F

from codesieve.functions.text import percent
from codesieve.operators import analysis


def test_replies_are_not_broadcast(spark):
    chunks = spark.createDataFrame([("t", "c", "k", "text")], "target string, crate string, chunk_key string, content string")
    replies = spark.createDataFrame([("t", "k", "{}", None)], "target string, chunk_key string, text string, error string")
    plan = analysis.findings_from_responses(chunks, replies)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_shares_round_as_sql_does(spark):
    """100 * 0.0185 and 100 * 0.0045 lie below the tie as doubles, 1000 * them don't."""
    rows = spark.createDataFrame([(37, 2000), (9, 2000), (3, 2000), (1, 3), (0, 1), (1, 1), (1, 2000)], "a int, b int")
    assert [r[0] for r in rows.select(percent(F.col("a") / F.col("b"))).collect()] == ["1.9%", "0.5%", "0.2%", "33.3%", "0.0%", "100.0%", "0.1%"]


def test_nearest_entries_settle_places_without_pairs(spark):
    """Of a group with many entries, places meet their nearest midpoints; only those that these don't reach go on."""
    import random

    from codesieve.operators import evaluation as ev
    from codesieve.schemas import ENTRIES, FINDINGS, SEVERITIES, TRUTH

    rng = random.Random(5)
    lines = [(a, a + rng.choice([0, 0, 1, 2, 3, 40, 3000, 90_000])) for a in (rng.choice([rng.randrange(1, 400), rng.randrange(30_000, 200_000)]) for _ in range(300))]
    entries = [("t", i, f"e{i}", "f", a, b, "r", None, "low", i % 3 > 0, [], None) for i, (a, b) in enumerate(lines)]
    places = [(a, a + rng.choice([0, 1, 5, 700, 40_000])) for a in (rng.choice([rng.randrange(1, 500), rng.randrange(1, 200_000)]) for _ in range(400))]
    findings = [("t", "c", "R", "high", None, "f", a, b, "s", "e", "x", 0.5, i) for i, (a, b) in enumerate(places)]
    e, t, f = spark.createDataFrame(entries, ENTRIES), spark.createDataFrame([("t", 5, SEVERITIES, 1)], TRUTH), spark.createDataFrame(findings, FINDINGS)
    got = {r.ord: r.matched_id for r in ev.match_findings(f, e, t, large=10).collect()}
    for i, (a, b) in enumerate(places):
        near = [(abs(x + y - a - b), k) for k, (x, y) in enumerate(lines) if b >= x - 5 and a <= y + 5]
        assert got[i] == (f"e{min(near)[1]}" if near else None)
    _, crowded = ev.entry_groups(ev.named_entries(e, t), 10)
    met, left = ev.nearest(ev.places_of(f, crowded), crowded)
    assert met.count() > 100 and met.count() + left.count() == len(set(places))


def test_truth_is_read_in_parts(spark, monkeypatch):
    """Entries come in parts, numbered through; a file that breaks at its end gives none; what PyYAML gives is given."""
    import yaml

    from codesieve.functions import truth_yaml
    from codesieve.sources import readers

    text = "findings:\n" + "\n".join(f"- {{id: p{i}}}" for i in range(2500)) + "\ntarget: %s\nmatch_policy: {line_slack: 5}\n"
    rows = spark.createDataFrame([("a", text % "t"), ("b", text % "u" + "x: ["), ("c", "target: v\n")], "file string, text string")
    targets, entries, problems = readers.truth_from(rows)
    assert sorted((r.target, r.line_slack) for r in targets.collect()) == [("t", 5), ("v", None)]
    assert [(r.target, r.ord, r.id) for r in entries.orderBy("ord").collect()] == [("t", i, f"p{i}") for i in range(2500)]
    assert [r.file for r in problems.collect()] == ["b"]
    held: list = []
    monkeypatch.setattr(truth_yaml.Reader, "items", lambda self, f=truth_yaml.Reader.items: (held.append(1), f(self))[1])
    for case in ("findings: [1]\nfindings: [2, 3]", "x: &a {id: 1}\nfindings: [*a, {<<: *a}]", "<<: {findings: [7]}", "findings: [&q {a: 1}, *q]\nz: *q", "- findings"):
        out: list = []
        got = truth_yaml.load(case, out.clear, out.append)
        want = yaml.safe_load(case)
        assert (got | {"findings": out} if isinstance(got, dict) else got) == want
    assert len(held) == 3


def test_places_shuffle_rows_once(spark):
    """However large Spark takes the rows for, first places go to them and not the rows to their first places."""
    from codesieve.operators import ordering

    rows = spark.range(200).selectExpr("concat('t', id % 3) as target", "id")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ordering.placed(rows, ["target"], ["id"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert [r.place for r in got.filter("target = 't1'").orderBy("id").collect()] == list(range(1, 68))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_workers_get_small_batches(spark):
    from codesieve.operators import chunking, model
    from codesieve.schemas import FILES
    from codesieve.sources.tables import ARROW

    files = spark.createDataFrame([("t", "c", "a.rs", "unsafe {}")], FILES)
    asked = spark.createDataFrame([], model.REQUEST)
    for step in (lambda: chunking.file_chunks(files), lambda: chunking.chunk(files, "ast-function"), lambda: model.complete(asked, lambda: None)):
        for k in ARROW:
            spark.conf.unset(k)
        step()
        assert {k: spark.conf.get(k).rstrip("b") for k in ARROW} == ARROW


def test_small_files_share_tasks(spark, tmp_path):
    from codesieve.sources import readers, snapshot
    from codesieve.sources.tables import SMALL_FILES

    (tmp_path / "t/src").mkdir(parents=True)
    for i in range(300):
        (tmp_path / f"t/src/f{i}.rs").write_text(f"fn f{i}() {{}}")
    for look in (readers.read_sources, snapshot.listed):
        for k in SMALL_FILES:
            spark.conf.unset(k)
        rows = look(spark, str(tmp_path))
        assert rows.count() == 300 and rows.rdd.getNumPartitions() <= 5  # 10 when each file counts for 4 MB more


def test_named_files_are_written_by_many_tasks(spark, tmp_path):
    from codesieve.sources import named_files

    rows = spark.range(0, 200, 1, 1).selectExpr("concat('d/', id) AS name", "concat('x', id) AS content")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup("named")
    spark.sparkContext.setJobGroup("named", "named files")
    try:
        named_files.write_named(rows, str(tmp_path / "out"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = set(tracker.getJobIdsForGroup("named")) - set(before)
    stages = [tracker.getStageInfo(s) for j in jobs for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) == 4 * spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "out/d").iterdir())) == 200


def test_reports_are_parsed_once(spark):
    from codesieve.sources import readers

    texts = spark.createDataFrame([("a", '{"findings":[{"rule_id":"x"},null]}'), ("b", "[]"), ("c", "{}"), ("d", '{"findings":{}}')], "report string, text string")
    found, errors = readers.reports_from(texts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "from_json" in line]
    assert sorted((r.report, r.ord, r.rule_id) for r in found.collect()) == [("a", 0, "x"), ("a", 1, None)]
    assert sorted(r.report for r in errors.collect()) == ["c", "d"]


def test_scans_make_their_files_once(spark, monkeypatch):
    from codesieve.jobs import inputs, queries

    made, files = [], inputs.files
    monkeypatch.setattr(inputs, "files", lambda *a: made.append(a) or files(*a))
    queries.scan_resumed(spark, "/root/testdata/sf0.001")
    assert len(made) == 1  # once for each scan and the cache before


def test_findings_are_not_held_against_each_entry_of_a_larger_group(spark, monkeypatch):
    """Of a group of 40 entries a finding's nearest is found without a look at all of them."""
    from codesieve.operators import evaluation as ev
    from codesieve.schemas import ENTRIES, FINDINGS, SEVERITIES, TRUTH

    lines = [(i * 7 % 90 + 1, i * 7 % 90 + 1 + i % 4) for i in range(40)]
    places = [(a, a + a % 6) for a in range(1, 120)]
    e = spark.createDataFrame([("t", i, f"e{i}", "f", a, b, "r", None, "low", True, [], None) for i, (a, b) in enumerate(lines)], ENTRIES)
    f = spark.createDataFrame([("t", "c", "R", "high", None, "f", a, b, "s", "e", "x", 0.5, i) for i, (a, b) in enumerate(places)], FINDINGS)
    seen: list = []
    monkeypatch.setattr(ev, "nearest", lambda p, n, g=ev.nearest: (seen.append(n.count()), g(p, n))[1])
    got = {r.ord: r.matched_id for r in ev.match_findings(f, e, spark.createDataFrame([("t", 5, SEVERITIES, 1)], TRUTH)).collect()}
    for i, (a, b) in enumerate(places):
        near = [(abs(x + y - a - b), k) for k, (x, y) in enumerate(lines) if b >= x - 5 and a <= y + 5]
        assert got[i] == (f"e{min(near)[1]}" if near else None)
    assert seen == [len(set(lines))]


def test_a_target_of_many_pages_is_held_by_no_task(spark):
    """Rows of targets go to pages: these are never the buffered side of a join, nor dealt out by their target."""
    from codesieve.sources import writers

    rows = spark.range(2300).selectExpr("if(id < 2250, 'a', 'b') AS target", "id AS ord", "'R' AS rule_id", "'low' AS severity", "cast(null AS string) AS cwe", "'c' AS crate", "concat('f', id) AS file", "1 AS line_start", "2 AS line_end", "'s' AS summary", "'e' AS evidence", "'x' AS fix_suggestion", "0.5D AS confidence")
    runs = spark.createDataFrame([("a", "A", []), ("b", "B", []), ("none", "N", [])], "target string, title string, info array<struct<name: string, value: string>>")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = writers.html_report(runs, rows)
        plan = got._jdf.queryExecution().executedPlan().toString()
        pages = sorted((r.target, r.page, r.html.count("<tr><td"), r.html.count("finding(s)")) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert pages == [*(("a", k, 500 if k < 5 else 250, 1) for k in range(1, 6)), ("b", 1, 50, 1), ("none", 1, 0, 1)]
    assert "SortMergeJoin" not in plan


def test_trees_are_listed_by_tasks(spark, tmp_path):
    """No reader of a tree has Spark's driver list it; what is found is what Spark's reader finds, and files of no bytes."""
    from codesieve.sources import readers, snapshot, trees

    root = tmp_path / "root"
    for name in ("t/src/a.rs", "t/b.rs", "t/src/deep/er/c.rs", "t/_left/d.rs", "t/.git/e.rs", "t/src/_f.rs", "t/src/g.txt", "u/Cargo.toml", "u/x y/h+%20é.rs", "top.rs"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"fn {name}")
    (root / "t/none.rs").write_text("")
    (root / "linked").symlink_to(root / "u", target_is_directory=True)
    rows = readers.read_sources(spark, str(root))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan
    own, other = trees.Tree(spark, str(root), "*.rs"), trees.Tree(spark, str(root)[:-1] + "[t]", "*.rs")
    assert own.own and not other.own
    found = [{(readers_path(r.path), r.size, r.time, bytes(r.content)) for r in t.contents(t.names).collect()} for t in (own, other)]
    assert {x for x in found[0] if x[1]} == found[1] and len(found[1]) == 6
    assert {(r.target, r.rel_path, r.content) for r in rows.collect()} == {(p.split("/")[0], p.split("/", 1)[1], c.decode()) for p, _, _, c in ((x[0].removeprefix(str(root) + "/"), *x[1:]) for x in found[0]) if "/" in p}
    assert snapshot.take_snapshot(spark, str(root), str(tmp_path / "s")) == 1 and snapshot.listing(spark, str(tmp_path / "s"), 1).count() == 6


def readers_path(path):
    return path.removeprefix("file:")


def test_names_of_written_files_stay_with_tasks(tmp_path):
    """What a task tells the driver doesn't grow with its files; a failed write still takes them away."""
    import pickle

    from codesieve.sources import named_files

    def written(k, n):
        return writer.write(iter([{"name": f"d{k}/f{i}\n", "content": "x"} for i in range(n)]))

    writer = named_files.Writer(str(tmp_path / "out"), False)
    messages = [written(0, 2), written(1, 2000)]
    assert abs(len(pickle.dumps(messages[0])) - len(pickle.dumps(messages[1]))) < 10
    writer.commit(messages)
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["_written", "d0", "d1"] and (tmp_path / "out/_written").read_text() == "2002"
    writer = named_files.Writer(str(tmp_path / "broken"), False)
    writer.abort([written(0, 2), None, written(1, 20)])
    assert not [x for x in (tmp_path / "broken").rglob("*") if x.is_file()]
