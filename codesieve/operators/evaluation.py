"""Findings against labelled truth: interval matching, recall, precision, misses, matrices, gates and stability.

Shapes: findings (target, ord, rule_id, severity, file, line_start, line_end, ...), entries (target, ord, id, file,
line_start, line_end, category, severity, must_detect, aliases), targets (target, line_slack, severity_order).
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_rule, percent
from ..schemas import SEVERITIES
from ..sources.tables import Tables
from .ordering import PAGE, beside, paged, placed


def validate_ground_truth(targets: DataFrame, entries: DataFrame, strict: bool = False) -> DataFrame:
    """(target, id, problem) for whatever is wrong; strict raises on the first ones."""
    known = F.array(*(F.lit(s) for s in SEVERITIES))

    def empty(c: str) -> Column:
        return F.coalesce(F.col(c) == "", F.lit(True))

    def below(c: str, least: int) -> Column:
        return F.coalesce(F.col(c) < least, F.lit(True))

    def problems(*checks: tuple[Column, str]) -> Column:
        return F.explode(F.filter(F.array(*(F.when(c, F.lit(p)) for c, p in checks)), lambda p: p.isNotNull())).alias("problem")

    of_entries = entries.select("target", "id", problems(
        (empty("id"), "id is empty"), (empty("file"), "file is empty"), (empty("category"), "category is empty"), (below("line_start", 1), "line_start is not positive"), (below("line_end", 1), "line_end is not positive"),
        (F.col("line_end") < F.col("line_start"), "line_end is before line_start"), (~F.coalesce(F.array_contains(known, F.col("severity")), F.lit(False)), "unknown severity"), (F.col("must_detect").isNull(), "must_detect is missing"),
    ))
    order = F.col("severity_order")
    of_targets = targets.select("target", F.lit(None).cast("string").alias("id"), problems(
        (empty("target"), "target is empty"), (below("line_slack", 0), "line_slack is negative"), (F.coalesce(F.size(order) != 5, F.lit(True)), "severity_order has not five entries"),
        (F.coalesce(F.size(F.array_except(order, known)) > 0, F.lit(True)), "unknown severity in severity_order"),
    ))
    repeated = entries.groupBy("target", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("target", "id", F.lit("id is not unique").alias("problem"))
    found = of_entries.unionByName(of_targets).unionByName(repeated)
    if strict and (some := found.limit(20).collect()):
        raise ValueError("invalid ground truth: " + "; ".join(f"{r['target']}/{r['id']}: {r['problem']}" for r in some))
    return found


#: Entries of one file and rule that a row holds; of larger groups, entries and findings meet in bins of lines.
LARGE = 100
#: The same where only the best entry is asked for: of larger groups, the nearest midpoints are found without a look at each entry.
FEW = 16
#: A bin of level k has BASE**k lines. An interval's own level is the least whose bins are as long as it is, so it lies in two of them at most.
BASE, LEVELS = 8, 10
GROUP = ["target", "file", "name"]
#: Midpoints, doubled, that one task looks through for the nearest.
CELL = 1 << 16


def named_entries(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, file, name, entry): each entry under its category and every alias."""
    return entries.join(targets.select("target", "line_slack"), "target").select(
        "target", "file", F.explode(F.array_distinct(F.transform(F.array_append(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), F.col("category")), normalize_rule))).alias("name"),
        F.struct("id", F.col("ord").alias("entry_ord"), "must_detect", F.col("severity").alias("expected_severity"), "line_start", "line_end", "line_slack").alias("entry"),
    )


def entry_groups(named: DataFrame, large: int) -> tuple[DataFrame, DataFrame]:
    """(a row for each target, file and name with its entries, entries of large groups). A large group's row has none."""
    sizes = named.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    sized = named.join(sizes, GROUP)
    few = sized.filter(F.col("n") <= large).groupBy(*GROUP).agg(F.collect_list("entry").alias("near"))
    return few, sized.filter(F.col("n") > large).drop("n")


def overlaps(start: Column, end: Column, entry: Column) -> Column:
    return (end >= entry["line_start"] - entry["line_slack"]) & (start <= entry["line_end"] + entry["line_slack"])


def distance(start: Column, end: Column, entry: Column) -> Column:
    """Of the midpoints."""
    return F.abs((entry["line_start"] + entry["line_end"]) / 2 - (start + end) / 2)


def level(low: Column, high: Column) -> Column:
    length = high.cast("bigint") - low + 1
    return reduce(add, ((length > BASE**k).cast("int") for k in range(LEVELS)))


def meetings(places: DataFrame, named: DataFrame) -> DataFrame:
    """(target, file, name, line_start, line_end, entry): places and entries of their group whose lines overlap.

    A pair meets once, at the coarser of both levels: a place goes to its own level, where entries of its level and
    below come, and to the coarser levels that its group's entries have. Of the two bins that both may share, the
    higher of their first ones counts. So work follows from what overlaps, not from the sizes of both sides."""
    low, high = F.col("entry.line_start") - F.col("entry.line_slack"), F.col("entry.line_end") + F.col("entry.line_slack")
    left = places.withColumn("l", level(F.col("line_start"), F.col("line_end")))
    right = named.withColumns({"low": low, "high": high}).withColumn("k", level(F.col("low"), F.col("high")))
    of_places, of_entries = left.groupBy(*GROUP).agg(F.collect_set("l").alias("ls")), right.groupBy(*GROUP).agg(F.collect_set("k").alias("ks"))

    def bins(start: str, end: str) -> Column:
        width = F.pow(F.lit(float(BASE)), F.col("step.m"))
        return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))

    def step(m: Column, own: bool) -> Column:
        return F.struct(m.alias("m"), F.lit(own).alias("of_place"))

    to_left = F.concat(F.array(step(F.col("l"), True)), F.transform(F.filter("ks", lambda m: m > F.col("l")), lambda m: step(m, False)))
    to_right = F.concat(F.array(step(F.col("k"), False)), F.transform(F.filter("ls", lambda m: m >= F.col("k")), lambda m: step(m, True)))
    a = left.join(of_entries, GROUP).withColumn("step", F.explode(to_left)).withColumn("bin", bins("line_start", "line_end")).drop("ks")
    b = right.join(of_places, GROUP).withColumn("step", F.explode(to_right)).withColumn("bin", bins("low", "high")).drop("ls")
    width = F.pow(F.lit(float(BASE)), F.col("step.m"))
    first = F.greatest(F.floor(F.col("line_start") / width), F.floor(F.col("low") / width))
    return a.join(b, [*GROUP, "step", "bin"]).filter((F.col("bin") == first) & (F.col("line_end") >= F.col("low")) & (F.col("line_start") <= F.col("high"))).select(*GROUP, "line_start", "line_end", "entry")


def nearest(places: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places with their best entry in `met__`, places that this doesn't settle), without a look at pairs.

    Lines overlap within the slack if and only if the doubled midpoints are no further apart than both lengths and twice
    the slack. So where all entries of the nearest midpoint are long enough, none is nearer and the earliest of them is the
    best. Nearest midpoints are found for each distinct midpoint of a group, in cells of CELL: by windows in a cell, with
    the last midpoint of the cells before and the first one of those behind. Runs jobs, so that places and entries are
    looked for once."""
    tables = Tables(places.sparkSession, "nearest")
    e = F.col("entry")
    reach = e["line_end"].cast("bigint") - e["line_start"] + 2 * e["line_slack"].cast("bigint")
    first = F.min(F.struct(e["entry_ord"].alias("ord"), e["id"].alias("id"), e["must_detect"].alias("must_detect"), e["expected_severity"].alias("expected_severity")))
    middle = e["line_start"].cast("bigint") + e["line_end"]
    mids = tables.save(named.groupBy(*GROUP, middle.alias("mid")).agg(F.min(reach).alias("reach"), first.alias("first")), "mids")
    at = tables.save(places.withColumn("mid", F.col("line_start").cast("bigint") + F.col("line_end")), "places")
    none = F.lit(None)
    points = at.select(*GROUP, "mid").distinct().withColumn("own", none.cast(mids.select(F.struct("mid", "reach", "first").alias("own")).schema["own"].dataType))
    both = points.unionByName(mids.select(*GROUP, "mid", F.struct("mid", "reach", "first").alias("own"))).withColumn("cell", F.floor(F.col("mid") / CELL))
    cells = both.groupBy(*GROUP, "cell").agg(F.min("own").alias("low"), F.max("own").alias("high"))

    def carried(column: str, to: Column) -> Column:
        return F.last(column, ignorenulls=True).over(Window.partitionBy(*GROUP).orderBy(to).rowsBetween(Window.unboundedPreceding, -1))

    cells = cells.select(*GROUP, "cell", carried("high", F.col("cell")).alias("below"), carried("low", F.col("cell").desc()).alias("above"))
    here = Window.partitionBy(*GROUP, "cell")
    # of rows of one midpoint the entries' comes first both ways
    entries_first = F.col("own").isNull()
    seen = both.withColumn("left", F.last("own", ignorenulls=True).over(here.orderBy("mid", entries_first).rowsBetween(Window.unboundedPreceding, 0)))
    seen = seen.withColumn("right", F.last("own", ignorenulls=True).over(here.orderBy(F.col("mid").desc(), entries_first).rowsBetween(Window.unboundedPreceding, 0)))
    found = seen.filter("own is null").join(cells, [*GROUP, "cell"]).select(*GROUP, "mid", F.coalesce("left", "below").alias("left"), F.coalesce("right", "above").alias("right"))
    rows = at.join(found, [*GROUP, "mid"])
    left, right = F.col("mid") - F.col("left.mid"), F.col("right.mid") - F.col("mid")
    far = F.least(left, right)
    sides = F.array(F.when(left == far, F.col("left")), F.when(right == far, F.col("right")))
    ties = F.filter(sides, lambda s: s.isNotNull())
    length = F.col("line_end").cast("bigint") - F.col("line_start")
    settled = F.coalesce(F.forall(ties, lambda s: far <= length + s["reach"]), F.lit(False))
    best = F.array_min(F.transform(ties, lambda s: s["first"]))
    met = F.struct((far / 2).alias("far"), *(best[c].alias(c) for c in ("ord", "id", "must_detect", "expected_severity")))
    rows = tables.save(rows.select(*GROUP, "line_start", "line_end", settled.alias("settled"), met.alias("met__")), "rows")
    return rows.filter("settled").drop("settled"), rows.filter("not settled").select(*GROUP, "line_start", "line_end")


def places_of(findings: DataFrame, crowded: DataFrame) -> DataFrame:
    """Where the findings of large groups lie, each place once."""
    own = findings.select("target", "file", normalize_rule(F.col("rule_id")).alias("name"), "line_start", "line_end")
    return own.join(crowded.select(*GROUP).distinct(), GROUP, "left_semi").distinct()


def match_candidates(findings: DataFrame, entries: DataFrame, targets: DataFrame, large: int = LARGE) -> DataFrame:
    """Pairs of a finding and an entry of its file and rule whose lines overlap within the slack.

    An equi-join on target, file and name comes first, so that only one file's entries meet a finding; entries of a
    group that has more than `large` meet its findings in bins of lines."""
    few, crowded = entry_groups(named_entries(entries, targets), large)
    own = findings.withColumn("name", normalize_rule(F.col("rule_id")))
    start, end = F.col("line_start"), F.col("line_end")
    near = own.join(few, GROUP).withColumn("entry", F.explode(F.filter("near", lambda e: overlaps(start, end, e))))
    place = [*GROUP, "line_start", "line_end"]
    met = own.join(meetings(places_of(findings, crowded), crowded), place)
    return near.select(*findings.columns, "entry").unionByName(met.select(*findings.columns, "entry"))


def repeated_ids(findings: DataFrame) -> DataFrame:
    """(target, id, n) of findings that share one: finding_id where there is one, else ord."""
    own = F.col("finding_id" if "finding_id" in findings.columns else "ord").cast("string")
    return findings.groupBy("target", own.alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def match_findings(findings: DataFrame, entries: DataFrame, targets: DataFrame, large: int = FEW, strict: bool = False) -> DataFrame:
    """One row per finding: findings' columns, matched_id, match_kind (must, bonus, none), expected_severity.

    Of several candidates the one with the nearest midpoint counts, on ties the earliest entry. What a finding matches
    follows from its target, file, rule and lines alone, so a finding is matched where it stands: no id takes part, and
    findings with equal ones don't mix. strict raises on such all the same."""
    if strict and (some := repeated_ids(findings).limit(20).collect()):
        raise ValueError("findings share an id: " + ", ".join(f"{r['target']}/{r['id']}" for r in some))
    few, crowded = entry_groups(named_entries(entries, targets), large)
    start, end = F.col("line_start"), F.col("line_end")

    def rank(e: Column) -> Column:
        return F.struct(distance(start, end, e).alias("far"), e["entry_ord"].alias("ord"), e["id"].alias("id"), e["must_detect"].alias("must_detect"), e["expected_severity"].alias("expected_severity"))

    own = findings.withColumn("name__", normalize_rule(F.col("rule_id")))
    few = few.select(F.col("target").alias("t__"), F.col("file").alias("f__"), F.col("name").alias("n__"), "near")
    # of entries on equal lines only the earliest can be the best
    apart = crowded.groupBy(*GROUP, "entry.line_start", "entry.line_end").agg(F.min_by("entry", F.struct("entry.entry_ord", "entry.id")).alias("entry")).select(*GROUP, "entry")
    apart = Tables(findings.sparkSession, "apart").save(apart, "entries")
    met, open_ = nearest(places_of(findings, apart), apart)
    met = met.unionByName(meetings(open_, apart).groupBy(*GROUP, "line_start", "line_end").agg(F.min(rank(F.col("entry"))).alias("met__")))
    met = met.select(*(F.col(c).alias(f"m_{c}") for c in (*GROUP, "line_start", "line_end")), "met__")
    here = (F.col("target") == F.col("t__")) & (F.col("file") == F.col("f__")) & (F.col("name__") == F.col("n__"))
    there = (F.col("target") == F.col("m_target")) & (F.col("file") == F.col("m_file")) & (F.col("name__") == F.col("m_name")) & (start == F.col("m_line_start")) & (end == F.col("m_line_end"))
    near = F.array_min(F.transform(F.filter("near", lambda e: overlaps(start, end, e)), rank))
    best = F.coalesce(near, F.col("met__"))
    rows = own.join(few, here, "left").join(met, there, "left").withColumn("best__", best)
    kind = F.when(F.col("best__").isNull(), "none").when(F.col("best__.must_detect"), "must").otherwise("bonus")
    return rows.select(*(findings[c] for c in findings.columns), F.col("best__.id").alias("matched_id"), kind.alias("match_kind"), F.col("best__.expected_severity").alias("expected_severity"))


def entry_hits(matches: DataFrame, entries: DataFrame) -> DataFrame:
    """entries with `hit`."""
    hit = matches.filter("matched_id is not null").select("target", F.col("matched_id").alias("id"), F.lit(True).alias("hit")).distinct()
    return entries.join(hit, ["target", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def rates(counts: DataFrame) -> DataFrame:
    """counts with recall and precision; nothing to find, or nothing reported, is 1."""
    recall = F.when(F.col("must_total") == 0, 1.0).otherwise(F.col("must_hit") / F.col("must_total"))
    precision = F.when(F.col("reported_total") == 0, 1.0).otherwise(F.col("true_positives") / F.col("reported_total"))
    return counts.withColumn("recall", recall).withColumn("precision", precision)


def evaluate(matches: DataFrame, entries: DataFrame, targets: DataFrame, pooled: bool = False) -> DataFrame:
    """One row per target, and with pooled one of all with a null target: counts, recall and precision."""
    hits = entry_hits(matches, entries)
    of_entries = hits.groupBy("target").agg(*(F.count_if(c).alias(n) for n, c in (("must_total", F.col("must_detect")), ("must_hit", F.col("must_detect") & F.col("hit")), ("bonus_total", ~F.col("must_detect")), ("bonus_hit", ~F.col("must_detect") & F.col("hit")))))
    of_findings = matches.groupBy("target").agg(F.count(F.lit(1)).alias("reported_total"), F.count_if(F.col("matched_id").isNotNull()).alias("true_positives"), F.count_if(F.col("matched_id").isNull()).alias("false_positives"))
    counts = targets.select("target").distinct().join(of_entries, "target", "left").join(of_findings, "target", "left").na.fill(0)
    if pooled:
        counts = counts.rollup("target").agg(*(F.sum(c).alias(c) for c in counts.columns[1:]))
    return rates(counts)


def missed_entries(matches: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that had to be found and weren't; `ord` is the order of the truth."""
    hit = matches.filter("matched_id is not null").select("target", F.col("matched_id").alias("id"))
    return entries.filter("must_detect").join(hit, ["target", "id"], "left_anti")


def false_positives(matches: DataFrame) -> DataFrame:
    return matches.filter("matched_id is null")


def severity_matrix(matches: DataFrame, targets: DataFrame) -> DataFrame:
    """Dense: target, row, column, expected, reported, findings. Of a severity listed twice the last place counts."""
    last = F.col("severity_order")
    placed = targets.select("target", F.posexplode("severity_order").alias("row", "expected"), last.alias("o"))
    cells = placed.select("target", "row", "expected", F.posexplode("o").alias("column", "reported"))
    at = targets.select("target", F.posexplode("severity_order").alias("place", "severity")).groupBy("target", "severity").agg(F.max("place").alias("place"))
    counts = matches.filter("expected_severity is not null").groupBy("target", "expected_severity", "severity").agg(F.count(F.lit(1)).alias("findings"))
    located = counts.join(at.select("target", F.col("severity").alias("expected_severity"), F.col("place").alias("row")), ["target", "expected_severity"]).join(at.select("target", "severity", F.col("place").alias("column")), ["target", "severity"]).select("target", "row", "column", "findings")
    return cells.join(located, ["target", "row", "column"], "left").select("target", "row", "column", "expected", "reported", F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"))


def severity_matrix_wide(matrix: DataFrame, order: list[str] = SEVERITIES) -> DataFrame:
    """A row for each expected severity, a column for each reported one."""
    return matrix.groupBy("target", "row", "expected").pivot("reported", order).agg(F.sum("findings")).na.fill(0)


def gate(summary: DataFrame, min_recall: float | None = None, min_precision: float | None = None) -> DataFrame:
    """target, failures, passed. Thresholds that aren't set can't fail."""
    checks = [F.when(F.col(n) < least, F.concat(F.lit(f"{n} "), percent(F.col(n)), F.lit(" < min "), percent(F.lit(least)))) for n, least in (("recall", min_recall), ("precision", min_precision)) if least is not None]
    failures = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.expr("cast(array() as array<string>)")
    return summary.select("target", failures.alias("failures")).withColumn("passed", F.size("failures") == 0)


def eval_report(summary: DataFrame, matches: DataFrame, entries: DataFrame, targets: DataFrame, size: int = PAGE) -> DataFrame:
    """(target, page, report): the summary with missed entries, false positives and the matrix as JSON texts, page by
    page: each has up to `size` missed entries and `size` false positives, and none is left out."""
    entry, finding = ["id", "file", "line_start", "line_end", "category", "severity"], ["file", "line_start", "line_end", "rule_id", "severity", "summary"]
    missed = paged(missed_entries(matches, entries), ["ord", *entry], F.struct(*entry), "missed", size)
    wrong = paged(false_positives(matches), ["ord", *finding], F.struct(*finding), "wrong", size)
    rows = severity_matrix(matches, targets).groupBy("target", "row").agg(F.array_sort(F.collect_list(F.struct("column", "findings"))).alias("r")).groupBy("target").agg(F.array_sort(F.collect_list(F.struct("row", F.col("r.findings").alias("cells")))).alias("m")).select("target", F.col("m.cells").alias("matrix"))
    both = missed.join(wrong, ["target", "page"], "full")
    pages = both.groupBy("target").agg(F.max("page").alias("pages"))
    own = Tables(matches.sparkSession, "reported").save(summary.join(pages, "target", "left").join(rows, "target", "left"), "own")
    none = own.filter("pages is null").withColumns({"page": F.lit(1), "pages": F.lit(1)})
    all_ = beside(both, own.filter("pages is not null")).unionByName(none, allowMissingColumns=True)

    def listed(name: str, like: DataFrame) -> Column:
        return F.coalesce(name, F.expr(f"cast(array() as {like.schema[name].dataType.simpleString()})"))

    report = F.struct(
        "target", "page", "pages", "recall", "precision", F.struct(F.col("must_total").alias("total"), F.col("must_hit").alias("hit"), listed("missed", missed).alias("missed")).alias("must"), F.struct(F.col("bonus_total").alias("total"), F.col("bonus_hit").alias("hit")).alias("bonus"),
        F.struct(F.col("reported_total").alias("total"), "true_positives", listed("wrong", wrong).alias("false_positives")).alias("reported"), F.col("matrix").alias("severity_confusion"),
    )
    return all_.select("target", "page", F.to_json(report).alias("report"))


def eval_text(summary: DataFrame, matches: DataFrame, entries: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, section, place, line): a report to read, a row for each line, so that no target is gathered. Sections:
    0 figures, 1 missed entries, 2 false positives, 3 the matrix if anything matched; sorted, a target's rows are its text."""

    def of(name: str, a: str, b: str, share: Column | None = None) -> Column:
        return F.concat(F.lit(name), F.col(a).cast("string"), F.lit(" of "), F.col(b).cast("string"), *([F.lit(", "), percent(share)] if share is not None else []))

    def headed(rows: DataFrame, section: int, title: str, order: list[str], line: Column) -> DataFrame:
        heads = rows.groupBy("target").agg(F.count(F.lit(1)).alias("n")).select("target", F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("place"), F.concat(F.lit(title), F.col("n").cast("string")).alias("line"))
        body = placed(rows, ["target"], order).select("target", F.lit(section).alias("section"), F.col("place").cast("bigint").alias("place"), line.alias("line"))
        return heads.unionByName(body)

    figures = [
        F.concat(F.lit("Results for "), "target"), of("recall: ", "must_hit", "must_total", F.col("recall")), of("precision: ", "true_positives", "reported_total", F.col("precision")),
        F.when(F.col("bonus_total") > 0, of("extra entries found: ", "bonus_hit", "bonus_total")),
    ]
    top = summary.select("target", F.lit(0).alias("section"), F.posexplode(F.array_compact(F.array(*figures))).alias("place", "line")).withColumn("place", F.col("place").cast("bigint"))
    lines = F.concat("file", F.lit(" "), F.col("line_start").cast("string"), F.lit(" to "), F.col("line_end").cast("string"))
    missed = headed(missed_entries(matches, entries), 1, "not found: ", ["ord", "id"], F.concat_ws(" | ", "id", lines, "category", "severity"))
    wrong = headed(false_positives(matches), 2, "reported without cause: ", ["ord", "file", "line_start", "line_end", "rule_id", "severity"], F.concat_ws(" | ", lines, "rule_id", "severity"))
    matrix = severity_matrix(matches, targets)
    some = matrix.groupBy("target").agg(F.max("findings").alias("most")).filter("most > 0").select("target")
    rows = matrix.join(some, "target").groupBy("target", "row", "expected").agg(F.array_sort(F.collect_list(F.struct("column", "reported", "findings"))).alias("cells"))
    cells = F.array_join(F.transform("cells", lambda c: F.concat(c["reported"], F.lit(" "), c["findings"].cast("string"))), ", ")
    body = rows.select("target", F.lit(3).alias("section"), (F.col("row") + 1).cast("bigint").alias("place"), F.concat("expected", F.lit(" reported as: "), cells).alias("line"))
    return top.unionByName(missed).unionByName(wrong).unionByName(body)


def stability(runs: DataFrame) -> DataFrame:
    """target, pairs, jaccard: mean similarity of the finding sets of repeated runs.

    runs: target, run and the findings' columns; a run without findings has a row with a null file. Each member of the
    sets is looked at once, with the set of runs that have it; equal sets of runs are counted, and only these make
    pairs. Sets without any finding are alike."""
    members = runs.filter("file is not null").groupBy("target", "file", normalize_rule(F.col("rule_id")).alias("name"), "line_start", "line_end").agg(F.array_sort(F.collect_set("run")).alias("seen"))
    patterns = members.groupBy("target", "seen").agg(F.count(F.lit(1)).alias("n"))
    single = patterns.select("target", F.explode("seen").alias("run"), "n").groupBy("target", "run").agg(F.sum("n").alias("n"))
    sizes = runs.select("target", "run").distinct().join(single, ["target", "run"], "left").na.fill(0, ["n"])
    ahead = patterns.select("target", "n", "seen", F.posexplode("seen").alias("i", "a"))
    common = ahead.select("target", "n", "a", F.explode(F.slice("seen", F.col("i") + 2, F.size("seen"))).alias("b")).groupBy("target", "a", "b").agg(F.sum("n").alias("both"))
    pairs = sizes.select("target", F.col("run").alias("a"), F.col("n").alias("na")).join(sizes.select("target", F.col("run").alias("b"), F.col("n").alias("nb")), "target").filter("a < b").join(common, ["target", "a", "b"], "left").na.fill(0, ["both"])
    union = F.col("na") + F.col("nb") - F.col("both")
    return pairs.groupBy("target").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.when(union == 0, 1.0).otherwise(F.col("both") / union)).alias("jaccard"))


def patched_control(vulnerable: DataFrame, patched: DataFrame, entries: DataFrame) -> DataFrame:
    """entries with found_before, found_after and fixed: a bug should be found in the vulnerable release and be gone
    from the patched one. Both sides are matches against the same entries."""
    before = entry_hits(vulnerable, entries).withColumnRenamed("hit", "found_before")
    after = entry_hits(patched, entries).select("target", "id", F.col("hit").alias("found_after"))
    return before.join(after, ["target", "id"]).withColumn("fixed", F.col("found_before") & ~F.col("found_after"))
