"""The canonical order of findings, groups by crate, and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SEVERITIES
from ..sources.tables import Tables

UNKNOWN = "(unknown crate)"
#: What tells findings apart, and what order() looks at.
IDENT, ORDERED = ["target", "ord"], ["severity", "confidence", "file", "line_start", "ord"]
#: Rows of one report page.
PAGE = 500
#: First places of keys in ranges, of a few numbers each, that every task may hold; beyond that rows are shuffled to them.
FIRSTS = 200_000
#: Rows of targets, with their names and titles, that every task may hold.
TARGETS = 20_000


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity).cast("int") - 1


def order() -> list[Column]:
    """Worst first, surer first, then file and line; ties keep the order of input."""
    return [severity_rank(F.col("severity")), F.desc("confidence"), F.col("file"), F.col("line_start"), F.col("ord")]


def placed(rows: DataFrame, keys: list[str], by: list, name: str = "place", ident: list[str] | None = None, uses: list[str] | None = None) -> DataFrame:
    """rows with their place (bigint, from 1) among those of equal keys. Rows are sorted by ranges of keys and order, so a
    key that has most rows fills no task, and written with their number in the whole; a place is that number less the
    first one of its key, which is known from a row for each key and range. These rows are written and counted, so that
    Spark needn't guess their size from that of all rows, and shuffle those once more.

    With `ident`, columns that tell rows apart, only these, the keys and the columns that `by` uses are sorted and
    written, and rows get their place by a join: texts aren't sorted. Runs a job, as both looks at a range have to find
    the same."""
    slim = rows.select(*dict.fromkeys([*keys, *(uses or []), *ident])) if ident else rows
    cut = slim.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by).withColumn("at__", F.monotonically_increasing_id())
    tables = Tables(rows.sparkSession, "placed")
    cut = tables.save(cut, "ranges").withColumn("range__", F.shiftright("at__", 33))
    own = [F.col(k).alias(f"{k}__") for k in keys]
    sizes = cut.groupBy(*own, F.col("range__").alias("part__")).agg(F.min("at__").alias("first__"), F.count(F.lit(1)).alias("n__"))
    before = sizes.withColumn("before__", F.sum("n__").over(Window.partitionBy(*(f"{k}__" for k in keys)).orderBy("part__")) - F.col("n__")).drop("n__")
    before = tables.save(before, "firsts")
    before = before.hint("broadcast" if before.count() <= FIRSTS else "merge")
    same = F.col("range__") == F.col("part__")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    numbered = cut.join(before, same).withColumn(name, F.col("before__") + F.col("at__") - F.col("first__") + 1)
    if not ident:
        return numbered.select(*rows.columns, name)
    return rows.join(numbered.select(*ident, name), ident) if set(rows.columns) - set(slim.columns) else numbered.select(*rows.columns, name)


def sort_findings(findings: DataFrame) -> DataFrame:
    """All findings in order: a range sort, for output."""
    return findings.orderBy("target", *order())


def ranked_findings(findings: DataFrame) -> DataFrame:
    """findings with `place` from 1 within their target. (target, ord) tells findings apart."""
    return placed(findings, ["target"], order(), ident=IDENT, uses=ORDERED)


def top_findings(findings: DataFrame, n: int) -> DataFrame:
    """The first n of each target. Spark limits each task's rows before the shuffle."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(*order()))).filter(F.col("place") <= n)


def paged(rows: DataFrame, by: list, item: Column, name: str, size: int = PAGE) -> DataFrame:
    """(target, page, <name>): all rows, `size` items at a time in the order given; pages count from 1."""
    return in_pages(placed(rows, ["target"], by), item, name, size)


def in_pages(rows: DataFrame, item: Column, name: str, size: int) -> DataFrame:
    """The same of rows that have their place."""
    pages = rows.select("target", "place", item.alias("item")).groupBy("target", F.ceil(F.col("place") / size).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("all"))
    return pages.select("target", "page", F.col("all.item").alias(name))


def beside(pages: DataFrame, own: DataFrame) -> DataFrame:
    """pages with the columns of own, a row for each target. Pages are large and a target may have most of them, so rows
    of targets go to them: broadcast as far as every task may hold them, else held one target's at a time. Never are a
    target's pages held. own is written and counted for that."""
    own = Tables(pages.sparkSession, "beside").save(own, "own")
    return pages.join(own.hint("broadcast" if own.count() <= TARGETS else "merge"), "target")


def findings_by_crate(findings: DataFrame) -> DataFrame:
    """findings with crate_place (severity, then confidence) and group_place (crates by their first finding)."""
    named = findings.withColumn("crate", F.coalesce("crate", F.lit(UNKNOWN)))
    first = named.groupBy("target", "crate").agg(F.min(F.struct(severity_rank(F.col("severity")), -F.col("confidence"), "file", "line_start", "ord")).alias("first"), F.count(F.lit(1)).alias("crate_findings"))
    groups = first.withColumn("group_place", F.row_number().over(Window.partitionBy("target").orderBy("first", "crate"))).drop("first")
    return placed(named, ["target", "crate"], order(), "crate_place", IDENT, ORDERED).join(groups, ["target", "crate"])


def crate_totals(findings: DataFrame) -> DataFrame:
    """Counts per crate, per target (crate null) and of all (both null)."""
    return findings.select("target", F.coalesce("crate", F.lit(UNKNOWN)).alias("crate")).rollup("target", "crate").agg(F.count(F.lit(1)).alias("findings"))
