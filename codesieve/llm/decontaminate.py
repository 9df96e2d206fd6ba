"""Benchmark decontamination through a positional inverted index of training tokens.

1. One pass over all texts stores the index: a posting (term, rid, position) for every word that the benchmark has, and
   a row for each document row. `rid` numbers rows of the index, so rows that share a doc_id, or have none, stay apart.
2. Terms get their frequencies from the index. Each window of an item (`window` consecutive words; a shorter item is one
   window) is anchored at its rarest terms; windows of an item that share anchors are asked for once.
3. The anchors' lists, the rarest, are shifted by the terms' offsets in the item and intersected: what is left are
   (row, item, alignment) seeds.
4. The lists of all other terms of the item are intersected with the seeds, in the index and for their rows alone. Runs
   of `window` item words or more that stand at one alignment are the exact phrase matches.
`near_matches` asks the same index for words of an item that stand close together in any order: the anchors of a window
within `reach` words of the first of them, and `least` different words of the windows with these anchors.

Defined cases: a null text has no words; items without words never match; items with equal texts all count; repeated
item rows count once for each distinct item_id; each document row has a result of its own, also rows that repeat a
doc_id and rows without one; empty tables give no rows (documents) or no hits (benchmark); words that several windows
cover count once; other columns of the input are ignored, and kept by decontaminate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_UPPER, Workspace

#: What stands between words: runs of ASCII characters other than digits and letters. Words are lower-cased afterwards.
SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
ANCHORS = 2
#: A near match: words to either side of the first anchor, and different words that have to stand there.
REACH, LEAST = 15, 8
#: Characters of term tables up to which they are broadcast; beyond that they are joined by shuffle.
BROADCAST_CHARS = 8_000_000
#: The term id of the row that stands for a document.
DOCUMENT = -1


def pieces(text: Column) -> Column:
    """Words as they are written, with an empty piece at an end where the text begins or ends with a gap."""
    return F.split(F.coalesce(text, F.lit("")), SPLIT)


def lowered(term: Column) -> Column:
    """A-Z in lower case and nothing else: lower() would change other letters, so it serves pure ASCII alone."""
    return F.when(F.octet_length(term) == F.char_length(term), F.lower(term)).otherwise(F.translate(term, ASCII_UPPER, ASCII_UPPER.lower()))


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("text"), t).alias("k2")]


def small(df: DataFrame, column: str) -> DataFrame:
    """df with a broadcast hint if its rows are few enough; the size is counted, not guessed."""
    chars = df.agg(F.sum(F.length(F.col(column).cast("string")) + 40)).first()[0] or 0
    return F.broadcast(df) if chars <= BROADCAST_CHARS else df


@dataclass
class Index:
    """items: item, item_id, words. places: item, offset, term_id, asked (words of a window). postings: rid, term_id,
    position. frequency: term_id, n. rows: rid, doc_id, k1, k2, n_words. anchors: term_id, set, item, offset, rank,
    n_anchors, whole."""

    items: DataFrame
    places: DataFrame
    postings: DataFrame
    frequency: DataFrame
    rows: DataFrame
    anchors: DataFrame


def store_items(benchmark: DataFrame, ws: Workspace, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, vocabulary, places), all saved."""
    words = F.transform(F.filter(pieces(F.col("text")), lambda x: x != ""), lowered)
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words")).filter("size(words) > 0").distinct()
    items = ws.save(own.withColumn("item", F.monotonically_increasing_id()), "items")
    terms = items.select(F.explode("words").alias("term")).distinct()
    vocabulary = ws.save(terms.withColumn("term_id", F.monotonically_increasing_id()), "vocabulary")
    each = items.select("item", F.least(F.size("words"), F.lit(window)).alias("asked"), F.posexplode("words").alias("offset", "term"))
    return items, vocabulary, ws.save(each.join(vocabulary, "term").select("item", "offset", "term_id", "asked"), "places")


def store_postings(docs: DataFrame, vocabulary: DataFrame, ws: Workspace) -> DataFrame:
    """The index: rid, term_id, position; where term_id is DOCUMENT also doc_id, k1, k2, n_words."""
    split = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), *text_key(F.col("text")), pieces(F.col("text")).alias("w"))
    lead = (F.element_at("w", 1) == "").cast("int")
    tail = ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    # a first empty piece stands for the document; it joins the empty term, which has the id DOCUMENT
    each = split.select("rid", "doc_id", "k1", "k2", (F.size("w") - lead - tail).alias("n_words"), lead.alias("lead"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("at", "piece"))
    known = small(vocabulary.unionByName(vocabulary.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(DOCUMENT).cast("bigint").alias("term_id"))), "term")
    found = each.withColumn("term", lowered(F.col("piece"))).join(known, "term").filter(f"term_id <> {DOCUMENT} or at = 0")
    of_row = [F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("doc_id", "k1", "k2", "n_words")]
    return ws.save(found.select("rid", "term_id", (F.col("at") - 1 - F.col("lead")).alias("position"), *of_row), "index")


def choose_anchors(places: DataFrame, frequency: DataFrame, ws: Workspace, window: int, anchors: int) -> DataFrame:
    """The rarest terms that training has of each window, once for all windows of an item that share them; `whole` if
    training has all terms of one of these windows, as else none of them can occur."""
    last = F.max("offset").over(Window.partitionBy("item"))
    known = places.join(frequency, "term_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("last", last)
    starts = F.sequence(F.greatest(F.col("offset") - window + 1, F.lit(0)), F.least(F.col("offset"), F.greatest(F.col("last") - window + 1, F.lit(0))))
    each = known.select("item", "offset", "term_id", "n", F.explode(starts).alias("start"))
    by_window = Window.partitionBy("item", "start")
    ranked = each.withColumn("least", F.min("n").over(by_window)).filter("n > 0").withColumn("place", F.row_number().over(by_window.orderBy("n", "offset"))).filter(F.col("place") <= anchors)
    sets = ranked.groupBy("item", "start").agg(F.array_sort(F.collect_list("offset")).alias("offsets"), F.min("least").alias("least")).groupBy("item", "offsets").agg((F.max("least") > 0).alias("whole"))
    sets = ws.save(sets.withColumn("set", F.monotonically_increasing_id()), "anchor-sets")
    each = sets.select("set", "item", "whole", F.size("offsets").alias("n_anchors"), F.posexplode("offsets").alias("rank", "offset"))
    return ws.save(each.join(places, ["item", "offset"]).select("term_id", "set", "item", "offset", "rank", "n_anchors", "whole"), "anchors")


def build_index(docs: DataFrame, benchmark: DataFrame, ws: Workspace, window: int = WINDOW, anchors: int = ANCHORS) -> Index:
    if anchors > 63:
        raise ValueError("a window has 63 anchors at most")
    items, vocabulary, places = store_items(benchmark, ws, window)
    index = store_postings(docs, vocabulary, ws)
    postings = index.filter(f"term_id <> {DOCUMENT}").select("rid", "term_id", "position")
    frequency = ws.save(postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("n")), "frequency")
    return Index(items, places, postings, frequency, index.filter(f"term_id = {DOCUMENT}").select("rid", "doc_id", "k1", "k2", "n_words"), choose_anchors(places, frequency, ws, window, anchors))


def alignments(index: Index) -> DataFrame:
    """(rid, set, item, at): where all anchors of a window have the right distance; word 0 of the item would stand at `at`."""
    shifted = index.postings.join(small(index.anchors.filter("whole"), "term_id"), "term_id").select("rid", "set", "item", (F.col("position") - F.col("offset")).alias("at"), "rank", "n_anchors")
    met = shifted.groupBy("rid", "set", "item", "at").agg(F.bit_or(F.expr("shiftleft(1L, rank)")).alias("ranks"), F.max("n_anchors").alias("n_anchors"))
    return met.filter("bit_count(ranks) = n_anchors").select("rid", "set", "item", "at")


def reaches(index: Index, window: int) -> DataFrame:
    """(set, low, high): the offsets of the windows that have a set of anchors."""
    return index.anchors.groupBy("set").agg((F.max("offset") - window + 1).alias("low"), (F.min("offset") + window - 1).alias("high"))


def of_rows(index: Index, rids: DataFrame) -> DataFrame:
    """Postings of some rows. How many those are grows with the corpus, so Spark chooses the join by their stored size."""
    return index.postings.join(rids, "rid", "left_semi")


def phrase_matches(index: Index, ws: Workspace, window: int = WINDOW) -> DataFrame:
    """(rid, item, start, length): longest runs of item words, of a window at least, from word `start` of the row. Around
    each seed only the words of windows that have its anchors are looked for, so a long item asks for few."""
    seeds = ws.save(alignments(index), "seeds")
    rids = ws.save(seeds.select("rid").distinct(), "seed-rows")
    spans = index.anchors.select("set", "item").distinct().join(reaches(index, window), "set").join(index.places, "item").filter("offset between low and high").select("set", "offset", "term_id", "asked")
    asked = seeds.join(small(ws.save(spans, "spans"), "term_id"), "set").select("rid", "item", "at", "offset", "term_id", "asked").distinct().withColumn("position", F.col("at") + F.col("offset"))
    there = asked.join(of_rows(index, rids), ["rid", "position", "term_id"])
    run = F.col("offset") - F.row_number().over(Window.partitionBy("rid", "item", "at").orderBy("offset"))
    runs = there.withColumn("run", run).groupBy("rid", "item", "at", "run").agg(F.min("position").alias("start"), F.count(F.lit(1)).alias("length"), F.max("asked").alias("asked"))
    return ws.save(runs.filter(F.col("length") >= F.col("asked")).select("rid", "item", "start", "length"), "matches")


def around(position: Column, reach: int) -> Column:
    """Numbers of the three stretches of `reach` words in which whatever is within reach lies."""
    own = F.floor(position / reach)
    return F.explode(F.array(own - 1, own, own + 1))


def near_terms(index: Index, window: int, least: int) -> DataFrame:
    """(set, term_id, need): the words of the windows that have the anchors of a set, and how many different ones of them
    a near match has. Sets of which training has fewer can't match."""
    ends = index.anchors.select("set", "item").distinct().join(reaches(index, window), "set")
    words = ends.join(index.places, "item").filter("offset between low and high").select("set", "term_id").distinct().join(index.frequency.withColumnRenamed("n", "known"), "term_id", "left")
    needs = words.groupBy("set").agg(F.least(F.count(F.lit(1)), F.lit(least)).alias("need"), F.count("known").alias("n_known")).filter("n_known >= need")
    return words.filter("known is not null").join(needs, "set").select("set", "term_id", "need")


def near_matches(index: Index, ws: Workspace, window: int = WINDOW, reach: int = REACH, least: int = LEAST) -> DataFrame:
    """(rid, item, near): positions of an anchor with the other anchors of its windows, and `least` different words of
    these windows (all, if they have fewer), within `reach` words of it, in any order."""
    words = ws.save(near_terms(index, window, least), "near-terms")
    anchors = index.anchors.join(words.select("set").distinct(), "set", "left_semi")
    asked = index.postings.join(small(anchors, "term_id"), "term_id").select("rid", "set", "item", "position", "rank", "n_anchors")
    first = asked.filter("rank = 0").select("rid", "set", "item", "n_anchors", F.col("position").alias("near"))
    others = asked.filter("rank > 0").select("rid", "set", "rank", "position", F.floor(F.col("position") / reach).alias("stretch"))
    met = first.filter("n_anchors > 1").withColumn("stretch", around(F.col("near"), reach)).join(others, ["rid", "set", "stretch"]).filter(F.abs(F.col("position") - F.col("near")) <= reach)
    together = met.groupBy("rid", "set", "item", "near", "n_anchors").agg(F.bit_or(F.expr("shiftleft(1L, rank)")).alias("ranks")).filter("bit_count(ranks) = n_anchors - 1")
    places = ws.save(together.select("rid", "set", "item", "near").unionByName(first.filter("n_anchors = 1").select("rid", "set", "item", "near")), "near-places")
    rids = ws.save(places.select("rid").distinct(), "near-rows")
    wanted = places.join(small(words, "term_id"), "set").withColumn("stretch", around(F.col("near"), reach))
    there = of_rows(index, rids).withColumn("stretch", F.floor(F.col("position") / reach))
    found = wanted.join(there, ["rid", "term_id", "stretch"]).filter(F.abs(F.col("position") - F.col("near")) <= reach)
    return found.groupBy("rid", "set", "item", "near").agg(F.count_distinct("term_id").alias("n"), F.max("need").alias("need")).filter("n >= need").select("rid", "item", "near").distinct()


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchors: int = ANCHORS, near: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with near also n_near, the
    number of items of which a near match stands in the document."""
    ws = Workspace(spark, "decontaminate")
    index = build_index(docs.select("doc_id", "text"), benchmark, ws, window, anchors)
    matches = phrase_matches(index, ws, window)
    hit = matches.select("rid", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("position")).distinct().groupBy("rid").agg(F.count(F.lit(1)).alias("n_hit"))
    # one document holds at most as many items as it has words
    items = matches.select("rid", "item").join(index.items.select("item", "item_id"), "item").select("rid", "item_id").distinct().groupBy("rid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    rows = index.rows.join(hit.join(items, "rid"), "rid", "left")
    if near:
        close = near_matches(index, ws, window).join(index.items.select("item", "item_id"), "item").groupBy("rid").agg(F.count_distinct("item_id").alias("n_near"))
        rows = rows.join(close, "rid", "left")
    return rows.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        *([F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")] if near else []),
    )


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents in which a window of the benchmark occurs; all columns stay."""
    ws = Workspace(spark, "decontaminate")
    index = build_index(docs.select("doc_id", "text"), benchmark, ws, window)
    dirty = ws.save(index.rows.join(phrase_matches(index, ws, window).select("rid").distinct(), "rid", "left_semi").select("k1", "k2").distinct(), "dirty")
    k1, k2 = text_key(F.col("text"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), k1, k2)
    return keyed.join(dirty, ["k1", "k2"], "left_anti").select("row.*")
