"""Registered queries of the operators, each over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import RULES
from ..functions.text import count_lines
from ..operators import analysis, chunking, corpus, evaluation, judge, ordering
from ..schemas import SEVERITIES
from ..schemas import FILES as FILES_SCHEMA
from ..sources import cache as caches
from ..sources import readers, writers
from ..sources import snapshot
from ..sources.named_files import write_named
from ..sources.tables import Tables
from ..streaming import incremental
from . import inputs
from . import scan as jobs
from .inputs import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- SQL fragments -------------------------------------------------------------------------------------------------

def cases(number: str) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in inputs.TOKENS.items()) + " ELSE '' END"


FILE_KEYS = "lang AS target, source AS crate, concat('src/d', doc_id, '.rs') AS rel_path"
FILES = f"files AS (SELECT {FILE_KEYS}, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: x || {cases('(doc_id * 31 + i - 1) % 13')}), chr(10)) AS content FROM documents)"
LONG_FILES = f"""doubled AS (SELECT *, string_split(array_to_string([coalesce(text, '') FOR z IN range(12)], chr(10)), chr(10)) AS l FROM documents),
    files AS (SELECT {FILE_KEYS}, array_to_string(list_transform(l, lambda x, i: x || CASE WHEN ((i - 1) * 7919 + doc_id) % 97 = 0 OR ((i - 1) * 31 + doc_id) % 389 = 0 THEN {cases('(i - 1) % 4')} ELSE '' END), chr(10)) AS content FROM doubled)"""
LINES = "lines AS (SELECT target, crate, rel_path, content, len(ls) AS n, ls, i, ls[i] AS line FROM (SELECT *, string_split(content, chr(10)) AS ls FROM files), range(1, len(ls) + 1) AS t(i))"


def hits(mode: str, source: str = "lines", text: str = "line") -> str:
    """hits: a row for each hint that a row's text has, with the rule's place."""
    tests = " UNION ALL ".join(f"SELECT *, {k} AS rule, '{h}' AS hint FROM {source} WHERE regexp_matches({text}, '{p}')" for k, (h, p) in enumerate(RULES[mode]))
    return f"hits AS ({tests})"


SEVERITY_LIST = "[" + ", ".join(f"'{s}'" for s in SEVERITIES) + "]"
FINDINGS = f"""findings AS (SELECT concat('t', l_suppkey % 20) AS target, CASE WHEN l_suppkey % 7 <> 0 THEN concat('c', l_suppkey % 4) END AS crate,
    CASE l_returnflag WHEN 'A' THEN 'SQL_Injection' WHEN 'N' THEN 'weak crypto' ELSE 'sqli' END AS rule_id, ({SEVERITY_LIST})[month(l_shipdate) % 5 + 1] AS severity, month(l_shipdate) % 5 AS rank, CASE WHEN l_linenumber % 3 = 0 THEN 'CWE-89' END AS cwe,
    concat('src/f', l_partkey % 50, '.rs') AS file, (l_linenumber * 10 + l_quantity)::INT AS line_start, ((l_linenumber * 10 + l_quantity)::INT + l_suppkey % 5)::INT AS line_end, concat('<s> & ', l_partkey) AS summary, concat('e ', l_partkey) AS evidence, 'f' AS fix_suggestion, l_discount * 10 AS confidence,
    ((l_orderkey * 8 + l_linenumber) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate))::BIGINT AS ord FROM lineitem)"""
ENTRIES = f"""entries AS (SELECT concat('t', p_partkey % 20) AS target, p_partkey::INT AS ord, concat('p', p_partkey) AS id, concat('src/f', (p_partkey // 20) % 50, '.rs') AS file, (p_size + 10)::INT AS line_start, (p_size + 10 + p_partkey % 7)::INT AS line_end,
    CASE p_partkey % 3 WHEN 0 THEN 'sql-injection' WHEN 1 THEN 'weak-crypto' ELSE 'toctou' END AS category, ({SEVERITY_LIST})[p_partkey % 5 + 1] AS severity, p_partkey % 4 <> 0 AS must_detect, CASE WHEN p_partkey % 2 = 0 THEN 'sqli' ELSE 'weak-crypto' END AS alias FROM part)"""
TARGETS = "targets AS (SELECT DISTINCT concat('t', s_suppkey % 21) AS target FROM supplier)"
MATCHED = """
    cand AS (SELECT f.*, e.id AS eid, e.must_detect AS em, e.severity AS es, e.ord AS eo, abs((e.line_start + e.line_end) / 2.0 - (f.line_start + f.line_end) / 2.0) AS dist FROM findings AS f
        JOIN named AS e ON e.target = f.target AND e.file = f.file AND e.name = regexp_replace(lower(f.rule_id), '[\\s_-]+', '-', 'g') AND f.line_end >= e.line_start - 5 AND f.line_start <= e.line_end + 5 WHERE f.target IN (SELECT target FROM targets)),
    best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY target, ord ORDER BY dist, eo) = 1),
    matches AS (SELECT f.*, b.eid AS matched_id, CASE WHEN b.eid IS NULL THEN 'none' WHEN b.em THEN 'must' ELSE 'bonus' END AS match_kind, b.es AS expected_severity FROM findings AS f LEFT JOIN best AS b ON b.target = f.target AND b.ord = f.ord),
    hit AS (SELECT e.*, EXISTS (SELECT 1 FROM matches AS m WHERE m.target = e.target AND m.matched_id = e.id) AS hit FROM entries AS e),
    summary AS (SELECT target, coalesce(must_total, 0)::BIGINT AS must_total, coalesce(must_hit, 0)::BIGINT AS must_hit, coalesce(bonus_total, 0)::BIGINT AS bonus_total, coalesce(bonus_hit, 0)::BIGINT AS bonus_hit, coalesce(reported_total, 0)::BIGINT AS reported_total, coalesce(true_positives, 0)::BIGINT AS true_positives, coalesce(false_positives, 0)::BIGINT AS false_positives FROM targets
        LEFT JOIN (SELECT target, count(*) FILTER (WHERE must_detect) AS must_total, count(*) FILTER (WHERE must_detect AND hit) AS must_hit, count(*) FILTER (WHERE NOT must_detect) AS bonus_total, count(*) FILTER (WHERE NOT must_detect AND hit) AS bonus_hit FROM hit GROUP BY target) USING (target)
        LEFT JOIN (SELECT target, count(*) AS reported_total, count(matched_id) AS true_positives, count(*) - count(matched_id) AS false_positives FROM matches GROUP BY target) USING (target))"""
MATCHES = f"""{FINDINGS}, {ENTRIES}, {TARGETS}, named AS (SELECT *, category AS name FROM entries UNION SELECT *, alias AS name FROM entries), {MATCHED}"""
RATES = "CASE WHEN must_total = 0 THEN 1.0 ELSE must_hit / must_total END::DOUBLE AS recall, CASE WHEN reported_total = 0 THEN 1.0 ELSE true_positives / reported_total END::DOUBLE AS precision"
FINDING_ORDER = "rank, confidence DESC, file, line_start, ord"


# --- corpus --------------------------------------------------------------------------------------------------------

@query(f"WITH {FILES} SELECT target, crate, count(*) AS files, sum(CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - ends_with(content, chr(10))::INT END)::BIGINT AS lines FROM files GROUP BY ALL")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_stats(inputs.files(spark, sf_dir), "target", "crate")


CRATES = """member AS (SELECT n_nationkey AS n, n_name AS name, n_regionkey AS r FROM nation), crates AS (
    SELECT concat('t', r_regionkey) AS target, r_name AS name, concat('/w/t', r_regionkey) AS root_dir FROM region WHERE r_regionkey % 2 = 0
    UNION ALL SELECT concat('t', r), CASE WHEN n % 4 <> 0 THEN name ELSE concat('m', n) END, concat('/w/t', r, '/m', n) FROM member WHERE n NOT IN (3, 12) AND n % 9 <> 8 AND r % 2 = 0
    UNION ALL SELECT concat('t', r), CASE WHEN n % 4 <> 0 THEN name ELSE concat('m', n) END, concat('/w/t', r, '/m', n) FROM member WHERE n NOT IN (3, 12) AND n % 9 <> 8 AND r % 2 = 1 AND (n IN (1, 6) OR n BETWEEN 10 AND 19))"""


@query(f"WITH {CRATES} SELECT target, name, root_dir, concat(root_dir, '/Cargo.toml') AS manifest_path FROM crates")
def resolve_crates(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, manifests, _ = inputs.crate_tables(spark, sf_dir)
    return corpus.resolve_crates(targets, manifests)


@query(f"WITH {CRATES} SELECT target, name, root_dir, concat(root_dir, '/Cargo.toml') AS manifest_path FROM crates WHERE name IN ('ASIA', 'CHINA', 'm4', 'm16', 'none')")
def filter_crates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.filter_crates(resolve_crates(spark, sf_dir), ["ASIA", "CHINA", "m4", "m16", "none"])


@query("SELECT concat('t', r_regionkey) AS target, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE concat('t', r_regionkey) END AS project_name, true AS is_workspace FROM region")
def project_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, manifests, _ = inputs.crate_tables(spark, sf_dir)
    return corpus.project_info(targets, manifests)


ATTRIBUTED = f"""{CRATES}, f AS (SELECT concat('t', n_regionkey) AS target, concat(CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE concat('m', n_nationkey) END, '/src/c', c_custkey, '.rs') AS rel_path, concat('/w/t', n_regionkey, '/') AS base FROM customer JOIN nation ON c_nationkey = n_nationkey),
    a AS (SELECT f.target, base || rel_path AS path, rel_path, name AS crate, length(root_dir) AS depth FROM f JOIN crates AS c ON c.target = f.target AND starts_with(base || rel_path, root_dir || '/') QUALIFY row_number() OVER (PARTITION BY f.target, base || rel_path ORDER BY length(root_dir) DESC, name DESC) = 1)"""


@query(f"WITH {ATTRIBUTED} SELECT target, path, rel_path, crate FROM a")
def attribute_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, manifests, files = inputs.crate_tables(spark, sf_dir)
    return corpus.attribute_files(files, corpus.resolve_crates(targets, manifests))


@query(f"WITH {ATTRIBUTED}, d AS (SELECT target, name AS crate, max(length(root_dir)) AS deep FROM crates GROUP BY ALL) SELECT target, path, rel_path, crate FROM a JOIN d USING (target, crate) QUALIFY row_number() OVER (PARTITION BY target ORDER BY deep DESC, rel_path) <= 25")
def limit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, manifests, files = inputs.crate_tables(spark, sf_dir)
    crates = corpus.resolve_crates(targets, manifests)
    return corpus.limit_files(corpus.attribute_files(files, crates), crates, 25)


# --- chunks --------------------------------------------------------------------------------------------------------

@query(f"WITH {FILES}, {LINES}, {hits('safety')} SELECT DISTINCT target, crate, rel_path, i::INT AS line, hint FROM hits")
def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_hits(inputs.files(spark, sf_dir))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("target", "crate", "rel_path", "start_line", "end_line", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), F.array_join("hints", ",").alias("hints"))


def file_chunk_sql(mode: str) -> str:
    return f"""WITH {FILES}, {LINES}, {hits(mode)}, h AS (SELECT target, crate, rel_path, hint, arg_min(content, i) AS content, max(n) AS n, min(i) AS first_line, min(rule) AS rule FROM hits GROUP BY ALL)
        SELECT target, crate, rel_path, 1::INT AS start_line, max(n)::INT AS end_line, md5(min(content)) AS content_md5, string_agg(hint, ',' ORDER BY first_line, rule) AS hints FROM h GROUP BY ALL"""


for _mode in RULES:

    def _file_chunks(spark: SparkSession, sf_dir: str, mode: str = _mode) -> DataFrame:
        return chunk_rows(chunking.file_chunks(inputs.files(spark, sf_dir), mode))

    QUERIES[f"file_chunks_{_mode}"], SQL[f"file_chunks_{_mode}"] = _file_chunks, file_chunk_sql(_mode)


WINDOWS = f"""{LONG_FILES}, {LINES}, {hits('safety')}, g AS (SELECT *, sum(new) OVER (PARTITION BY target, crate, rel_path ORDER BY i, rule ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY target, crate, rel_path ORDER BY i, rule) <= 91 THEN 0 ELSE 1 END AS new FROM hits)),
    w AS (SELECT target, crate, rel_path, island, hint, arg_min(ls, i) AS ls, max(n) AS n, min(i) AS first_line, max(i) AS last_line, min(rule) AS rule FROM g GROUP BY ALL),
    c AS (SELECT target, crate, rel_path, greatest(min(first_line) - 10, 1)::INT AS start_line, least(max(last_line) + 80, max(n))::INT AS end_line, any_value(ls) AS ls, string_agg(hint, ',' ORDER BY first_line, rule) AS hints FROM w GROUP BY target, crate, rel_path, island)"""


@query(f"WITH {WINDOWS} SELECT target, crate, rel_path, start_line, end_line, md5(array_to_string(ls[start_line:end_line], chr(10))) AS content_md5, hints FROM c")
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(chunking.window_chunks(inputs.long_files(spark, sf_dir)))


@query(f"WITH {WINDOWS} SELECT target, crate, rel_path, start_line, end_line, replace(hints, ',', ', ') AS hints FROM c")
def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_listing(chunking.chunk(inputs.long_files(spark, sf_dir), "function"))


FUNCTIONS = f"""d AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    f AS (SELECT {FILE_KEYS}, doc_id, j, CASE doc_id % 2 WHEN 1 THEN 2 ELSE 0 END + 3 * (j - 1) + 1 AS start_line, concat('fn f', j - 1, '() {{', chr(10), '  g(); // ', regexp_replace(l[j], '[^A-Za-z0-9 ]', '', 'g'), CASE WHEN (doc_id + j - 1) % 3 = 0 THEN {cases('(doc_id * 31 + j - 1) % 5')} ELSE '' END, chr(10), '}}') AS body FROM d, range(1, len(l) + 1) AS t(j)),
    {hits('safety', 'f', 'body')}, c AS (SELECT target, crate, rel_path, doc_id, start_line::INT AS start_line, (start_line + 2)::INT AS end_line, any_value(body) AS body, string_agg(hint, ',' ORDER BY rule) AS hints FROM hits GROUP BY ALL)""".replace("{{", "{").replace("}}", "}")


@query(f"""WITH {FUNCTIONS} SELECT target, crate, rel_path, start_line, end_line, md5(CASE WHEN doc_id % 2 = 1 THEN concat('{chunking.USES_HEADER}', chr(10), 'use std::fs;', chr(10), '{chunking.SCOPE_HEADER}', chr(10), '// impl T', chr(10), '// --- function body @ lines ', start_line, '-', end_line, ' ---', chr(10)) ELSE '' END || body) AS content_md5, hints FROM c""")
def function_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(chunking.chunk(inputs.function_files(spark, sf_dir), "ast-function"))


@query(f"WITH {FUNCTIONS} SELECT target, crate, hint, count(*) AS chunks FROM (SELECT target, crate, unnest(string_split(hints, ',')) AS hint FROM c) GROUP BY ALL")
def hint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.hint_counts(chunking.chunk(inputs.function_files(spark, sf_dir), "ast-function"))


# --- analysis ------------------------------------------------------------------------------------------------------

@query(f"""WITH {FILES}, {LINES}, {hits('safety')}, h AS (SELECT target, crate, rel_path, hint, arg_min(content, i) AS content, max(n) AS n, min(i) AS first_line, min(rule) AS rule FROM hits GROUP BY ALL),
    c AS (SELECT target, crate, rel_path, max(n) AS n, min(content) AS content, string_agg(hint, ' ' ORDER BY first_line, rule) AS hints FROM h GROUP BY ALL)
    SELECT target, concat(crate, '/', rel_path, ':1-', n, '#', sha1(content)[1:12]) AS request_key, md5(concat_ws(chr(10), 'Package ' || crate, concat('Source ', rel_path, ', from line 1 to ', n), 'Rules that fired: ' || hints, '~~~', content, '~~~', 'Reply with JSON and nothing else.')) AS prompt_md5 FROM c""")
def analysis_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.analysis_requests(chunking.file_chunks(inputs.files(spark, sf_dir))).select("target", "request_key", F.md5(F.encode("user_prompt", "UTF-8")).alias("prompt_md5"))


@query("""SELECT o_orderkey, sha256(concat('{"projectPath":"/p/', o_custkey, '","provider":"', o_orderstatus, '","model":"', o_orderpriority, '","unit":"file","mode":"safety","judge":', (o_orderkey % 2 = 0)::VARCHAR, ',"crates":["', array_to_string(list_sort([concat('c', o_orderkey % 5), concat('b', o_custkey % 7), concat('d', o_custkey % 3)]), '","'), '"]}'))[1:12] AS config_hash FROM orders""")
def config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    def name(p: str, c: str, n: int):
        return F.concat(F.lit(p), (F.col(c) % n).cast("string"))

    crates = F.array(name("c", "o_orderkey", 5), name("b", "o_custkey", 7), name("d", "o_custkey", 3))
    h = analysis.config_hash(F.concat(F.lit("/p/"), F.col("o_custkey").cast("string")), F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("file"), F.lit("safety"), F.col("o_orderkey") % 2 == 0, crates)
    return table(spark, sf_dir, "orders").select("o_orderkey", h.alias("config_hash"))


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of three events' keys; every seventh is torn, every fifth a judge's, every eleventh of another type."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 11 == 0, "meta").when(F.col("event_id") % 5 == 0, "judge").otherwise("chunk")
    line = F.concat(F.lit('{"type":"'), kind, F.lit('","'), F.when(kind == "judge", "findingKey").otherwise("chunkKey"), F.lit('":"k'), (F.col("user_id") % 300).cast("string"), F.lit('","findings":[],"inputTokens":'), (F.col("event_id") % 100).cast("string"), F.lit(',"outputTokens":7}'))
    target = F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string"))
    return e.select(target.alias("target"), F.lit("h").alias("config_hash"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 30)).otherwise(line).alias("value"))


CACHE = "cache AS (SELECT target, type, key, arg_max(event_id, event_id) AS seq FROM (SELECT concat('t', user_id % 5) AS target, CASE WHEN event_id % 5 = 0 THEN 'judge' ELSE 'chunk' END AS type, concat('k', user_id % 300) AS key, event_id FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0) GROUP BY ALL)"


@query(f"WITH {CACHE} SELECT target, 'h' AS config_hash, type, key, '[]' AS findings, (seq % 100)::BIGINT AS input_tokens, 7::BIGINT AS output_tokens, seq FROM cache")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.latest(readers.records_from(cache_log(spark, sf_dir))).drop("decision")


def keyed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each customer, its key like those of the cache."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), (F.col("c_custkey") % 5).cast("string")).alias("target"), F.concat(F.lit("k"), (F.col("c_custkey") % 300).cast("string")).alias("chunk_key"))


@query(f"WITH {CACHE}, c AS (SELECT concat('t', c_custkey % 5) AS target, concat('k', c_custkey % 300) AS key FROM customer) SELECT target, count(k.key) AS finished, count(*) AS total, (count(k.key) * 100 // count(*))::BIGINT AS percent FROM c LEFT JOIN (SELECT target, key FROM cache WHERE type = 'chunk') AS k USING (target, key) GROUP BY target")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = keyed_chunks(spark, sf_dir)
    done = readers.latest(readers.records_from(cache_log(spark, sf_dir))).filter("type = 'chunk'").select("target", F.col("key").alias("chunk_key"))
    return analysis.progress(chunks, done)


@query(f"""WITH {FILES}, {LINES}, {hits('safety')}, h AS (SELECT target, crate, rel_path, arg_min(content, i) AS content, max(n) AS n FROM hits GROUP BY ALL)
    SELECT target, concat(crate, '/', rel_path, ':1-', n, '#', sha1(content)[1:12]) AS chunk_key, regexp_extract(rel_path, '[0-9]+')::BIGINT % 3 = 0 AS cached, CASE WHEN regexp_extract(rel_path, '[0-9]+')::BIGINT % 3 = 0 THEN n ELSE 0 END::BIGINT AS input_tokens FROM h""")
def split_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.file_chunks(inputs.files(spark, sf_dir))
    own = analysis.with_chunk_key(chunks).filter(F.regexp_extract("rel_path", "[0-9]+", 0).cast("bigint") % 3 == 0)
    cache = own.select("target", F.lit("h").alias("config_hash"), F.lit("chunk").alias("type"), F.col("chunk_key").alias("key"), F.lit("[]").alias("findings"), F.col("end_line").cast("bigint").alias("input_tokens"), F.lit(1).cast("bigint").alias("output_tokens"))
    got, pending = analysis.split_cached(chunks, cache, "h")
    return got.select("target", "chunk_key", F.lit(True).alias("cached"), "input_tokens").unionByName(pending.select("target", "chunk_key", F.lit(False).alias("cached"), F.lit(0).cast("bigint").alias("input_tokens")))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's model reply in prose: good, with a bad finding, with null for cwe, with 1.0 as a line, torn, ..."""
    n = F.col("event_id") % 8
    quote = F.when(n == 5, F.lit("not in it")).otherwise(F.concat(F.lit("ev  "), F.col("event_id").cast("string")))
    one = F.concat(
        F.lit('{"rule_id":"r","severity":"'), F.when(n == 1, "severe").otherwise("high"), F.lit('",'), F.when(n == 2, '"cwe":null,').otherwise(""), F.lit('"file":"f","line_start":'), F.when(n == 3, "1.0").otherwise("1"), F.lit(',"line_end":2,"summary":"s","evidence":"'), quote,
        F.lit('","fix_suggestion":"x","confidence":'), F.when(n == 4, "1.5").otherwise("0.5"), F.lit("}"),
    )
    text = F.concat(F.lit("Here it is: {\"findings\":["), one, F.lit(","), one, F.lit(']} '), F.when(n == 6, "} and more").otherwise("done."))
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("chunk_key"), text.alias("text"), F.when(n == 7, "timeout").alias("error"), "event_id", "user_id")


@query("SELECT concat('t', user_id % 10 + 10 * s) AS target, 'c' AS crate, event_id::VARCHAR AS chunk_key, o::BIGINT AS ord, 1::INT AS line_start, concat('ev  ', event_id) AS evidence FROM events, range(2) AS t(o), range(2) AS u(s) WHERE event_id % 8 IN (0, 3)")
def findings_from_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two targets hold the same file, and each has its own reply."""
    twice = F.explode(F.array(F.lit(0), F.lit(10))).alias("s")
    r = replies(spark, sf_dir).select("*", twice).withColumn("target", F.concat(F.lit("t"), (F.col("user_id") % 10 + F.col("s")).cast("string")))
    chunks = r.select("target", F.lit("c").alias("crate"), "chunk_key", F.concat(F.lit("a\n\tev\n"), F.col("event_id").cast("string"), F.lit(" b")).alias("content"))
    return analysis.findings_from_responses(chunks, r).select("target", "crate", "chunk_key", "ord", "line_start", "evidence")


RUN_STATS = """SELECT concat('t', user_id % 10) AS target, coalesce(sum(event_id % 50) FILTER (WHERE event_id % 6 <> 0 AND event_id % 8 <> 7), 0)::BIGINT AS input_tokens, coalesce(sum(3) FILTER (WHERE event_id % 8 <> 7), 0)::BIGINT AS output_tokens, count(*) FILTER (WHERE event_id % 8 <> 7 AND event_id % 4 <> 1) AS analyze_calls,
    count(*) FILTER (WHERE event_id % 8 <> 7 AND event_id % 4 = 1) AS judge_calls, count(*) FILTER (WHERE event_id % 8 <> 7 AND event_id % 4 <> 1 AND event_id % 3 = 0) AS analyze_cache_hits, count(*) FILTER (WHERE event_id % 8 <> 7 AND event_id % 4 = 1 AND event_id % 3 = 0) AS judge_cache_hits FROM events GROUP BY ALL"""


@query(RUN_STATS)
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("target"), F.when(e % 4 == 1, "judge").otherwise("analyze").alias("step"), (e % 3 == 0).alias("cached"), F.when(e % 8 == 7, "timeout").alias("error"), F.when(e % 6 != 0, e % 50).alias("input_tokens"), F.lit(3).cast("bigint").alias("output_tokens"))
    return analysis.run_stats(rows)


# --- judge ---------------------------------------------------------------------------------------------------------

@query("""SELECT event_id, CASE WHEN n = 1 THEN 'drop' WHEN n = 2 THEN 'downgrade' ELSE 'keep' END AS kind, CASE WHEN n = 2 THEN 'low' END AS new_severity, CASE WHEN n IN (1, 2) THEN 'why' END AS reason FROM (SELECT event_id, event_id % 8 AS n FROM events)""")
def judge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 8
    word = F.when(n == 0, "confirm").when(n == 1, "reject").when(n == 6, "maybe").otherwise("downgrade")
    severity = F.when(n == 2, ',"new_severity":"low"').when(n == 3, ',"new_severity":"critical"').when(n == 4, ',"new_severity":null').otherwise("")
    text = F.concat(F.lit('Well {"verdict":"'), word, F.lit('"'), severity, F.lit(',"reason":"why","confidence":'), F.when(n == 7, "2").otherwise("0.9"), F.lit("}"))
    rows = judge.parse_verdicts(table(spark, sf_dir, "events").select("event_id", text.alias("text")))
    return rows.select("event_id", judge.decide(F.lit("critical"), F.col("verdict")).alias("d")).select("event_id", "d.*")


DECIDED = f"""{FINDINGS}, keyed AS (SELECT *, concat(file, ':', line_start, '-', line_end, '#', rule_id, '#', sha1(evidence)[1:8]) AS finding_key FROM findings)"""


@query(f"""WITH {DECIDED} SELECT target, ord, CASE WHEN severity = 'critical' AND line_start % 3 = 1 THEN 'low' ELSE severity END AS severity FROM keyed WHERE NOT (severity = 'critical' AND line_start % 3 = 0)""")
def apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inputs.findings(spark, sf_dir)
    keys = judge.with_finding_key(judge.judge_candidates(found)).select("target", "finding_key", "line_start").distinct()
    k = F.col("line_start") % 3
    decisions = keys.select("target", "finding_key", F.when(k == 0, "drop").when(k == 1, "downgrade").otherwise("keep").alias("kind"), F.when(k == 1, "low").alias("new_severity"))
    return judge.apply_decisions(found, decisions).select("target", "ord", "severity")


@query(f"""WITH {DECIDED}, files AS (SELECT DISTINCT concat('t', p_partkey % 20) AS target, concat('src/f', p_partkey % 50, '.rs') AS file FROM part)
    SELECT target, finding_key AS request_key, md5(concat_ws(chr(10), concat('Claim: ', rule_id, ' (critical, sure to ', regexp_replace(confidence::VARCHAR, '\\.0$', ''), ')'), concat('Place: ', file, ' ', line_start, ' to ', line_end), 'Reason given: ' || summary, 'Quoted:', '~~~', evidence, '~~~', 'The file as it is:', '~~~', 'fn ' || file, '~~~', 'Reply with JSON and nothing else.')) AS prompt_md5
    FROM keyed JOIN files USING (target, file) WHERE severity = 'critical'""")
def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("t"), (key % 20).cast("string")).alias("target"), F.concat(F.lit("src/f"), (key % 50).cast("string"), F.lit(".rs")).alias("rel_path")).distinct().withColumn("content", F.concat(F.lit("fn "), "rel_path"))
    return judge.judge_requests(inputs.findings(spark, sf_dir), files, files).select("target", "request_key", F.md5(F.encode("user_prompt", "UTF-8")).alias("prompt_md5"))


# --- whole jobs ----------------------------------------------------------------------------------------------------

SCANNED = f"""{FILES}, {LINES}, {hits('safety')}, h AS (SELECT target, crate, rel_path, hint, arg_min(content, i) AS content, max(n) AS n, min(i) AS first_line, min(rule) AS rule FROM hits GROUP BY ALL),
    ch AS (SELECT target, crate, rel_path, regexp_extract(rel_path, '[0-9]+')::BIGINT AS doc, max(n)::INT AS n, concat(crate, '/', rel_path, ':1-', max(n), '#', sha1(min(content))[1:12]) AS key, arg_min(hint, (first_line, rule)) AS rule_id FROM h GROUP BY target, crate, rel_path),
    found AS (SELECT target, crate, doc, n, 'kept' AS rule_id, 'critical' AS severity, rel_path AS file, 0.25::DOUBLE AS confidence FROM ch WHERE doc % 4 = 0
        UNION ALL SELECT target, crate, doc, n, rule_id, (['critical', 'high', 'low'])[doc % 3 + 1], rel_path, 0.5 FROM ch WHERE doc % 4 <> 0 AND doc % 7 <> 3 AND doc % 5 <> 1),
    judged AS (SELECT * REPLACE (CASE WHEN severity = 'critical' AND n % 3 = 1 THEN 'low' ELSE severity END AS severity) FROM found WHERE severity <> 'critical' OR (doc % 8 <> 0 AND n % 3 <> 0))"""
SCAN_CALLS = f"""{SCANNED}, calls AS (SELECT target, 'analyze' AS step, doc % 4 = 0 AS cached, CASE WHEN doc % 4 = 0 THEN 2 ELSE n END AS i, CASE WHEN doc % 4 = 0 THEN 3 ELSE 7 END AS o FROM ch WHERE doc % 4 = 0 OR doc % 7 <> 3
    UNION ALL SELECT target, 'judge', doc % 8 = 0, CASE WHEN doc % 8 = 0 THEN 4 ELSE n END, CASE WHEN doc % 8 = 0 THEN 5 ELSE 1 END FROM found WHERE severity = 'critical')"""


def calls_sql(hit: str) -> str:
    return f"""WITH {SCAN_CALLS} SELECT t.target, coalesce(sum(i), 0)::BIGINT AS input_tokens, coalesce(sum(o), 0)::BIGINT AS output_tokens, count(*) FILTER (WHERE step = 'analyze') AS analyze_calls, count(*) FILTER (WHERE step = 'judge') AS judge_calls,
        count(*) FILTER (WHERE step = 'analyze' AND {hit}) AS analyze_cache_hits, count(*) FILTER (WHERE step = 'judge' AND {hit}) AS judge_cache_hits FROM (SELECT DISTINCT target FROM ch) AS t LEFT JOIN calls AS c ON c.target = t.target GROUP BY ALL"""


def scan_files(spark: SparkSession, sf_dir: str, tables: Tables) -> DataFrame:
    """The files of a scan, made once: a scan looks at them for chunks and for the judge, and so does one that follows."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    return tables.save(inputs.files(spark, sf_dir).repartition(tasks, "rel_path"), "files")


def scan_cache(files: DataFrame) -> DataFrame:
    """Of every fourth file's chunk a result is known, with one critical finding; every second of these was rejected."""
    chunks = analysis.with_chunk_key(chunking.file_chunks(files)).withColumn("doc", F.regexp_extract("rel_path", "[0-9]+", 0).cast("bigint")).filter("doc % 4 = 0")
    one = F.struct(F.lit("kept").alias("rule_id"), F.lit("critical").alias("severity"), F.col("rel_path").alias("file"), F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), F.lit("s").alias("summary"), F.lit("e").alias("evidence"), F.lit("f").alias("fix_suggestion"), F.lit(0.25).alias("confidence"))
    none, seq = F.lit(None).cast("struct<kind:string,new_severity:string,reason:string>").alias("decision"), F.lit(1).cast("bigint").alias("seq")

    def tokens(i: int, o: int) -> list:
        return [F.lit(i).cast("bigint").alias("input_tokens"), F.lit(o).cast("bigint").alias("output_tokens"), seq]

    known = chunks.select("target", F.lit("h").alias("config_hash"), F.lit("chunk").alias("type"), F.col("chunk_key").alias("key"), F.to_json(F.array(one)).alias("findings"), none, *tokens(2, 3))
    keys = judge.with_finding_key(chunks.filter("doc % 8 = 0").select("target", one.alias("f")).select("target", "f.*"))
    dropped = F.struct(F.lit("drop").alias("kind"), F.lit(None).cast("string").alias("new_severity"), F.lit("seen").alias("reason"))
    return known.unionByName(keys.select("target", F.lit("h").alias("config_hash"), F.lit("judge").alias("type"), F.col("finding_key").alias("key"), F.lit(None).cast("string").alias("findings"), dropped.alias("decision"), *tokens(4, 5)))


def scanned(spark: SparkSession, sf_dir: str, client=inputs.model) -> tuple[jobs.Scan, Tables]:
    """A scan of all files with the stand-in model and a cache that knows some of them."""
    tables = Tables(spark, "scan")
    files = scan_files(spark, sf_dir, tables)
    writers.append_cache(scan_cache(files), tables.path("cache"))
    return jobs.scan(files, caches.read_cache(spark, tables.path("cache")), "h", client, tables, unit="file", seq=2, asking=inputs.ASKING), tables


@query(f"WITH {SCANNED} SELECT target, crate, rule_id, severity, file, n AS line_end, confidence, row_number() OVER (PARTITION BY target ORDER BY list_position({SEVERITY_LIST}, severity), confidence DESC, file)::BIGINT AS place FROM judged")
def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir)[0].findings.select("target", "crate", "rule_id", "severity", "file", "line_end", "confidence", "place")


@query(calls_sql("cached"))
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.run_stats(scanned(spark, sf_dir)[0].calls)


@query(calls_sql("true"))
def scan_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scan again, from the cache that the first one has filled: what failed is asked for once more."""
    first, tables = scanned(spark, sf_dir)
    writers.append_cache(first.records, tables.path("cache"))
    again = jobs.scan(spark.read.parquet(tables.path("files")), caches.read_cache(spark, tables.path("cache")), "h", inputs.model, Tables(spark, "scan"), unit="file", seq=3, asking=inputs.ASKING)
    return analysis.run_stats(again.calls)


@query(f"WITH {SCANNED} SELECT target, key, CASE WHEN doc % 5 <> 1 THEN 1 ELSE 0 END::INT AS n_findings, CASE WHEN doc % 5 <> 1 THEN rule_id END AS rule_id, n::BIGINT AS input_tokens, 7::BIGINT AS output_tokens FROM ch WHERE doc % 7 <> 3")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after a stream over all files has ended."""
    tables = Tables(spark, "incremental")
    inputs.files(spark, sf_dir).select(*(x.split(" ")[0] for x in FILES_SCHEMA.split(", "))).write.parquet(tables.path("source"))
    incremental.incremental_scan(spark, tables.path("source"), tables.path("cache"), tables.path("checkpoint"), "h", inputs.model, unit="file", judged=False, asking=inputs.ASKING).awaitTermination()
    listed = F.from_json("findings", "array<struct<rule_id:string>>")
    return caches.read_cache(spark, tables.path("cache")).select("target", "key", F.size(listed).alias("n_findings"), F.get(listed, F.lit(0))["rule_id"].alias("rule_id"), "input_tokens", "output_tokens")


@query(f"""WITH {SCANNED.replace("AND doc % 7 <> 3 ", "").replace("doc % 4 = 0", "false").replace("doc % 4 <> 0", "true")}, k AS (SELECT target, key, doc, n, rule_id, content FROM ch JOIN (SELECT target, crate, rel_path, arg_min(content, i) AS content FROM h0 GROUP BY ALL) USING (target, crate, rel_path))
    SELECT target, 'chunk' AS type, key, CASE WHEN doc % 5 <> 1 THEN 1 ELSE 0 END::INT AS n_findings, NULL AS kind, n::BIGINT AS input_tokens, 7::BIGINT AS output_tokens FROM k
    UNION ALL SELECT target, 'judge', concat('src/d', doc, '.rs:1-', n, '#', rule_id, '#', sha1(content[1:12])[1:8]), NULL, (['drop', 'downgrade', 'keep'])[n % 3 + 1], n, 1 FROM k WHERE doc % 3 = 0 AND doc % 5 <> 1""".replace("h AS (SELECT target, crate, rel_path, hint", "h0 AS (SELECT * FROM hits), h AS (SELECT target, crate, rel_path, hint", 1))
def incremental_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after a stream of which every seventh call failed, and one over what failed: chunks and judged findings
    are those of a scan in which no call fails."""
    tables = Tables(spark, "retried")
    cache = tables.path("cache")
    inputs.files(spark, sf_dir).select(*(x.split(" ")[0] for x in FILES_SCHEMA.split(", "))).write.parquet(tables.path("source"))
    incremental.incremental_scan(spark, tables.path("source"), cache, tables.path("checkpoint"), "h", inputs.model, unit="file", asking=inputs.ASKING).awaitTermination()
    incremental.retry_failed(spark, cache, tables.path("again"), "h", inputs.reached, unit="file", asking=inputs.ASKING).awaitTermination()
    listed = F.from_json("findings", "array<struct<rule_id:string>>")
    return caches.read_cache(spark, cache).select("target", "type", "key", F.when(F.col("type") == "chunk", F.size(listed)).alias("n_findings"), "decision.kind", "input_tokens", "output_tokens")


SCANNED_TWICE = f"""{SCANNED}, again AS (SELECT *, 1 AS occurrence FROM judged UNION ALL SELECT *, 2 FROM judged WHERE doc % 6 = 5),
    texts AS (SELECT target, crate, rel_path, arg_min(content, i) AS content FROM hits GROUP BY ALL),
    findings AS (SELECT a.target, a.crate, a.rule_id, a.severity, a.file, 1::INT AS line_start, a.n::INT AS line_end, 's' AS summary, concat(a.file, ':1-', a.n, '#', a.rule_id, '#', sha1(CASE a.rule_id WHEN 'kept' THEN 'e' ELSE t.content[1:12] END)[1:8], '#', occurrence) AS finding_id,
        (row_number() OVER (PARTITION BY a.target ORDER BY a.crate, a.file, occurrence) - 1)::BIGINT AS ord FROM again AS a JOIN texts AS t ON t.target = a.target AND t.crate = a.crate AND t.rel_path = a.file),
    entries AS (SELECT lang AS target, doc_id::INT AS ord, concat('e', doc_id) AS id, concat('src/d', doc_id, '.rs') AS file, 2 AS line_start, 3 AS line_end, 'Kept' AS category, ({SEVERITY_LIST})[doc_id % 5 + 1] AS severity, doc_id % 5 <> 0 AS must_detect, doc_id FROM documents WHERE doc_id % 2 = 0),
    targets AS (SELECT DISTINCT lang AS target FROM documents), named AS (SELECT *, unnest(CASE doc_id % 3 WHEN 0 THEN ['kept', 'unsafe'] WHEN 1 THEN ['kept', 'panic'] ELSE ['kept', 'cast', 'unsafe'] END) AS name FROM entries), {MATCHED}"""


def scan_matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A scan's findings against truth, as they come from the scan."""
    found, tables = scanned(spark, sf_dir, inputs.repeating)
    entries, targets = inputs.truth_of_files(spark, sf_dir)
    return tables.save(evaluation.match_findings(found.findings, entries, targets, strict=True), "matches"), entries, targets


@query(f"WITH {SCANNED_TWICE} SELECT target, crate, finding_id, ord, file, severity, matched_id, match_kind FROM matches")
def scan_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of many files, some given twice, each with its own id and match."""
    return scan_matches(spark, sf_dir)[0].select("target", "crate", "finding_id", "ord", "file", "severity", "matched_id", "match_kind")


@query(f"WITH {SCANNED_TWICE} SELECT *, {RATES} FROM summary")
def scan_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to recall and precision."""
    return evaluation.evaluate(*scan_matches(spark, sf_dir))


@query(f"WITH {CACHE} SELECT target, 'h' AS config_hash, type, key, '[]' AS findings, (seq % 100)::BIGINT AS input_tokens, 7::BIGINT AS output_tokens, seq FROM cache")
def cache_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after three appends, with a compaction after the first and the second."""
    path = Tables(spark, "cache").path("cache")
    rows = readers.records_from(cache_log(spark, sf_dir))
    for part in range(3):
        writers.append_cache(rows.filter(F.col("seq") % 3 == part), path)
        if part < 2:
            caches.compact_cache(spark, path)
    return caches.read_cache(spark, path).drop("decision")


# --- source trees on disk -------------------------------------------------------------------------------------------

@query(f"""WITH {FILES}, f AS (SELECT target, concat(crate, '/', rel_path) AS rel_path, content, regexp_extract(rel_path, '[0-9]+')::BIGINT % 10 AS k FROM files)
    SELECT target, rel_path, CASE k WHEN 3 THEN 'added' WHEN 7 THEN 'gone' ELSE 'changed' END AS kind, sha256(CASE k WHEN 5 THEN content || '!' ELSE content END) AS digest, k <> 7 AS packed FROM f WHERE k IN (3, 5, 7)""")
def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two releases of all files, written under their own names and taken as snapshots: what the second one changed."""
    tables = Tables(spark, "releases")
    k = F.regexp_extract("rel_path", "[0-9]+", 0).cast("bigint") % 10
    files = inputs.files(spark, sf_dir).select(F.concat_ws("/", "target", "crate", "rel_path").alias("name"), "content", k.alias("k"))
    write_named(files.filter("k <> 3"), tables.path("first"))
    write_named(files.filter("k <> 7").withColumn("content", F.when(F.col("k") == 5, F.concat("content", F.lit("!"))).otherwise(F.col("content"))), tables.path("second"))
    for release in ("first", "second"):
        n = snapshot.take_snapshot(spark, tables.path(release), tables.path("snapshots"))
    packed = snapshot.packed_files(spark, tables.path("snapshots"), n).select("target", "rel_path", F.lit(True).alias("packed"))
    return snapshot.changes(spark, tables.path("snapshots"), n).join(packed, ["target", "rel_path"], "left").withColumn("packed", F.coalesce("packed", F.lit(False)))


@query("""SELECT concat('t', r_regionkey) AS target, '' AS dir, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS package_name, true AS is_workspace, CASE WHEN r_regionkey % 2 = 0 THEN 'm*' ELSE 'm1,./m6' END AS members, 'm3' AS exclude, true AS parse_ok FROM region
    UNION ALL SELECT concat('t', n_regionkey), concat('/m', n_nationkey), CASE WHEN n_nationkey % 9 <> 8 AND n_nationkey % 4 <> 0 THEN n_name END, CASE WHEN n_nationkey % 9 <> 8 THEN false END, '', '', n_nationkey % 9 <> 8 FROM nation""")
def read_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of a workspace for each region with a member for each nation, written and read back; some are broken."""
    even = F.col("r_regionkey") % 2 == 0
    top = F.concat(F.when(even, F.concat(F.lit('[package]\nname = "'), "r_name", F.lit('"\n'))).otherwise(""), F.lit("[workspace]\nexclude = ['m3']\nmembers = "), F.when(even, '["m*"]\n').otherwise('["m1", "./m6"]\n'))
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("t"), F.col("r_regionkey").cast("string"), F.lit("/Cargo.toml")).alias("name"), top.alias("content"))
    n = F.col("n_nationkey")
    text = F.when(n % 9 == 8, "[[[").when(n % 4 == 0, "[package]\nname = 3\n").otherwise(F.concat(F.lit('[package]\nname = "'), "n_name", F.lit('"\n')))
    members = table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), F.col("n_regionkey").cast("string"), F.lit("/m"), n.cast("string"), F.lit("/Cargo.toml")).alias("name"), text.alias("content"))
    root = Tables(spark, "manifests").path("tree")
    write_named(roots.unionByName(members), root)
    got = readers.read_manifests(spark, root)
    inside = F.expr(f"substring(dir, {len(readers.plain_root(root)) + 1})")
    return got.select("target", F.regexp_replace(inside, "^/[^/]*", "").alias("dir"), "package_name", "is_workspace", F.array_join("members", ",").alias("members"), F.array_join("exclude", ",").alias("exclude"), "parse_ok")


TREE = SCANNED.replace(FILE_KEYS, "lang AS target, CASE WHEN doc_id % 5 = 0 THEN 'inner' ELSE lang END AS crate, concat(CASE WHEN doc_id % 5 = 0 THEN 'x/' ELSE '' END, 'src/d', doc_id, '.rs') AS rel_path").replace("doc % 4 = 0", "false").replace("doc % 4 <> 0", "true").replace("doc % 8 <> 0 AND ", "")


@query(f"WITH {TREE} SELECT target, crate, rule_id, severity, file, n AS line_end, row_number() OVER (PARTITION BY target ORDER BY list_position({SEVERITY_LIST}, severity), file)::BIGINT AS place, true AS listed FROM judged")
def scan_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of source trees on disk: manifests, crates, files, model, judge, cache, and reports under their own names, in
    which each finding is looked up."""
    tables = Tables(spark, "root")
    d = inputs.files(spark, sf_dir)
    inner = F.regexp_extract("rel_path", "[0-9]+", 0).cast("bigint") % 5 == 0
    sources = d.select(F.concat("target", F.when(inner, "/x/").otherwise("/"), "rel_path").alias("name"), "content")
    each = d.select("target").distinct()
    outer = each.select(F.concat("target", F.lit("/Cargo.toml")).alias("name"), F.concat(F.lit('[package]\nname = "'), "target", F.lit('"\n[workspace]\nmembers = ["x"]\n')).alias("content"))
    member = each.select(F.concat("target", F.lit("/x/Cargo.toml")).alias("name"), F.lit('[package]\nname = "inner"\n').alias("content"))
    write_named(sources.unionByName(outer).unionByName(member), tables.path("tree"))
    done = jobs.scan_root(spark, tables.path("tree"), "h", inputs.model, tables, tables.path("cache"), tables.path("reports"), unit="file", provider="prov", model="m", asking=inputs.ASKING)
    pages = readers.below(spark, tables.path("reports"), "*.html").select(F.regexp_extract("inside", "^(.*?)-prov-m", 1).alias("target"), F.explode(F.expr("regexp_extract_all(content, '([a-z0-9/]+[.]rs):', 1)")).alias("file"))
    listed = pages.distinct().withColumn("listed", F.lit(True))
    return done.findings.join(listed, ["target", "file"], "left").select("target", "crate", "rule_id", "severity", "file", "line_end", "place", F.coalesce("listed", F.lit(False)).alias("listed"))


# --- order ---------------------------------------------------------------------------------------------------------

@query(f"WITH {FINDINGS} SELECT target, ord, severity, row_number() OVER (PARTITION BY target ORDER BY {FINDING_ORDER})::BIGINT AS place FROM findings")
def sort_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.ranked_findings(inputs.findings(spark, sf_dir)).select("target", "ord", "severity", "place")


@query(f"WITH {FINDINGS} SELECT target, ord, severity, file, line_start, confidence FROM findings QUALIFY row_number() OVER (PARTITION BY target ORDER BY {FINDING_ORDER}) <= 10")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.top_findings(inputs.findings(spark, sf_dir), 10).select("target", "ord", "severity", "file", "line_start", "confidence")


@query(f"""WITH {FINDINGS}, n AS (SELECT * REPLACE (coalesce(crate, '(unknown crate)') AS crate) FROM findings), p AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {FINDING_ORDER}) AS place FROM n),
    g AS (SELECT target, crate, count(*) AS crate_findings, row_number() OVER (PARTITION BY target ORDER BY min(place)) AS group_place FROM p GROUP BY target, crate)
    SELECT target, crate, ord, crate_findings, group_place::INT AS group_place, row_number() OVER (PARTITION BY target, crate ORDER BY {FINDING_ORDER})::BIGINT AS crate_place FROM p JOIN g USING (target, crate)""")
def findings_by_crate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.findings_by_crate(inputs.findings(spark, sf_dir)).select("target", "crate", "ord", "crate_findings", "group_place", "crate_place")


@query(f"WITH {FINDINGS} SELECT target, crate, count(*) AS findings FROM (SELECT target, coalesce(crate, '(unknown crate)') AS crate FROM findings) GROUP BY ROLLUP (target, crate)")
def crate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.crate_totals(inputs.findings(spark, sf_dir))


# --- evaluation ----------------------------------------------------------------------------------------------------

def truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    entries, targets = inputs.entries(spark, sf_dir), inputs.targets(spark, sf_dir)
    matches = evaluation.match_findings(inputs.findings(spark, sf_dir), entries, targets).drop("crate", "cwe", "evidence", "fix_suggestion", "confidence")
    return Tables(spark, "evaluation").save(matches, "matches"), entries, targets


@query(f"WITH {MATCHES} SELECT target, ord, eid AS entry_id, dist AS distance FROM cand")
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluation.match_candidates(inputs.findings(spark, sf_dir), inputs.entries(spark, sf_dir), inputs.targets(spark, sf_dir))
    return c.select("target", "ord", F.col("entry.id").alias("entry_id"), F.abs((F.col("entry.line_start") + F.col("entry.line_end")) / 2 - (F.col("line_start") + F.col("line_end")) / 2).alias("distance"))


@query(f"WITH {MATCHES} SELECT target, ord, matched_id, match_kind, expected_severity FROM matches")
def match_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, targets = inputs.entries(spark, sf_dir), inputs.targets(spark, sf_dir)
    return evaluation.match_findings(inputs.findings(spark, sf_dir), entries, targets).select("target", "ord", "matched_id", "match_kind", "expected_severity")


CROWDED = f"""li AS (SELECT *, (l_partkey * 37 + l_linenumber * 11) % 100000 + 1 AS s FROM lineitem),
    findings AS (SELECT 't1' AS target, 'src/long.rs' AS file, 'Long Rule' AS rule_id, 'low' AS severity, l_orderkey, s AS line_start, s + l_quantity::BIGINT % 7 + CASE WHEN l_suppkey % 50 = 0 THEN 700 ELSE 0 END AS line_end, row_number() OVER () AS ord FROM li),
    entries AS (SELECT 't1' AS target, 'src/long.rs' AS file, p_partkey AS ord, concat('p', p_partkey) AS id, p_partkey * 53 % 100000 + 1 AS line_start, p_partkey * 53 % 100000 + 1 + p_size % 9 + CASE WHEN p_partkey % 97 = 0 THEN 3000 ELSE 0 END AS line_end, 'low' AS severity, p_partkey % 4 <> 0 AS must_detect FROM part),
    targets AS (SELECT DISTINCT concat('t', s_suppkey % 21) AS target FROM supplier WHERE s_suppkey % 21 = 1), named AS (SELECT *, 'long-rule' AS name FROM entries), {MATCHED}"""


@query(f"WITH {CROWDED} SELECT l_orderkey, line_start::INT AS line_start, line_end::INT AS line_end, matched_id, match_kind, count(*) AS findings FROM matches GROUP BY ALL")
def match_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings and all entries in one file under one rule: they meet in bins of lines."""
    matches = evaluation.match_findings(*inputs.crowded(spark, sf_dir))
    return matches.groupBy("l_orderkey", "line_start", "line_end", "matched_id", "match_kind").agg(F.count(F.lit(1)).alias("findings"))


@query(f"WITH {MATCHES} SELECT *, {RATES} FROM summary")
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluate(*truth(spark, sf_dir))


@query(f"""WITH {MATCHES}, pooled AS (SELECT * FROM summary UNION ALL SELECT NULL, sum(must_total), sum(must_hit), sum(bonus_total), sum(bonus_hit), sum(reported_total), sum(true_positives), sum(false_positives) FROM summary)
    SELECT target, must_total::BIGINT AS must_total, must_hit::BIGINT AS must_hit, bonus_total::BIGINT AS bonus_total, bonus_hit::BIGINT AS bonus_hit, reported_total::BIGINT AS reported_total, true_positives::BIGINT AS true_positives, false_positives::BIGINT AS false_positives, {RATES} FROM pooled""")
def evaluate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluate(*truth(spark, sf_dir), pooled=True)


@query(f"WITH {MATCHES} SELECT target, ord, id, file, line_start, line_end, category, severity FROM hit WHERE must_detect AND NOT hit")
def missed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, entries, _ = truth(spark, sf_dir)
    return evaluation.missed_entries(matches, entries).select("target", "ord", "id", "file", "line_start", "line_end", "category", "severity")


@query(f"WITH {MATCHES} SELECT target, ord, file, line_start, line_end, rule_id, severity FROM matches WHERE matched_id IS NULL")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.false_positives(truth(spark, sf_dir)[0]).select("target", "ord", "file", "line_start", "line_end", "rule_id", "severity")


@query(f"""WITH {MATCHES}, o AS (SELECT i - 1 AS p, ({SEVERITY_LIST})[i] AS s FROM range(1, 6) AS t(i)), n AS (SELECT target, expected_severity AS e, severity AS r, count(*) AS k FROM matches WHERE expected_severity IS NOT NULL GROUP BY ALL)
    SELECT t.target, a.p::INT AS "row", b.p::INT AS "column", a.s AS expected, b.s AS reported, coalesce(k, 0)::BIGINT AS findings FROM targets AS t, o AS a, o AS b LEFT JOIN n ON n.target = t.target AND n.e = a.s AND n.r = b.s""")
def severity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, _, targets = truth(spark, sf_dir)
    return evaluation.severity_matrix(matches, targets)


@query(f"""WITH {MATCHES}, o AS (SELECT i - 1 AS p, ({SEVERITY_LIST})[i] AS s FROM range(1, 6) AS t(i))
    SELECT t.target, p::INT AS "row", s AS expected, {', '.join(f"count(m.ord) FILTER (WHERE m.severity = '{s}') AS {s}" for s in SEVERITIES)} FROM targets AS t, o LEFT JOIN matches AS m ON m.target = t.target AND m.expected_severity = s GROUP BY ALL""")
def severity_matrix_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, _, targets = truth(spark, sf_dir)
    return evaluation.severity_matrix_wide(evaluation.severity_matrix(matches, targets))


@query(f"WITH {MATCHES}, r AS (SELECT target, {RATES} FROM summary) SELECT target, concat_ws('; ', CASE WHEN recall < 0.9 THEN 'recall' END, CASE WHEN precision < 0.2 THEN 'precision' END) AS failures, recall >= 0.9 AND precision >= 0.2 AS passed FROM r")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evaluation.gate(evaluation.evaluate(*truth(spark, sf_dir)), 0.9, 0.2)
    return g.select("target", F.array_join(F.transform("failures", lambda f: F.split(f, " ")[0]), "; ").alias("failures"), "passed")


MATRIX = f"""o AS (SELECT i - 1 AS p, ({SEVERITY_LIST})[i] AS s FROM range(1, 6) AS t(i)), n AS (SELECT target, expected_severity AS e, severity AS r, count(*) AS k FROM matches WHERE expected_severity IS NOT NULL GROUP BY ALL),
    cells AS (SELECT t.target, a.p AS r, b.p AS c, a.s AS expected, b.s AS reported, coalesce(k, 0) AS k FROM targets AS t, o AS a, o AS b LEFT JOIN n ON n.target = t.target AND n.e = a.s AND n.r = b.s)"""


@query(f"""WITH {MATCHES}, {MATRIX}, rates AS (SELECT *, {RATES} FROM summary),
    mi AS (SELECT target, ceil(place / 500)::INT AS page, string_agg(js, ',' ORDER BY place) AS m FROM (SELECT target, row_number() OVER (PARTITION BY target ORDER BY ord, id) AS place, concat('{{"id":"', id, '","file":"', file, '","line_start":', line_start, ',"line_end":', line_end, ',"category":"', category, '","severity":"', severity, '"}}') AS js FROM hit WHERE must_detect AND NOT hit) GROUP BY ALL),
    wr AS (SELECT target, ceil(place / 500)::INT AS page, string_agg(js, ',' ORDER BY place) AS w FROM (SELECT target, row_number() OVER (PARTITION BY target ORDER BY ord) AS place, concat('{{"file":"', file, '","line_start":', line_start, ',"line_end":', line_end, ',"rule_id":"', rule_id, '","severity":"', severity, '","summary":"', summary, '"}}') AS js FROM matches WHERE matched_id IS NULL) GROUP BY ALL),
    pg AS (SELECT *, max(page) OVER (PARTITION BY target) AS pages FROM mi FULL JOIN wr USING (target, page)),
    rw AS (SELECT target, r, concat('[', string_agg(k::VARCHAR, ',' ORDER BY c), ']') AS js FROM cells GROUP BY ALL), mx AS (SELECT target, string_agg(js, ',' ORDER BY r) AS x FROM rw GROUP BY ALL)
    SELECT target, coalesce(page, 1)::INT AS page, concat('{{"target":"', target, '","page":', coalesce(page, 1), ',"pages":', coalesce(pages, 1), ',"recall":', recall, ',"precision":', precision, ',"must":{{"total":', must_total, ',"hit":', must_hit, ',"missed":[', m, ']}},"bonus":{{"total":', bonus_total, ',"hit":', bonus_hit,
        '}},"reported":{{"total":', reported_total, ',"true_positives":', true_positives, ',"false_positives":[', w, ']}},"severity_confusion":[', x, ']}}') AS report FROM rates LEFT JOIN pg USING (target) LEFT JOIN mx USING (target)""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, entries, targets = truth(spark, sf_dir)
    return evaluation.eval_report(evaluation.evaluate(matches, entries, targets), matches, entries, targets)


def shares(x: str) -> str:
    return f"printf('%.1f%%', round({x} * 100, 1))"


@query(f"""WITH {MATCHES}, {MATRIX}, rates AS (SELECT *, {RATES} FROM summary),
    mi AS (SELECT target, row_number() OVER (PARTITION BY target ORDER BY ord, id) AS place, concat_ws(' | ', id, concat(file, ' ', line_start, ' to ', line_end), category, severity) AS line FROM hit WHERE must_detect AND NOT hit),
    wr AS (SELECT target, row_number() OVER (PARTITION BY target ORDER BY ord) AS place, concat_ws(' | ', concat(file, ' ', line_start, ' to ', line_end), rule_id, severity) AS line FROM matches WHERE matched_id IS NULL)
    SELECT target, 0 AS section, 0::BIGINT AS place, concat('Results for ', target) AS line FROM rates UNION ALL SELECT target, 0, 1, concat('recall: ', must_hit, ' of ', must_total, ', ', {shares('recall')}) FROM rates UNION ALL SELECT target, 0, 2, concat('precision: ', true_positives, ' of ', reported_total, ', ', {shares('precision')}) FROM rates
    UNION ALL SELECT target, 0, 3, concat('extra entries found: ', bonus_hit, ' of ', bonus_total) FROM rates WHERE bonus_total > 0 UNION ALL SELECT target, 1, 0, concat('not found: ', count(*)) FROM mi GROUP BY target UNION ALL SELECT target, 1, place, line FROM mi
    UNION ALL SELECT target, 2, 0, concat('reported without cause: ', count(*)) FROM wr GROUP BY target UNION ALL SELECT target, 2, place, line FROM wr
    UNION ALL SELECT target, 3, r + 1, concat(expected, ' reported as: ', string_agg(concat(reported, ' ', k), ', ' ORDER BY c)) FROM cells WHERE target IN (SELECT target FROM cells WHERE k > 0) GROUP BY target, r, expected""")
def eval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, entries, targets = truth(spark, sf_dir)
    return evaluation.eval_text(evaluation.evaluate(matches, entries, targets), matches, entries, targets)


@query(f"WITH {MATCHES}, r AS (SELECT *, {RATES} FROM summary) SELECT target, must_hit, true_positives, false_positives, recall, precision, recall >= 0.9 AND precision >= 0.2 AS passed FROM r")
def evaluate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of a scan, read back and scored."""
    texts = scan_report(spark, sf_dir).select(F.col("target").alias("report"), "page", F.col("report").alias("text"))
    done = jobs.evaluate_reports(texts, inputs.entries(spark, sf_dir), inputs.targets(spark, sf_dir), Tables(spark, "evaluation"), 0.9, 0.2)
    return done.summary.join(done.gates, "target").select("target", "must_hit", "true_positives", "false_positives", "recall", "precision", "passed")


@query(f"WITH {ENTRIES} SELECT target, (row_number() OVER (PARTITION BY target ORDER BY ord) - 1)::INT AS ord, id, file, line_start, line_end, category, severity, must_detect, alias, 5::INT AS line_slack FROM entries")
def read_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth, written as one YAML file for each target and read back."""
    e = inputs.entries(spark, sf_dir)
    fields = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("id", "file", "line_start", "line_end", "category", "severity", "must_detect")]
    item = F.concat(F.lit("  - {"), F.concat_ws(", ", *fields, F.concat(F.lit("aliases: ["), F.array_join("aliases", ", "), F.lit("]"))), F.lit("}"))
    head = F.concat(F.lit("target: "), "target", F.lit(f"\nschema_version: 1\nmatch_policy:\n  line_slack: 5\n  severity_order: [{', '.join(SEVERITIES)}]\nfindings:\n"))
    files = e.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))).alias("all")).select("target", F.concat(head, F.array_join("all.item", "\n")).alias("value"))
    path = Tables(spark, "truth").path("yaml")
    files.write.partitionBy("target").text(path)
    targets, entries = readers.read_ground_truth(spark, path)
    return entries.join(targets.select("target", "line_slack"), "target").select("target", "ord", "id", "file", "line_start", "line_end", "category", "severity", "must_detect", F.regexp_replace(F.array_join("aliases", ","), "_", "-").alias("alias"), "line_slack")


@query("""WITH e AS (SELECT concat('t', p_partkey % 20) AS target, concat('p', p_partkey // 2) AS id, p_size - p_partkey % 3 AS line_start, p_size AS line_end, CASE WHEN p_partkey % 5 = 0 THEN 'bad' ELSE 'low' END AS severity FROM part)
    SELECT target, id, 'line_start is not positive' AS problem FROM e WHERE line_start < 1 UNION ALL SELECT target, id, 'unknown severity' FROM e WHERE severity = 'bad'
    UNION ALL SELECT target, id, 'id is not unique' FROM e GROUP BY target, id HAVING count(*) > 1""")
def validate_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    bad = table(spark, sf_dir, "part").select(F.concat(F.lit("t"), (key % 20).cast("string")).alias("target"), F.concat(F.lit("p"), F.floor(key / 2).cast("string")).alias("id"), F.lit("f").alias("file"), F.lit("c").alias("category"), (F.col("p_size") - key % 3).alias("line_start"), F.col("p_size").alias("line_end"), F.when(key % 5 == 0, "bad").otherwise("low").alias("severity"), F.lit(True).alias("must_detect"))
    return evaluation.validate_ground_truth(inputs.targets(spark, sf_dir), bad)


RUNS = f"""{FINDINGS}, m AS (SELECT DISTINCT target, ord % 3 AS run, file, regexp_replace(lower(rule_id), '[\\s_-]+', '-', 'g') AS name, line_start, line_end FROM findings), sizes AS (SELECT target, run, count(*) AS n FROM m GROUP BY ALL),
    pairs AS (SELECT a.target, a.run AS x, b.run AS y, a.n AS na, b.n AS nb, (SELECT count(*) FROM m AS u JOIN m AS v ON u.target = v.target AND u.file = v.file AND u.name = v.name AND u.line_start = v.line_start AND u.line_end = v.line_end WHERE u.target = a.target AND u.run = a.run AND v.run = b.run) AS k FROM sizes AS a JOIN sizes AS b ON a.target = b.target AND a.run < b.run)"""


@query(f"WITH {RUNS} SELECT target, count(*) AS pairs, round(avg(k / (na + nb - k)), 9) AS jaccard FROM pairs GROUP BY target")
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = inputs.findings(spark, sf_dir).withColumn("run", F.col("ord") % 3)
    return evaluation.stability(runs).withColumn("jaccard", F.round("jaccard", 9))


@query(f"WITH {MATCHES}, b AS (SELECT DISTINCT target, matched_id AS id, ord % 2 AS side FROM matches WHERE matched_id IS NOT NULL) SELECT target, id, x AS found_before, y AS found_after, x AND NOT y AS fixed FROM (SELECT target, id, EXISTS (SELECT 1 FROM b WHERE b.target = e.target AND b.id = e.id AND side = 0) AS x, EXISTS (SELECT 1 FROM b WHERE b.target = e.target AND b.id = e.id AND side = 1) AS y FROM entries AS e)")
def patched_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, entries, _ = truth(spark, sf_dir)
    return evaluation.patched_control(matches.filter("ord % 2 = 0"), matches.filter("ord % 2 = 1"), entries).select("target", "id", "found_before", "found_after", "fixed")


# --- reports -------------------------------------------------------------------------------------------------------

HTML_ROW = """concat('<tr><td class="', severity, '">', severity, '</td><td>', rule_id, CASE WHEN cwe IS NULL THEN '' ELSE '<br><small>' || cwe || '</small>' END, '</td><td>', CASE WHEN crate IS NULL THEN '' ELSE crate || ' · ' END, file, ':', CASE WHEN line_end <> line_start THEN concat(line_start, '-', line_end) ELSE line_start::VARCHAR END,
    '</td><td>', replace(replace(replace(summary, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '<details><pre>', evidence, '</pre><p>', fix_suggestion, '</p></details></td><td>', printf('%.2f', confidence), '</td></tr>')"""


@query(f"WITH {FINDINGS} SELECT target, ord, md5({HTML_ROW}) AS row_md5 FROM findings")
def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.html_rows(inputs.findings(spark, sf_dir)).select("target", "ord", F.md5(F.encode("row", "UTF-8")).alias("row_md5"))


PAGED = f"""{FINDINGS}, {TARGETS}, placed AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {FINDING_ORDER}) AS place, count(*) OVER (PARTITION BY target) AS total FROM findings)"""
JSON_ROW = """concat('{"rule_id":"', rule_id, '","severity":"', severity, '"', ',"cwe":"' || cwe || '"', ',"crate":"' || crate || '"', ',"file":"', file, '","line_start":', line_start, ',"line_end":', line_end, ',"summary":"', summary, '","evidence":"', evidence, '","fix_suggestion":"', fix_suggestion, '","confidence":', confidence, '}')"""
PAGES = f"""{PAGED}, pg AS (SELECT target, ceil(place / 500)::INT AS page, ceil(any_value(total) / 500)::INT AS pages, any_value(total) AS n, string_agg({JSON_ROW}, ',' ORDER BY place) AS js FROM placed GROUP BY target, ceil(place / 500))"""


HTML_PAGES = f"""WITH {PAGED}, pg AS (SELECT target, ceil(place / 500)::INT AS page, ceil(any_value(total) / 500)::INT AS pages, any_value(total) AS n, string_agg({HTML_ROW}, chr(10) ORDER BY place) AS body FROM placed GROUP BY target, ceil(place / 500))
    SELECT target, coalesce(page, 1)::INT AS page, concat('<!DOCTYPE html>', chr(10), '<html lang="en"><head><meta charset="utf-8"><title>Scan of ', target, '</title><style>{writers.CSS}</style></head><body>', chr(10), '<h1>Scan of ', target, '</h1>', chr(10), '<dl><dt>Project</dt><dd>', target, '</dd></dl>', chr(10), '<h2>', coalesce(n, 0), ' finding(s)</h2>', chr(10),
        CASE WHEN pages > 1 THEN concat('<p>Page ', page, ' of ', pages, '</p>', chr(10)) ELSE '' END, CASE WHEN n > 0 THEN concat('<table><tr><th>Severity</th><th>Rule</th><th>Place</th><th>Summary</th><th>Confidence</th></tr>', chr(10), body, chr(10), '</table>') ELSE '<p>No findings.</p>' END, chr(10), '</body></html>', chr(10)) AS html
    FROM targets LEFT JOIN pg USING (target)"""


@query(HTML_PAGES)
def html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of each target, in numbered pages."""
    info = F.array(F.struct(F.lit("Project").alias("name"), F.col("target").alias("value")))
    runs = inputs.targets(spark, sf_dir).select("target", F.concat(F.lit("Scan of "), "target").alias("title"), info.alias("info"))
    return writers.html_report(runs, inputs.findings(spark, sf_dir))


@query(f"SELECT concat(target, '-prov-m', CASE WHEN page = 1 THEN '' ELSE '.' || page END, '.html') AS name, md5(html) AS html_md5 FROM ({HTML_PAGES})")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of all reports, written as files of their own names and read back."""
    folder = Tables(spark, "reports").path("pages")
    writers.write_reports(html_report(spark, sf_dir).withColumn("name", writers.report_name(F.col("target"), F.lit("prov"), F.lit("m"))), folder)
    return readers.below(spark, folder, "*.html").select(F.col("inside").alias("name"), F.md5(F.encode("content", "UTF-8")).alias("html_md5"))


@query(f"""WITH {PAGES} SELECT target, page, concat('{{"findings":[', js, '],"generated_at":"2024-01-02T03:04:05.000Z","findings_total":', n, ',"page":', page, ',"pages":', pages, '}}') AS json FROM pg""")
def findings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.findings_json(inputs.findings(spark, sf_dir), F.lit("2024-01-02 03:04:05").cast("timestamp"))


@query(f"""WITH {PAGES}, st AS ({RUN_STATS}), runs AS (SELECT target, coalesce(input_tokens, 0) AS i, coalesce(output_tokens, 0) AS o, coalesce(analyze_calls, 0) AS a, coalesce(judge_calls, 0) AS j FROM targets FULL JOIN st USING (target))
    SELECT target, coalesce(page, 1)::INT AS page, concat('{{"scan":{{"started_at":"2024-01-01T00:00:00.000Z","finished_at":"2024-01-01T00:00:05.000Z","duration_ms":5000}},"project":{{"name":"', target, '"}},"model":{{"model":"m"}},"config":{{"unit":"file"}},"tokens":{{"input":', i, ',"output":', o, ',"total":', i + o, ',"analyze_calls":', a, ',"judge_calls":', j, '}},"findings_total":', coalesce(n, 0), ',"page":', coalesce(page, 1), ',"pages":', coalesce(pages, 1), ',"findings":[', js, ']}}') AS report
    FROM runs LEFT JOIN pg USING (target)""")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of each target, in numbered pages; targets that run_stats lacks made no calls."""
    started = F.lit("2024-01-01 00:00:00").cast("timestamp")
    runs = inputs.targets(spark, sf_dir).select("target").join(run_stats(spark, sf_dir), "target", "full").select(
        "target", started.alias("started_at"), (started + F.expr("interval 5 seconds")).alias("finished_at"), F.struct(F.col("target").alias("name")).alias("project"), F.struct(F.lit("m").alias("model")).alias("model"), F.struct(F.lit("file").alias("unit")).alias("config"),
        *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("input_tokens", "output_tokens", "analyze_calls", "judge_calls")),
    )
    return writers.scan_report(runs, inputs.findings(spark, sf_dir))


@query(f"WITH {PAGED} SELECT target, place, rule_id, severity, cwe, crate, file, line_start, line_end, summary, evidence, fix_suggestion, confidence FROM placed")
def read_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of the paged JSON reports, read back."""
    texts = findings_json(spark, sf_dir).select(F.col("target").alias("report"), "page", F.col("json").alias("text"))
    found, _ = readers.reports_from(texts)
    place = (F.shiftright("ord", 32) - 1) * ordering.PAGE + F.col("ord").bitwiseAND(F.lit((1 << 32) - 1)) + 1
    return found.select(F.col("report").alias("target"), place.alias("place"), *writers.FIELDS)


@query("""SELECT page_id, concat(CASE WHEN p = '' THEN 'scan' ELSE p END, '-prov-m.1.html') AS name, CASE WHEN lower(url) LIKE '%.json' THEN 'json' ELSE 'html' END AS format FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '[/\\\\:*?"<>|\\s\\x00-\\x1F]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS p FROM pages)""")
def report_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", writers.report_name(F.col("url"), F.lit("prov"), F.lit("..m.1 ")).alias("name"), writers.report_format(F.col("url")).alias("format"))


@query("SELECT page_id, CASE WHEN html = '' THEN 0 ELSE len(string_split(html, chr(10))) - ends_with(html, chr(10))::INT END::BIGINT AS lines, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')) AS escaped_md5 FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", count_lines(F.col("html")).cast("bigint").alias("lines"), F.md5(F.encode(writers.escape_html(F.col("html")), "UTF-8")).alias("escaped_md5"))
