"""The queries that __spark_entry__.py registers for this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, conversation_repair, decontaminate, exact_dedup, html_extract, line_dedup, quality, resample, sharding, suffix_dedup, token_orc, trie_join
from .common import documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark, documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), near=True)


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(spark, rows.unionByName(spark.createDataFrame(probe, "conv_id bigint, turn bigint, role string, text string")))


def op4_trie_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.jaccard_components(spark, documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), [1.0] * 8)


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_files(spark, documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=2)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(spark, documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(spark, documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(spark, conversation_repair.damage(rows), rows)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark, table(spark, sf_dir, "pages"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(spark, documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def crc_step() -> str:
    """DuckDB expression: CRC-32 c after byte b."""

    def part(k: int) -> int:
        c = 1 << k
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        return c

    step = "(c >> 8)"
    for k in range(8):
        step = f"xor({step}, ((xor(c, b) >> {k}) & 1) * {part(k)})"
    return step


def way(value: str, cost: str, initial: str) -> str:
    """DuckDB expression: a text of cost and edits with one more edit in front."""
    return f"lpad((({value})[1:10]::BIGINT + {cost})::VARCHAR, 10, '0') || '{initial}' || ({value})[11:]"


def repair_layer() -> str:
    """DuckDB expression: values of the role states 0 to 3 before row x, from those after it in acc."""
    base = []
    for q, steps in enumerate(((("s", 1), ("u", 2)), (("u", 2),), (("a", 3),), (("u", 2),))):
        v = [f"acc.v[{k + 1}]" for k in range(4)]
        ways = [way(v[q], "3", "D"), *(f"CASE WHEN NOT x.m AND x.c = '{c}' THEN {way(v[to], 'x.t', 'K')} END" for c, to in steps), *(f"CASE WHEN NOT x.m THEN {way(v[to], 'x.t + 2', 'R')} END" for c, to in steps if c != "s")]
        base.append(f"list_min([{', '.join(ways)}])")
    third = f"list_transform([[{', '.join(base)}]], lambda b: [b[1], b[2], least(b[3], {way('b[4]', '2', 'I')}), least(b[4], {way('b[3]', '2', 'I')})])[1]"
    return f"list_transform([{third}], lambda b: [least(b[1], {way('b[3]', '2', 'I')}), least(b[2], {way('b[3]', '2', 'I')}), b[3], b[4]])[1]"


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_decontamination, op3_chat_tree, op4_trie_jaccard, op5_sharding, op6_token_orc, op7_bpe, op8_line_dedup, op9_quality, op10_suffix_dedup, op11_conversation_repair, op12_html_extraction, op13_resampling)}

SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT norm, count(*) AS n, arg_max(doc_id, (chars, -doc_id)) AS keep_id FROM d GROUP BY norm)
        SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)""",
    "op2_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS phrase, least(len(w), 10) AS n FROM b, range(1, greatest(len(w) - 9, 1) + 1) AS t(s) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM win),
        pos AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM d, sizes, range(1, len(w) - n + 2) AS t(s)),
        m AS (SELECT doc_id, item_id, s, n FROM pos JOIN win USING (phrase, n)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id),
        bw AS (SELECT item_id, o, w[o + 1] AS t, len(w) AS n FROM b, range(len(w)) AS x(o)),
        pw AS (SELECT * FROM (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d) WHERE t IN (SELECT t FROM bw)),
        fr AS (SELECT t, count(*) AS f FROM pw GROUP BY t),
        rare AS (SELECT item_id, s, o FROM bw JOIN fr USING (t), range(greatest(n - 9, 1)) AS y(s) WHERE o BETWEEN s AND s + 9 QUALIFY row_number() OVER (PARTITION BY item_id, s ORDER BY f, o) <= 2),
        sets AS (SELECT DISTINCT item_id, min(o) AS lo, max(o) AS hi FROM rare GROUP BY item_id, s),
        terms AS (SELECT DISTINCT item_id, lo, hi, t FROM sets JOIN bw USING (item_id) WHERE o BETWEEN hi - 9 AND lo + 9),
        need AS (SELECT item_id, lo, hi, least(count(*), 8) AS need FROM terms GROUP BY ALL),
        pl AS (SELECT DISTINCT a.doc_id, item_id, lo, hi, a.p AS near FROM sets JOIN bw AS x USING (item_id) JOIN bw AS y USING (item_id) JOIN pw AS a ON a.t = x.t JOIN pw AS b ON b.doc_id = a.doc_id AND b.t = y.t WHERE x.o = lo AND y.o = hi AND b.p BETWEEN a.p - 15 AND a.p + 15),
        nm AS (SELECT pl.doc_id, item_id FROM pl JOIN terms USING (item_id, lo, hi) JOIN need USING (item_id, lo, hi) JOIN pw AS c ON c.doc_id = pl.doc_id AND c.t = terms.t WHERE c.p BETWEEN near - 15 AND near + 15 GROUP BY pl.doc_id, item_id, lo, hi, near, need HAVING count(DISTINCT c.t) >= need),
        close AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nm GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN close USING (doc_id)""",
    "op3_chat_tree": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        f AS (SELECT *, regexp_extract_all(text, '<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<<ROLE>>|<</ROLE>>|<<TURN>>|<</TURN>>') AS marks FROM c)
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length(replace(text, '\', '\\')) + len(marks) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 ELSE 7 END)::BIGINT AS formatted_chars
        FROM f GROUP BY conv_id""",
    "op4_trie_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, range(1, greatest(len(w) - 4, 1) + 1) AS t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n AS u ON u.doc_id = x JOIN n AS v ON v.doc_id = y WHERE 100 * k >= 75 * (u.n + v.n - k)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS z FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.z),
        c AS (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS whole FROM s GROUP BY doc_id),
        m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM c)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(z) FROM r WHERE r.doc_id = d.doc_id) AS component_id, coalesce(m.class_id, d.doc_id) AS class_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op8_line_dedup": r"""
        WITH l AS (SELECT doc_id, i, lines[i] AS line, translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
                   FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), range(1, len(lines) + 1) AS t(i)),
        r AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        f AS (SELECT doc_id, i, line, coalesce(keeper <> doc_id, false) AS gone FROM l LEFT JOIN r USING (k))
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id""",
    "op5_sharding": f"""
        WITH h AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, unnest(list_transform(range(0, len(h) // 2, 500), lambda o: {{'o': o, 'x': substr(h, 2 * o + 1, 1000)}}), recursive := true) FROM h),
        y AS (SELECT doc_id, o, list_transform(range(len(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT) AS v FROM p),
        z AS (SELECT doc_id, flatten(list(v ORDER BY o)) AS v FROM y GROUP BY doc_id),
        c AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, coalesce(v, [])), lambda c, b: {crc_step()}), 4294967295)::BIGINT AS text_crc32 FROM h LEFT JOIN z USING (doc_id)),
        s AS (SELECT doc_id, i, ('0x' || md5(concat('shard-', i, ':', doc_id))[1:13])::BIGINT AS u FROM documents, range(9) AS t(i)),
        a AS (SELECT doc_id, arg_max(i, (u, -i)) FILTER (WHERE i < 8) AS shard, arg_max(i, (u, -i)) AS grown_shard FROM s GROUP BY doc_id)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || md5(concat('slot:', doc_id))[1:13])::BIGINT % 256, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard FROM c JOIN a USING (doc_id)""",
    "op10_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, unnest(list_transform(range(0, len(h) // 2, 500), lambda o: {'o': o, 'x': substr(h, 2 * o + 1, 1098)}), recursive := true) FROM d),
        w AS (SELECT doc_id, o + j AS i, s FROM (SELECT doc_id, o, unnest(list_transform(range(len(x) // 2 - 49), lambda j: {'j': j, 's': hash(substr(x, 2 * j + 1, 100))}), recursive := true) FROM p)),
        f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
        hit AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (s) WHERE first_id < doc_id),
        run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit) GROUP BY doc_id, r),
        gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM run),
        cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last_b, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE k || substr(h, 2 * last_b + 1) END)) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)""",
    "op11_conversation_repair": rf"""
        WITH o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS key FROM conversations),
        k AS (SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(key)), lambda j: ascii(key[j + 1])::BIGINT)), lambda c, b: {crc_step()}), 4294967295)::BIGINT % 20 AS k FROM (SELECT DISTINCT key FROM o)),
        r AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o JOIN k USING (key) WHERE k <> 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS t FROM r),
        f AS (SELECT *, left(role, 1) AS c, t = '' AS blank, t <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, NOT t ~ '(?s).*[.!?]' AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM p),
        n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE NOT blank AND NOT dup AND cut) AS truncated, count(*) FILTER (WHERE prev IS NOT NULL AND prev || c NOT IN ('su', 'ua', 'au')) AS illegal,
              list({{'c': c, 'm': blank OR dup, 't': cut::INT, 'v': ['0000000000', '0000000004II', '0000000002I', '0000000000']}} ORDER BY i DESC) AS items FROM f GROUP BY conv_id),
        b AS (SELECT * EXCLUDE (items), list_reduce(list_prepend({{'c': '', 'm': false, 't': 0, 'v': ['0000000000', '0000000004II', '0000000002I', '0000000000']}}, items), lambda acc, x: {{'c': '', 'm': false, 't': 0, 'v': {repair_layer()}}}).v[1] AS best FROM n),
        e AS (SELECT conv_id, j, best[10 + j] AS e FROM b, range(1, length(best) - 9) AS x(j)),
        g AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i FROM e),
        h AS (SELECT g.conv_id, j, e, role, text, row_number() OVER (PARTITION BY g.conv_id ORDER BY j) AS out, first_value(e || coalesce(left(role, 1), '')) OVER (PARTITION BY g.conv_id ORDER BY j) = 'Ks' AS headed FROM g LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.i = g.i AND e <> 'I' WHERE e <> 'D'),
        z AS (SELECT conv_id, string_agg(concat(CASE WHEN e = 'K' THEN role WHEN (out - headed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', text), chr(10) ORDER BY j) AS fixed FROM h GROUP BY conv_id)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best[1:10]::BIGINT, 0) AS cost, coalesce(best[11:], '') AS audit, sha256(coalesce(fixed, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM i.conv_id""",
    "op13_resampling": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS g FROM benchmark),
        g AS (SELECT doc_id, unnest(w) AS g FROM d), u AS (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM g UNION SELECT g FROM b)),
        c AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)), lambda c, b: {crc_step()}), 4294967295)::BIGINT % 10000 AS k FROM u),
        s AS (SELECT k, count(*) AS n FROM g JOIN c USING (g) GROUP BY k), t AS (SELECT k, count(*) AS n FROM b JOIN c USING (g) GROUP BY k), z AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
        e AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (z.s + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (z.t + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (k), z),
        w AS (SELECT doc_id, sum(gain) AS weight FROM g JOIN c USING (g) JOIN e USING (k) GROUP BY doc_id),
        r AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256(concat('2024:', doc_id))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
        p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS most FROM r WHERE n_features >= 20)
        SELECT r.*, CASE WHEN place <= most THEN place END::BIGINT AS rank FROM r LEFT JOIN p USING (doc_id)""",
}
