"""Conversation repair, HTML extraction and importance resampling against brute force written plainly here."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codesieve.llm import conversation_repair as cr
from codesieve.llm import html_extract, resample

CONV = "conv_id bigint, turn bigint, role string, text string, digest string, copies int, part int, first string, whole int"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# op11 ----------------------------------------------------------------------------------------------------------------

WELL = re.compile(r"(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def ordered(rows):
    """A conversation's (turn, role, text) in order, with each row's fault."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    seen, out = set(), []
    for t, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((t, role, text, kind))
    return out


def every_repair(rows):
    """All edits of a few rows, with up to two insertions in each gap: the cheapest, then the least string."""
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    ways = [[("D", None)] if k in ("blank", "duplicate") else [("K", None), ("R", "u"), ("R", "a"), ("D", None)] for *_, k in rows]
    best = None
    for edits in itertools.product(*ways):
        for extra in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for i in range(len(rows) + 1):
                for s in extra[i]:
                    cost, audit = cost + 2, audit + "I"
                    turns.append((NAMES[s], ""))
                if i < len(rows):
                    _, role, text, kind = rows[i]
                    edit, s = edits[i]
                    cost += {"K": 0, "R": 2, "D": 3}[edit] + (kind == "truncated" and edit != "D")
                    audit += edit
                    if edit != "D":
                        turns.append((NAMES[s] if s else role, text))
            if WELL.fullmatch("".join(r[:1] or "?" for r, _ in turns)):
                best = min(best or (cost, audit, turns), (cost, audit, turns))
    return best


def least_repair(rows):
    """The same for many rows, from the last to the first, with whole strings."""
    arcs = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(after):
        for _ in range(4):
            for q, ways in arcs.items():
                for s, to in ways.items():
                    if s != "s" and to in after:
                        cost, audit, turns = after[to]
                        way = (cost + 2, "I" + audit, [(NAMES[s], ""), *turns])
                        after[q] = min(after.get(q, way), way, key=lambda w: w[:2])
        return after

    after = inserted({0: (0, "", []), 3: (0, "", [])})
    for _, role, text, kind in reversed(rows):
        now = {}
        for q, ways in arcs.items():
            found = [(after[q][0] + 3, "D" + after[q][1], after[q][2])] if q in after else []
            if kind not in ("blank", "duplicate"):
                extra = kind == "truncated"
                for s, to in ways.items():
                    if to in after:
                        cost, audit, turns = after[to]
                        if s == role[:1]:
                            found.append((cost + extra, "K" + audit, [(role, text), *turns]))
                        if s != "s":
                            found.append((cost + 2 + extra, "R" + audit, [(NAMES[s], text), *turns]))
            if found:
                now[q] = min(found, key=lambda w: w[:2])
        after = inserted(now)
    return after[0]


def expected(ids, rows):
    out = {}
    for conv in set(ids):
        own = ordered([r[1:4] for r in rows if r[0] == conv])
        cost, audit, turns = least_repair(own)
        known = [t for t, *_ in own if t is not None]
        kinds = Counter(k for *_, k in own)
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in turns)))
    return out


def reported(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def some_rows(rng, n, roles=("system", "user", "assistant", "user", "assistant", "tool", None)):
    texts = ["Yes.", "No!", "open", "", " \n", None, "Why?", "Same.", "a\x85"]
    return [(rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_plain_search_is_exhaustive():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 3, 3):
        rows = ordered(some_rows(rng, n))
        assert least_repair(rows) == every_repair(rows)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_repair(spark, size):
    rng = random.Random(size)
    rows = [(c, *r) for c in [None, *range(40)] for r in some_rows(rng, rng.choice([0, 1, 2, 3, 5, 9]))]
    rows += [(77, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Row {t}.", f"row {t}"])) for t in range(400)]  # one long conversation
    rows += [(78, 1, "user", "Again.")] * 300  # one row many times
    ids = [r[0] for r in rows] + [999]
    df = spark.createDataFrame([(*r, "d", 1, 2, "f", 3) for r in rows], CONV).repartition(5)
    got = reported(cr.repair_report(spark, df, spark.createDataFrame([(i,) for i in ids], "conv_id bigint"), size=size))
    assert got == expected(ids, rows)
    assert got[999] == (0, 0, 0, 0, 0, 0, "", sha(""))


def test_repaired_turns_are_well_formed(spark):
    rows = [(c, *r) for c in range(30) for r in some_rows(random.Random(c), 6)]
    df = spark.createDataFrame([(*r, "d", 1, 2, "f", 3) for r in rows], CONV)
    turns = {}
    for r in sorted(cr.repair(spark, df, size=2).collect(), key=lambda r: (r.conv_id, r.part, r.seg)):
        turns.setdefault(r.conv_id, []).extend(r.turns)
    for own in turns.values():
        assert WELL.fullmatch("".join(t.role[:1] for t in own))
        assert all(t.text == "" for t in own if t.edit == "I") and all(t.edit in "IKR" for t in own)


def test_another_grammar(spark):
    """Roles q and r in turn, no insertions allowed for r."""
    roles = cr.Roles(0, frozenset({0}), {0: {"q": 1}, 1: {"r": 0}}, {"q": "query"})
    df = spark.createDataFrame([(1, 0, "reply", "A.", "", 1, 1, "", 1), (1, 1, "query", "B.", "", 1, 1, "", 1), (1, 2, "x", "C.", "", 1, 1, "", 1)], CONV)
    r = cr.repair_report(spark, df, df, roles).first()
    assert (r.cost, r.audit) == (8, "IKDD")


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(60) for t in range(3)] + [(None, None, None, None)]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in cr.damage(spark.createDataFrame([(*r, "d", 1, 2, "f", 3) for r in rows], CONV)).collect())
    want = Counter()
    for c, t, role, text in rows:
        key, role, text = f"{' ' if c is None else c}:{' ' if t is None else t}", " " if role is None else role, " " if text is None else text
        k = zlib.crc32(key.encode()) % 20
        if k:
            want[(c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] += 2 if k == 3 else 1
    assert got == want


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], CONV)
    assert cr.repair_report(spark, none, none).count() == 0


# op12 ----------------------------------------------------------------------------------------------------------------

LONG = "It goes on for a while, with commas, and ends here. " * 5
CASES = [
    (None, ""),
    ("", ""),
    ("no tags,  at\nall", "no tags, at all"),
    ("<p>a<b>b</b>c&amp;d &#233;&eacute &lt;i&gt;</p><p>x<br>y</p>", "abc&d éé <i> x y"),
    ("<p>a<script>var x = '</p>';</script>b<!-- c > -->c<style>p{}</style></p>", "abc"),
    ("<p>1 < 2, 3<4 and <", "1 < 2, 3<4 and <"),
    ("<p>cut off <a href='x", "cut off"),
    ("<title>T</title><body><nav><a href=/>Home</a></nav><div class=ad>Buy</div><article><h1>H</h1><p><b>one<br><p>two</article><footer>&copy; me</footer>", "H one two"),
    (f"<header>Site</header><div id=cookie-notice><p>{LONG}</p></div><div id=content><h1>H</h1><p>{LONG}</p><aside>{LONG}</aside><form><p>{LONG}</p></form><p>Short.</p></div><div class='post-comments'><p>{LONG}</p></div>", f"H {LONG.strip()} Short."),
    (f"<article><header><p>By me</p><h1>H</h1></header><p>x</p><section class=comments><article class=comment><p>{LONG}</p></article></section><footer>f</footer></article>", "H x"),
    (f"<div><ul><li><a href=a>One, two, three</a><li><a href=b>Four, five, six</a></ul></div><div><p>{LONG}</p><p>End</p></div>", f"{LONG.strip()} End"),
    (f"<body class='has-sidebar'><div class=sidebar-left><main><p>{LONG}</p></main><p>side</p></div>", LONG.strip()),
    ("<table><tr><td>a<td>b</table>", "a b"),
    ("<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><div role=navigation>no</div><p>yes</p>", "yes"),
    ("<b><p>foo</b>bar</p>", "foobar"),
    ("<textarea>no</textarea><select><option>no</select><p>y</p><iframe>no</iframe><noscript>no</noscript>", "y"),
]


def test_pages(spark):
    rows = [(k, f"http://h/{k}", page, "clash") for k, (page, _) in enumerate(CASES)] * 2 + [(None, None, "<p>z", "clash")]
    got = Counter(tuple(r) for r in html_extract.extract(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect())
    want = Counter((k, f"http://h/{k}", text, len(text)) for k, (_, text) in enumerate(CASES) for _ in range(2))
    want[(None, None, "z", 1)] += 1
    assert got == want


def test_whole_table_of_pages(spark):
    """On the given pages the article element holds the main text: its text, by a plain look for its tags."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(spark, pages).collect()}
    rows = pages.collect()
    assert set(got) == {r.page_id for r in rows}
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.DOTALL)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())


def test_strange_pages_end(spark):
    for part in ("<div>", "<p><b>", "<a><!--", "<p a='", '<p a="', "<li>", "<script>", "</p>", "<tr><td>", "<", "&amp", "<article>"):
        html_extract.main_text(part * 20_000 + "x")
    assert html_extract.main_text("<div>" * 5000 + LONG + "</div>" * 5000) == LONG.strip()
    assert html_extract.extract(spark, spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# op13 ----------------------------------------------------------------------------------------------------------------

def drawn(rows, targets, percent, n, buckets, least):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in rows for b in features(x)), Counter(b for x in targets for b in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        f = features(x)
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: len(may) * percent // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("n", "size"), [(1, 1 << 16), (1, 7), (3, 1 << 16), (3, 40)])
def test_resampling(spark, n, size):
    rng = random.Random(n)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "Ünï", "x" * 90, "0", "A", "z-9", "\x85", "don't"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 50, 400])))) for i in range(120)]
    rows += [(i, t) for i, t in rows[:9]] + [(500, None), (501, ""), (None, " ".join(vocabulary)), (None, "a b"), (502, "x" * 5000), (503, " . " * 3000 + "end")] + [(504, " ".join(vocabulary * 9))] * 3
    targets = [" ".join(rng.choice(vocabulary[:20]) for _ in range(30)) for _ in range(10)] + [None, ""]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id bigint, text string, digest string, own int").repartition(4)
    got = resample.resample(spark, df, spark.createDataFrame([(t,) for t in targets], "text string"), percent=25, n=n, buckets=97, size=size)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == drawn(rows, targets, 25, n, 97, 20)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id bigint, text string")
    assert resample.resample(spark, none, some).count() == 0
    assert Counter(tuple(r) for r in resample.resample(spark, some, none, percent=100).collect()) == drawn([(1, "a " * 30)], [], 100, 1, 10_000, 20)


def test_chunks_own_every_start_once():
    text = b"one  two three. four five " * 50
    for n in (1, 2, 4):
        for size in (1, 5, 64, 10_000):
            cut = list(resample.chunks_of(text, n, size))
            assert b"".join(c[:own] for c, own in cut) == text
            own = [len(resample.WORD.findall(c, 0, k)) for c, k in cut]
            assert sum(own) == 250
            for c, k in cut[:-1]:
                assert len(resample.WORD.findall(c, k)) <= n - 1


def test_queries_agree(spark):
    """The queries' SQL on the smallest tables is checked by the driver; here that extra columns of the tables do no harm."""
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").withColumn("part", F.lit("x"))
    assert cr.repair_report(spark, cr.damage(rows), rows).count() == rows.select("conv_id").distinct().count()


# columns whose names clash, in every stage that keeps other columns ----------------------------------------------------

CLASHING = [
    "quality_score", "quality", "row", "x", "score", "k1", "k2", "dropped", "lines", "term", "term_id", "rid", "item", "set", "position", "offset", "component_id", "class_id", "content", "prints", "size", "rep", "cell", "bucket", "kind", "a", "b", "c", "id",
    "digest", "keep_id", "group_size", "norm", "n", "shard", "part", "words", "w", "at", "piece", "n_words", "n_hit",
]


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_whatever_their_names(spark, stage):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    more = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, more, sf)
    assert got.columns == more.columns, name
    rows = got.collect()
    assert {(r.doc_id, r.text) for r in rows} == {(r.doc_id, r.text) for r in run(spark, plain, sf).collect()}
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING)


def test_a_long_item_is_asked_for_near_its_anchors(spark):
    from codesieve.llm import decontaminate
    from codesieve.llm.common import Workspace

    item = " ".join(f"w{i}" for i in range(4000))
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(10 * i, 10 * i + 10))) for i in range(100)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    ws = Workspace(spark, "t")
    index = decontaminate.build_index(docs, bench, ws)
    assert decontaminate.phrase_matches(index, ws).count() == 100
    assert spark.read.parquet(ws.path("spans")).groupBy("set").count().agg(F.max("count")).first()[0] <= 19
    got = decontaminate.contamination(spark, docs, bench).collect()
    assert all((r.n_words, r.n_hit, r.n_items, r.contaminated) == (10, 10, 1, True) for r in got) and len(got) == 100


def test_counts_decide_over_lines(spark):
    from codesieve.llm import line_dedup

    lines = ["This line stands in two documents", "This line stands in three documents"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines)), (3, lines[1])], "doc_id bigint, text string")
    for least, want in ((2, [2, 1, 0]), (3, [1, 1, 0]), (4, [0, 0, 0])):
        for limit in (1 << 20, 1):
            assert [r.n_dropped for r in line_dedup.line_report(spark, docs, min_docs=least, broadcast_bytes=limit).orderBy("doc_id").collect()] == want
    counts = line_dedup.line_counts(docs, 20, 3)
    assert sorted(r.n_docs for r in counts.collect()) == [2, 3]


# fingerprints in two rounds ------------------------------------------------------------------------------------------

def test_two_rounds_count_as_one(spark):
    """Prints of documents with copies, through buckets directly and through packs: what is shared is the same."""
    import numpy as np

    from codesieve.llm import fingerprints

    def extract(texts):
        out = []
        for t in texts:
            w = (t or "").split()
            prints = np.unique(np.array([int(hashlib.md5(x.encode()).hexdigest()[:16], 16) for x in w], np.uint64))
            out.append((len(prints), hashlib.md5((t or "").encode()).digest(), prints))
        return out

    rng = random.Random(8)
    rows = [(i, " ".join(["hot", *(f"w{rng.randrange(400)}" for _ in range(rng.randrange(60))), f"own{i}"])) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)] + [(2000, None), (2001, ""), (2002, "single")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    words = {i: set((t or "").split()) for i, t in rows}
    contents = {}
    for t in {t for _, t in rows if t}:
        for w in set(t.split()):
            contents[w] = contents.get(w, 0) + 1
    want = {i: sum(contents[w] >= 2 for w in ws) for i, ws in words.items()}

    def keep(size, shared):
        return shared > 0

    found = []
    for fan, block in ((4096, 400_000), (16, 50), (2, 1), (64, 10_000)):
        got = fingerprints.shared_fingerprints(docs, 1024, extract, keep, fan=fan, block=block).collect()
        assert {r.doc_id: r.n_shared for r in got} == want
        found.append({r.doc_id: (r.size, bytes(r.content), sorted(np.frombuffer(r.prints or b"", "<u8").tolist())) for r in got})
    assert all(f == found[0] for f in found)


def test_blocks_stay_worth_their_row():
    """With 2**24 buckets a chunk's blocks hold at least 50 prints, and so do those of a pack."""
    import numpy as np
    import pyarrow as pa

    from codesieve.llm import fingerprints as fp

    rng = np.random.default_rng(1)

    def extract(texts):
        return [(1000, int(t).to_bytes(16, "little"), np.unique(rng.integers(0, 1 << 64, 1000, dtype=np.uint64))) for t in texts]

    n = fp.bucket_count(1 << 60)
    assert n == 1 << 24
    import unittest.mock

    with unittest.mock.patch.object(fp.TaskContext, "get") as get:
        get.return_value.partitionId.return_value = 3
        made = list(fp.blocks(fp.FAN, extract)(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text": [str(i) for i in range(400)]})])))
    rows = [r for b in made for r in b.to_pylist() if r["kind"] in (fp.ONE, fp.SEVERAL)]
    size = -(-fp.low_bits(fp.FAN) // 8)
    assert 400_000 / len(rows) >= 50 and sum(len(r["a"]) for r in rows) // size == 400_000
    # a pack: blocks of one range from many chunks
    one = [r | {"salt": 0, "chunk": k, "bucket": 7} for k in range(4200) for r in [{"kind": fp.SEVERAL, "a": fp.pack(np.unique(rng.integers(0, 1 << fp.low_bits(fp.FAN), 100, dtype=np.uint64)), fp.FAN)}]]
    for r in one:
        k = len(r["a"]) // size
        r["b"], r["c"] = np.ones(k, "<u4").tobytes(), rng.integers(0, 1 << 63, k).astype("<u8").tobytes()
    packed = next(fp.packer(fp.FAN, n, fp.BLOCK)(iter([pa.RecordBatch.from_pylist(one)])))
    sent = [r for r in packed.to_pylist() if r["kind"] == fp.SEVERAL]
    assert len(sent) <= n // fp.FAN and sum(len(r["b"]) // 4 for r in sent) / len(sent) >= 50
    assert all(r["bucket"] // (n // fp.FAN) == 7 for r in sent)


def test_remembered_words_are_bounded_in_bytes(monkeypatch):
    from tokenizers import Tokenizer

    from codesieve.llm import bpe
    from codesieve.llm.queries import tokenizer

    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 3000)
    path = tokenizer("word_bpe_49k.json")
    encoder, library, rng = bpe.ForcedBoundaryEncoder(path), Tokenizer.from_file(path), random.Random(6)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdefé1") for _ in range(rng.choice([3, 9, 300]))) for _ in range(8))
        assert encoder.text(text)[1] == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))
        held = sum(len(w) + len(g[1]) + len(g[2]) for store in (encoder.words, encoder.older) for w, g in store.items())
        assert held <= 2 * 3000 + 4000 and sum(len(t) + 8 * len(g) for (t, _), g in encoder.fragments.items()) <= 1000 + 4000


def test_words_that_come_again_are_not_encoded_again(monkeypatch):
    """115,000 words are remembered at once; pieces without a cut and words of plain letters are read as the library does."""
    from tokenizers import Tokenizer

    from codesieve.llm import bpe
    from codesieve.llm.queries import tokenizer

    path = tokenizer("word_bpe_49k.json")
    encoder, library = bpe.ForcedBoundaryEncoder(path), Tokenizer.from_file(path)
    text = "The THE the, caf\u00e9 CAF\u00c9 don't it's zqxj qzzq Zebra? x1y22 \u0130 \ufb01 \u00aa..--"
    n, ids, decoded = encoder.text(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), library.decode(want, skip_special_tokens=False))
    assert encoder.text("") == encoder.text(" \n ") == (0, "", "")
    asked: list = []
    monkeypatch.setattr(encoder, "ids", lambda w: (asked.append(w), [1])[1])
    for _ in range(2):
        for i in range(0, 115_000, 1000):
            encoder.text(" ".join(f"w{k}" for k in range(i, i + 1000)))
    assert len(asked) == 115_000
