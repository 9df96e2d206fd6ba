"""Operators of the llm subpackage on small hand-made tables, against brute force written plainly here."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.llm import bpe, chat, components, decontaminate, exact_dedup, line_dedup, quality, sharding, suffix_dedup, token_orc, trie_join
from codesieve.llm.common import Workspace
from codesieve.llm.queries import tokenizer

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, size int"
SPACE = " \t\n\x0b\x0c\r"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """doc_id and text: copies, near copies, shared lines and passages, empty, null, long and odd texts."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(10, 100, 12)]
    line = "A line that many documents share, as they do."
    out = [None, "", " \n", "one two", "ONE  two", " ".join(base), *near, *[" ".join(words(rng, 60)) + f"\n {line}\n" + " ".join(words(rng, 30)) for _ in range(8)]]
    out += ["x" * 49, "x" * 50, "x" * 3000, "ab" * 700, " ".join(words(rng, 6000)), "é" * 60, "Ünï " * 30, "don't <|endoftext|> a  b\t\r\n c .", "dup", "dup", "d u p", "\x1c a\x85b c　d"]
    out += [" ".join(words(rng, 40)) for _ in range(20)]
    return [(3 * i % 97, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", None, "clash", 1) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# op1 -----------------------------------------------------------------------------------------------------------------

def check_exact(spark, tmp_path, texts, df, digest):
    df.write.parquet(str(tmp_path / "d"))
    got = by_id(exact_dedup.exact_dedup(spark, str(tmp_path / "d"), digest, files_per_batch=1))
    groups = defaultdict(list)
    for i, t in texts:
        groups["".join(c for c in t or "" if c not in SPACE)].append((-len(t or ""), i))
    for n, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(members), i == keep, sha(n))


def test_exact_dedup(spark, tmp_path, texts, docs):
    check_exact(spark, tmp_path, texts, docs, exact_dedup.sha256)


def test_exact_dedup_compares_texts_where_digests_collide(spark, tmp_path, texts, docs):
    check_exact(spark, tmp_path, texts, docs, lambda t: F.substring(F.md5(F.encode(t, "UTF-8")), 1, 1))


def test_exact_dedup_of_odd_tables(spark, tmp_path, nothing):
    nothing.write.parquet(str(tmp_path / "none"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id bigint, text string").write.parquet(str(tmp_path / "null"))
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in exact_dedup.exact_dedup(spark, str(tmp_path / "null")).collect())
    assert [g[2] for g in got] == [3, 3, 3] and [g[0] for g in got] == ["1", "1", "None"]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.lit("same")])
def test_exact_dedup_of_rows_without_id(spark, tmp_path, digest):
    rows = [(None, "a  b"), (1, "a b"), (2, "ab"), (None, "c"), (None, "c "), (3, "d"), (None, "e")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(spark, str(tmp_path / "d"), digest).collect())
    want = [("1", "1", 3, True, sha("ab")), ("2", "1", 3, False, sha("ab")), ("3", "3", 1, True, sha("d")), *[("None", "None", n, True, sha(t)) for n, t in ((3, "ab"), (2, "c"), (2, "c"), (1, "e"))]]
    assert got == sorted(want)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.lit("same")])
def test_exact_dedup_of_repeated_ids(spark, tmp_path, digest):
    rows = [(5, "aaa"), (5, "bbb"), (6, "aaa"), (7, "bbb"), (7, "b bb"), (8, "c"), (8, "c"), (8, "d"), (None, "bbb")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(spark, str(tmp_path / "d"), digest).collect())
    want = [("5", "5", 2, True, "aaa"), ("5", "7", 4, False, "bbb"), ("6", "5", 2, False, "aaa"), ("7", "7", 4, True, "bbb"), ("7", "7", 4, True, "bbb"), ("8", "8", 2, True, "c"), ("8", "8", 2, True, "c"), ("8", "8", 1, True, "d"), ("None", "None", 4, True, "bbb")]
    assert got == sorted((*w, sha(t)) for *w, t in want)


# op2 -----------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def leaks(texts, items, window):
    for i, t in texts:
        w, hit, found = split(t), set(), set()
        for item, u in items:
            v = split(u)
            for s in range(max(1, len(v) - window + 1)) if v else ():
                part = v[s : s + window]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        found.add(str(item))
        yield i, len(w), len(hit), len(found), sha(",".join(sorted(found)))


def test_decontamination(spark, texts, docs, nothing):
    long = next(t for _, t in texts if t and len(t) > 500 and " " in t)
    items = [(0, " ".join(long.upper().split()[3:30])), (1, "One, TWO"), (2, ""), (3, None), (4, "w1 w1 w1 absent"), (10, "one two"), (5, "Ünï Ünï Ünï ünï"), (0, "dup")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontaminate.contamination(spark, docs, bench))
    for i, *want in leaks(texts, items, 10):
        r = got[i]
        assert [r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated] == [*want, want[1] > 0], i
    clean = decontaminate.decontaminate(spark, docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.contaminated}
    assert decontaminate.contamination(spark, nothing, bench).count() == 0
    assert decontaminate.decontaminate(spark, docs, bench.limit(0)).count() == docs.count()


def test_decontamination_of_repeated_rows(spark):
    long = " ".join(f"v{k}" for k in range(30))
    rows = [(1, f"a {long} b"), (1, f"a {long} b"), (1, f"a {long} b"), (1, "clean text"), (2, "only once"), (2, "only once"), (3, f"c {long}"), (4, "clean"), (4, "clean"), (None, long), (None, long), (None, "clean"), (5, "one"), (5, "one alone"), (6, f"a {long} b")]
    items = [("p", " ".join(long.split()[4:20])), ("w", "once")]
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(spark, df, bench).collect())
    assert got == sorted((str(i), *r, r[1] > 0) for i, *r in leaks(rows, items, 10))
    assert sum(g[2] == 16 for g in got) == 7 and sum(g[2] == 1 for g in got) == 2
    clashing = df.withColumns({"k1": F.lit(1), "row": F.lit(2), "rid": F.lit(3)})
    kept = decontaminate.decontaminate(spark, clashing, bench)
    assert kept.columns == clashing.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "clean text"), ("4", "clean"), ("4", "clean"), ("5", "one"), ("5", "one alone"), ("None", "clean")]


def test_near_matches(spark):
    passage = [f"p{k}" for k in range(14)]
    mixed = passage[:10]
    random.Random(2).shuffle(mixed)
    rows = [(1, "a " + " ".join(mixed)), (2, " ".join(passage)), (3, " x ".join(mixed)), (4, " x y z x y z ".join(mixed)), (5, " ".join(mixed[:4])), (6, "zebra"), (7, "p0 " * 40)]
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), spark.createDataFrame([("i", " ".join(passage)), ("z", "Zebra")], "item_id string, text string")
    got = by_id(decontaminate.contamination(spark, df, bench, near=True))
    ws = Workspace(spark, "t")
    index = decontaminate.build_index(df, bench, ws)
    anchors, items = defaultdict(list), {r["item"]: r for r in index.items.collect()}
    for r in sorted(index.anchors.collect(), key=lambda r: r["rank"]):
        anchors[r["set"]].append((r["item"], r["offset"]))
    for i, t in rows:
        w, near = split(t), set()
        for places in anchors.values():
            own = items[places[0][0]]
            k = [o for _, o in places]
            first, *rest = [own["words"][o] for o in k]
            others = set(own["words"][max(0, max(k) - 9) : min(k) + 10])
            for p in [p for p, x in enumerate(w) if x == first]:
                here = w[max(0, p - 15) : p + 16]
                if all(x in here for x in rest) and len(others & set(here)) >= min(8, len(others)):
                    near.add(own["item_id"])
        assert got[i]["n_near"] == len(near), i
    assert [got[i]["n_near"] for i in (1, 2, 5, 6)] == [1, 1, 0, 1] and got[1]["n_hit"] == 0


# op3 -----------------------------------------------------------------------------------------------------------------

def test_chat(spark):
    rng = random.Random(5)
    shared = [("system", "S"), ("user", "</s>[INST] ok \\ [/INST]")]
    rows = []
    for c in range(60):
        own = [(r, rng.choice(["", "a", "<s>", "[\\INST]", "long " * 40, "é", None])) for r in ("user", "assistant", "tool", "assistant")][: rng.randrange(5)]
        for t, (role, text) in enumerate((shared if c % 3 else []) + own or [("user", "x")]):
            rows.append((c, t, role, text, 1))
    rows += [(70, None, None, "no role", 1), (71, 0, "user", "same", 1), (71, 0, "user", "same", 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, start int").repartition(4)
    nodes, conversations = chat.prefix_tree(spark, df.select("conv_id", "turn", "role", "text"), Workspace(spark, "t"))
    want = defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t if t is not None else -1, role or "", text or ""))
    tree = set()
    for turns in want.values():
        turns.sort()
        for k in range(len(turns)):
            tree.add(tuple((r, x) for _, r, x in turns[: k + 1]))
    stored = sorted(nodes.collect(), key=lambda r: r.start)
    assert len(stored) == len(tree)  # each shared beginning once
    assert [r.start for r in stored] == [0, *[r.end for r in stored][:-1]]  # no gap, depth-first
    for r in stored:
        assert r.position == sum(a.end - a.start for a in r.attends) and all(a.end <= r.start for a in r.attends)
    got = by_conv = {r.conv_id: r for r in chat.chat_digests(spark, df).collect()}
    for c, turns in want.items():
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = by_conv[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{x}\n" for _, a, x in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(chat.format_turn(a, x)[0]) for _, a, x in turns)
    assert len(got) == len(want)
    assert chat.chat_digests(spark, df.limit(0)).count() == 0


def test_chat_rows_without_conversation(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "c")]
    got = sorted((str(r.conv_id), r.n_turns, r.loss_chars) for r in chat.chat_digests(spark, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)).collect())
    assert got == [("1", 2, 1), ("None", 1, 0), ("None", 1, 0), ("None", 1, 1)]


def test_chat_intervals_that_follow_each_other_are_one():
    branch = chat.Branch([], 0)
    turn = [{"role": "user", "text": "x"}] * 3
    a = chat.walk(branch, "".join(c * 32 for c in "abc"), turn)
    b = chat.walk(branch, "".join(c * 32 for c in "ade"), turn)
    assert [len(n["attends"]) for n in a] == [0, 1, 1] and [len(n["attends"]) for n in b] == [1, 2]
    assert b[1]["attends"][0] == {"start": a[0]["start"], "end": a[0]["end"]} and b[1]["attends"][1] == {"start": b[0]["start"], "end": b[0]["end"]}


@pytest.mark.parametrize("text", ["", "\\", "\\\\[INST]", "<s></s>", "[\\INST]", "<<SYS>><</SYS>>", "[[INST]]", "<\\s>"])
def test_escape(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text and not any(c in e for c in chat.CONTROL)
    assert chat.parse(chat.format_turn("a [INST] role", text)[0]) == [("a [INST] role", text)]


# op4 -----------------------------------------------------------------------------------------------------------------

def shingles(t):
    w = bytes((t or "").encode()).lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def closed(ids, links):
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return comp


@pytest.mark.parametrize("cell", [3, 2000])
def test_trie_join(spark, texts, docs, nothing, cell):
    rng = random.Random(8)
    chain = words(rng, 60)
    more = list(texts)
    for k in range(12):  # neighbours link, ends don't
        more.append((1000 + k, " ".join(chain[k:] + [f"y{j}" for j in range(k)])))
    df = spark.createDataFrame([(i, t, "x") for i, t in more], "doc_id bigint, text string, component string")
    sets = {i: shingles(t) for i, t in more}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = closed(sets, links)
    got = by_id(trie_join.jaccard_components(spark, df, cell_sets=cell))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), comp[i]) for i in sets}
    kept = trie_join.keep_one(spark, docs, cell_sets=cell)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in texts if got[i].component_id == i}
    assert trie_join.jaccard_components(spark, nothing).count() == 0
    odd = trie_join.jaccard_components(spark, spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in odd) == [("1", 1, "1"), ("1", 1, "1"), ("None", 1, "None")]


def test_words_are_hashed_without_an_object_each():
    """Shingles of words of any length, blank and case are those of the words' bytes; calls grow with texts, not words."""
    import sys

    rng = random.Random(2)
    long = ["x" * n for n in (7, 8, 9, 16, 31, 32, 33, 34, 90)]
    some = [None, "", " \t\n", "one", "A b", "a\x0bB", "Ä ö \xa0 ü\x1c ß", "\ud800 z", " ".join(long), " ".join(long[::-1]), "a b c d e", "a  b\rc\x0cd\te", "b a c d e", " ".join(words(rng, 20_000, 10_000))]
    want = [set(zip(*(w[i:] for i in range(min(len(w), 5))), strict=False)) for w in ((t or "").encode("utf-8", "surrogatepass").lower().split() for t in some)]
    calls: list = []
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event in ("call", "c_call") else None)
    try:
        got = trie_join.extractor(5)(some)
    finally:
        sys.setprofile(None)
    assert [n for n, _, _ in got] == [len(w) for w in want] and all((np.diff(h) > 0).all() for _, _, h in got if len(h) > 1)
    for a, (_, _, x) in zip(want, got, strict=True):
        assert [len(a & b) for b in want] == [len(np.intersect1d(x, y)) for _, _, y in got]
    assert len(calls) < 2000, len(calls)


def test_large_cells_send_sets_in_proportion(spark, monkeypatch):
    """A cell of 20 times as many sets as a trie may have, in small groups: sets sent grow as the sets do."""
    sent = []
    real = trie_join.links_of
    monkeypatch.setattr(trie_join, "links_of", lambda rows, *a: (sent.append(rows.count()), real(rows, *a))[1])
    totals = []
    for n in (100, 200):
        rng = random.Random(6)
        passages = [words(rng, 24, 100_000) for _ in range(n // 8)]
        rows = []
        for k in range(0, n, 2):  # three passages that others have as well, and of each document a near copy
            w = [x for p in rng.sample(passages, 3) for x in p]
            rows += [(k, " ".join(w)), (k + 1, " ".join([*w, "odd"]))]
        sets = {i: shingles(t) for i, t in rows}
        comp = closed(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
        sent.clear()
        got = by_id(trie_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), cell_sets=10))
        assert {i: r.component_id for i, r in got.items()} == comp and len(set(comp.values())) > n // 8
        totals.append(sum(sent))
    assert totals[1] < 2.6 * totals[0], totals


def test_keep_one_of_repeated_rows(spark):
    rng = random.Random(4)
    a, b = " ".join(words(rng, 40)), " ".join(words(rng, 40))
    rows = [(5, a, "x"), (2, a, "x"), (2, a, "x"), (2, a + " more", "x"), (2, b, "y"), (9, b, "y"), (9, "alone and by itself here", "z"), (None, a, "n"), (None, a, "n"), (7, "", "e"), (7, "", "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row string").repartition(3)
    kept = trie_join.keep_one(spark, df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.row) for r in kept.collect()) == [("2", "x"), ("2", "y"), ("7", "e"), ("7", "e"), ("9", "z"), ("None", "n"), ("None", "n")]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u bigint, v bigint"), Workspace(spark, "t"), "c").collect()}
    want = closed({x for link in links for x in link}, links)
    assert got == {n: c for n, c in want.items() if n != c}


# op5 -----------------------------------------------------------------------------------------------------------------

def test_sharding(spark, texts, docs, nothing):
    got = sharding.shard(docs, [1.0] * 8).collect()
    text = dict(texts)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    many = spark.range(40000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = Counter(r.shard for r in sharding.shard(many, [1.0, 1.0, 2.0]).select("shard").collect())
    assert abs(counts[2] / 20000 - 1) < 0.05 and abs(counts[0] / 10000 - 1) < 0.05
    assert sharding.shard(nothing, [1.0]).count() == 0
    odd = sharding.shard(spark.createDataFrame([(None, None), (None, None)], "doc_id bigint, text string"), [1.0] * 8).collect()
    assert sorted(r.slot for r in odd) == [0, 1] and len({r.shard for r in odd}) == 1


# op6, op7 ------------------------------------------------------------------------------------------------------------

def test_token_files(spark, texts, docs, nothing):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ws = Workspace(spark, "t")
    token_orc.write_tokens(docs, ws.path("tokens"), path, 2)
    got = by_id(token_orc.token_index(token_orc.read_tokens(spark, ws.path("tokens")), ws))
    start = 0
    for i, t in sorted(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert [r.doc_id for r in token_orc.read_tokens(spark, ws.path("tokens"), [texts[5][0]]).collect()] == [texts[5][0]]
    assert token_orc.token_files(spark, nothing, path).count() == 0
    odd = token_orc.token_files(spark, spark.createDataFrame([(None, "a"), (1, "a"), (1, "b c")], "doc_id bigint, text string"), path).collect()
    assert sorted((str(r.doc_id), r.start) for r in odd) == [("1", 2), ("1", 4), ("None", 0)]


def thue_morse(n):
    """Two texts that polynomial hashes modulo 2^64 take for one."""
    t = "".join("ab"[k.bit_count() & 1] for k in range(1 << n))
    return t, t.translate({97: "b", 98: "a"})


def test_token_files_tell_equal_hashes_apart(spark, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    texts = [*thue_morse(12), "x" * 5000, "x" * 5001, "x" * 4999 + "y", "same same", "don't, (stop)\nNow <|endoftext|>.\n\n", "é. ×. “a”"]
    for hashed in (token_orc.mixed, lambda h: h & np.uint64(1)):
        monkeypatch.setattr(token_orc, "mixed", hashed)
        ids, n = token_orc.PieceEncoder(tokenizer("byte_bpe_50k.json")).batch(texts, 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_bpe(spark, texts, docs, nothing):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = by_id(bpe.encode(docs, path))
    for i, t in texts:
        e = library.encode(t or "", add_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))), i
    assert bpe.encode(nothing, path).count() == 0
    decoded = by_id(bpe.decode_ids(bpe.encode_ids(docs, path), path))
    assert all(sha(decoded[i].text) == got[i].decoded_sha256 for i, _ in texts)


def test_bpe_of_repeated_rows(spark):
    rows = [(None, "a b"), (None, None), (1, "a b"), (1, "a b"), (1, "c")]
    got = sorted((str(r.doc_id), r.n_tokens) for r in bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), tokenizer("word_bpe_49k.json")).collect())
    assert got == [("1", 1), ("1", 2), ("1", 2), ("None", 0), ("None", 2)]


def test_very_long_texts(spark):
    """One text of two million bytes, and a document that shares a passage with it, through what works on batches."""
    from tokenizers import Tokenizer

    rng = random.Random(9)
    long = " ".join(words(rng, 400_000))
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"{long} {passage} {long[:5000]}"), (2, f"start {passage} end"), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = by_id(suffix_dedup.suffix_dedup(spark, df))
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, len(passage) + 2, 0]
    for name, run in (("byte_bpe_50k.json", lambda p: token_orc.token_files(spark, df, p)), ("word_bpe_49k.json", lambda p: bpe.encode(df, p))):
        library = Tokenizer.from_file(tokenizer(name))
        n = [len(library.encode(t, add_special_tokens=False).ids) + (name[0] == "b") for _, t in rows]
        assert [r.n_tokens for r in sorted(run(tokenizer(name)).collect())] == n
    assert [r.n_lines for r in line_dedup.line_report(spark, df).collect()] == [1, 1, 1]
    assert by_id(trie_join.jaccard_components(spark, df))[2].n_shingles == 58
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    assert [by_id(decontaminate.contamination(spark, df, bench))[i].n_hit for i in (1, 2, 3)] == [60, 60, 0]


def test_bpe_refuses_files_with_a_decoder():
    with pytest.raises(ValueError, match="decoder"):
        bpe.encoder(tokenizer("byte_bpe_50k.json"))


def test_plain_words_pass_by_the_pre_tokenizer():
    """A blank and ASCII letters are one word: the model gets them; all else goes through the whole library."""
    e = token_orc.PieceEncoder(tokenizer("byte_bpe_50k.json"))
    own, seen = e.library, []

    class Noting:
        def encode_batch_fast(self, texts, **how):
            seen.extend(texts)
            return own.encode_batch_fast(texts, **how)

    e.library = Noting()
    texts = ["one word Zqxv wordéd  two 12 it's don't x", " lead\u0120 \u0120mid end", "", "<|endoftext|> a <|endoftext|>b", "\u00a0 nbsp tail "]
    ids, n = e.batch(texts, 2)
    want = [[*own.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert seen and not any(w in t for t in seen for w in (" word ", " Zqxv", " two"))


def test_forced_boundaries():
    e = bpe.encoder(tokenizer("word_bpe_49k.json"))
    assert len(e.cuts("queauxrée")) >= 1 and "".join(e.cuts("queauxrée")) == "queauxrée"
    assert any(len(e.cuts(w)) > 1 for w in ("zqx", "qzjxk", "vvqqz"))


# op8 -----------------------------------------------------------------------------------------------------------------

def lines_left(texts):
    def key(line):
        k = line.strip(SPACE)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    holders = defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    for i, t in texts:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        yield i, len(lines), len(lines) - len(keep), "\n".join(keep)


@pytest.mark.parametrize("options", [{}, {"shard_keys": 2, "broadcast_bytes": 1}])
def test_line_dedup(spark, texts, docs, nothing, options):
    more = texts + [(200 + i, f"  {'repeated line number ' + str(k)} of its kind \nown {i}\n{'repeated line number ' + str(k)} of its kind") for i, k in enumerate([0, 0, 0, 1, 1, 2, 2, 2, 2, 3, 3, 3])]
    df = spark.createDataFrame([(i, t, "en", "s", None, "clash", 1) for i, t in more], DOCS)
    got, text = by_id(line_dedup.line_report(spark, df, **options)), by_id(line_dedup.dedup_lines(spark, df, **options))
    dropped = 0
    for i, n, gone, kept in lines_left(more):
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (n, gone, sha(kept)), i
        assert (text[i].text or "") == kept and text[i].digest == "clash"
        dropped += gone
    assert dropped > 10
    assert line_dedup.line_report(spark, nothing, **options).count() == 0
    odd = line_dedup.line_report(spark, spark.createDataFrame([(None, "x" * 30)] * 4, "doc_id bigint, text string"), **options)
    assert [r.n_dropped for r in odd.collect()] == [0] * 4


@pytest.mark.parametrize("options", [{}, {"shard_keys": 2, "broadcast_bytes": 1}])
def test_line_dedup_of_repeated_ids(spark, options):
    line, other = "a line of twenty characters and more", "another line that is long enough"
    rows = [(1, f"{line}\nown"), (1, f"{line}\nown"), (2, f"{line}\nx"), (3, other), (3, f"y\n{other}"), (4, other), (5, other), (5, f"{other}\n{line}?")]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_report(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), **options).collect())
    want = [(1, 2, 0, f"{line}\nown")] * 2 + [(2, 2, 0, f"{line}\nx"), (3, 1, 1, ""), (3, 2, 1, "y"), (4, 1, 1, ""), (5, 1, 0, other), (5, 2, 0, f"{other}\n{line}?")]
    assert got == sorted((*w, sha(t)) for *w, t in want)


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 2**63, 20000, dtype=np.uint64)
    h = line_dedup.PerfectHash.build(keys)
    assert sorted(h.find(keys).tolist()) == list(range(len(keys)))
    assert line_dedup.PerfectHash.build(keys[:0]).find(keys[:3]).tolist() == [-1, -1, -1]


# op9 -----------------------------------------------------------------------------------------------------------------

def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(spark, docs, labels)
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    kept = quality.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.filter("predicted = 1").count()


def test_quality_of_odd_tables(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {round(r.score, 3) for r in quality.quality_scores(spark, docs, none).collect()} == {1.0}
    assert quality.quality_scores(spark, nothing, none).count() == 0
    odd = spark.createDataFrame([(None, 1, 0), (3, None, 0), (3, 0, 0), (3, 1, 0), (999, 0, 0)], none.schema)
    assert len({r.score for r in quality.quality_scores(spark, docs, odd).collect()}) == 1


def test_forest_walks_as_trees_do():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = quality.grow(x, y, trees=30)
    s = f.score(x)
    assert ((s > 0.5) == y).mean() > 0.95

    def one(row):
        total = f.base
        for node in f.roots:
            while f.left[node] >= 0:
                node = f.left[node] + (row[f.feature[node]] > f.threshold[node])
            total += f.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(s[:50], [one(r) for r in x[:50]])


# op10 ----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("heavy", [1, 20_000])
def test_suffix_dedup(spark, texts, docs, nothing, heavy, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 5)
    got = by_id(suffix_dedup.suffix_dedup(spark, docs, heavy))
    seen, total = {}, 0
    for i, t in sorted(texts):
        raw = (t or "").encode()
        for s in range(len(raw) - 49):
            seen.setdefault(raw[s : s + 50], i)
    for i, t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 49):
            if seen[raw[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(gone), runs, sha(kept)), i
        total += sum(gone)
    assert total > 1000
    assert suffix_dedup.suffix_dedup(spark, nothing).count() == 0
    odd = suffix_dedup.suffix_dedup(spark, spark.createDataFrame([(None, "z" * 80), (1, "z" * 80), (1, "z" * 80), (2, "z" * 80)], "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in odd) == [("1", 0), ("1", 0), ("2", 80), ("None", 0)]


def test_suffixes_are_in_order():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) + b"abcabc" * 200
    at = np.array(rng.sample(range(len(data) - 50), 2500))
    order, group = suffix_dedup.equal_groups(data, at)
    s = [data[p : p + 50] for p in order]
    assert s == sorted(data[p : p + 50] for p in at)
    assert all((s[k] == s[k + 1]) == (group[k] == group[k + 1]) for k in range(len(s) - 1))


# pipeline ------------------------------------------------------------------------------------------------------------

def walked(forest, x):
    """The score of one document, tree by tree."""
    total = forest.base
    for at in forest.roots:
        while forest.left[at] >= 0:
            at = forest.left[at] + (x[forest.feature[at]] > forest.threshold[at])
        total += forest.value[at]
    return 1 / (1 + np.exp(-total))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    ws, sizes = Workspace(spark, "t"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        after = ws.save(stage(spark, docs, sf), f"s{k}")
        if k < 4:
            assert after.columns == docs.columns
        rows = {r.doc_id: r for r in after.collect()}
        assert set(rows) <= set(before)
        if k == 0:
            forest = quality.train(spark, docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert set(rows) == {i for i, t in before.items() if walked(forest, quality.statistics(t)) >= quality.THRESHOLD}
        if k == 1:
            assert {i: r.text or "" for i, r in rows.items()} == {i: kept for i, _, _, kept in lines_left(list(before.items()))}
        if k == 2:
            sets = {i: shingles(t) for i, t in before.items()}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            assert set(rows) == set(closed(sets, links).values())
        if k == 3:
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(rows) == {i for i, _, hit, *_ in leaks(list(before.items()), items, 10) if not hit}
        if k == 4:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
            assert set(rows) == set(before)
            for i, t in before.items():
                ids = library.encode(t or "", add_special_tokens=False).ids
                r = rows[i]
                assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))), i
        docs = after
        sizes.append(len(rows))
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1] > 0
