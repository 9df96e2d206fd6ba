import re

import pytest
from pyspark.sql import functions as F

from codesieve.functions.rules import RULES, alternatives, literal, rules
from codesieve.functions.rust_items import Unbalanced, items
from codesieve.functions.text import java_regex
from codesieve.operators import chunking
from codesieve.schemas import FILES


def files(spark, *contents):
    return spark.createDataFrame([("t", "c", f"src/{i}.rs", c) for i, c in enumerate(contents)], FILES)


def body(n, hits):
    return "\n".join(hits.get(i, f"// line {i}") for i in range(n))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_file_chunks(spark):
    df = files(spark, "a\nb", "x.unwrap();\nunsafe {}\ny as u32\nz\nend", "unsafe\n")
    got = {r.rel_path: r for r in chunking.file_chunks(df).collect()}
    assert set(got) == {"src/1.rs", "src/2.rs"}
    assert (got["src/1.rs"].start_line, got["src/1.rs"].end_line, got["src/1.rs"].hints) == (1, 5, ["panic", "unsafe", "cast"])
    assert got["src/2.rs"].end_line == 2  # a final newline begins a last, empty piece


def test_line_hits(spark):
    assert rows(chunking.line_hits(files(spark, "ok\nunsafe { x.unwrap() }")), "line", "hint") == [(2, "panic"), (2, "unsafe")]


@pytest.mark.parametrize(
    ("n", "hits", "expected"),
    [
        (30, [14], [(5, 30)]),
        (100, [20, 30], [(11, 100)]),
        (300, [20, 250], [(11, 101), (241, 300)]),
        (400, [20, 111], [(11, 192)]),  # 91 apart: the windows touch
        (400, [20, 112], [(11, 101), (103, 193)]),
        (5, [0], [(1, 5)]),
    ],
)
def test_windows(spark, n, hits, expected):
    content = body(n, {i: "unsafe {}" for i in hits})
    got = chunking.window_chunks(files(spark, content)).collect()
    assert sorted((r.start_line, r.end_line) for r in got) == expected
    for r in got:
        assert r.content == "\n".join(content.split("\n")[r.start_line - 1 : r.end_line])


def test_window_hints_are_in_order_of_first_line(spark):
    content = body(40, {3: "x.unwrap();", 5: "unsafe {}", 9: "x.unwrap();"})
    assert chunking.window_chunks(files(spark, content)).first().hints == ["panic", "unsafe"]


def test_word_edges_are_ascii(spark):
    got = rows(chunking.line_hits(files(spark, "éunsafe", "unsafely", "a as u8", "x_unsafe")), "rel_path", "hint")
    assert got == [("src/0.rs", "unsafe"), ("src/2.rs", "cast")]


def test_every_rule_matches_by_its_literal():
    for mode in RULES.values():
        for _, p in mode:
            assert all(literal(a) for a in alternatives(p)), p
            re.compile(java_regex(p))
    assert rules("nonsense") == RULES["safety"]


SOURCE = """use std::fs;
use std::{
    io,
};
const S: &str = "fn no() { unsafe }";
impl<'a> A<'a> {
    #[no_mangle]
    pub(crate) async unsafe fn go<const N: usize>(&self, g: [u8; 3]) -> impl Fn() -> u8 where B<{ N }>: Sized {
        let c = '{'; let s = r#"}"#; /* } /* { */ */
        fn inner() { x.unwrap() }
        mac! { fn hidden() { unsafe {} } }
    }
    fn sig(&self);
}
mod m {
    extern "C" {
        fn ffi(x: u8);
    }
}
use late::X;
fn last() -> bool { true }
"""


def test_items():
    found, uses = items(SOURCE)
    assert [(f.start_line, f.end_line, f.headers) for f in found] == [(8, 12, ["impl<'a> A<'a>"]), (10, 10, ["impl<'a> A<'a>"]), (13, 13, ["impl<'a> A<'a>"]), (17, 17, ["mod m"]), (21, 21, [])]
    assert uses == [1, 2, 3, 4]


@pytest.mark.parametrize("broken", ["fn a() {", "fn a() }", "/* x", 'let a = "x'])
def test_unbalanced(broken):
    with pytest.raises(Unbalanced):
        items(broken)


def test_function_chunks(spark):
    got = {r.start_line: r for r in chunking.chunk(files(spark, SOURCE)).collect()}
    assert sorted(got) == [8, 10]  # what stands on other lines than a function's is not its own
    assert got[8].hints == ["unsafe", "panic"]
    assert got[10].content.split("\n") == [chunking.USES_HEADER, "use std::fs;", "use std::{", "    io,", "};", chunking.SCOPE_HEADER, "// impl<'a> A<'a>", "// --- function body @ lines 10-10 ---", "        fn inner() { x.unwrap() }"]


def test_function_without_context_is_its_body(spark):
    assert chunking.chunk(files(spark, "fn a() { unsafe {} }")).first().content == "fn a() { unsafe {} }"


def test_broken_files_fall_back_to_windows(spark):
    got = chunking.chunk(files(spark, "fn a() { unsafe {\n")).collect()
    assert [(r.start_line, r.end_line) for r in got] == [(1, 2)]


def test_listing_and_counts(spark):
    df = chunking.chunk(files(spark, "fn a() { unsafe { x.unwrap() } }"), "file")
    assert chunking.chunk_listing(df).first().hints == "unsafe, panic"
    assert rows(chunking.hint_counts(df), "hint", "chunks") == [("panic", 1), ("unsafe", 1)]
    with pytest.raises(ValueError):
        chunking.chunk(df, "module")


def test_gate_is_row_local(spark):
    plan = chunking.window_chunks(files(spark, "unsafe"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_extra_rules(spark):
    df = files(spark, "danger()")
    assert chunking.file_chunks(df, extra=[("own", r"\bdanger\(")]).select(F.col("hints")[0]).first()[0] == "own"


@pytest.mark.parametrize(("pattern", "line"), [(r"id\d{4}", "id1234"), ("(?i)danger", "DANGER"), (r"x{2}y", "xxy"), (r"\tq", "\tq"), ("^own$", "own")])
def test_extra_rules_of_any_syntax(spark, pattern, line):
    df = spark.createDataFrame([("t", "c", "a.rs", f"one\n{line}\nthree"), ("t", "c", "b.rs", "one\nthree")], FILES)
    assert [(r.rel_path, r.line, r.hint) for r in chunking.line_hits(df, extra=[("own", pattern)]).collect()] == [("a.rs", 2, "own")]
    assert [r.rel_path for r in chunking.file_chunks(df, extra=[("own", pattern)]).collect()] == ["a.rs"]
    assert [r.rel_path for r in chunking.window_chunks(df, extra=[("own", pattern)]).collect()] == ["a.rs"]


@pytest.mark.parametrize("mode", ["safety", "logic", "panic"])
def test_automaton_and_regular_expressions_agree(spark, mode):
    """The catalogue through the automaton, and through rlike, which it takes beside a user's rule."""
    import random

    from codesieve.functions.rules import RULES, alternatives, literal

    rng = random.Random(mode)
    bits = [literal(p) for _, pattern in RULES[mode] for p in alternatives(pattern)]
    bits += ["unsafe", "x.unwrap()", "éunsafe", "y as\tu8", "as", "vec![0; n]", "async fn f(self)", "let _ = 1", ".len() -", "a b", " ", "fn f() {", "}", "while let", "impl<T> Drop for X", "loop {", "// c", "as u8"]
    texts = ["\n".join("".join(rng.choice(bits) + rng.choice(["", " ", "(", ")", "\t"]) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["", "\n", "none", "fn a() { x as\nu8 }\n", "fn a() { y(\n"]
    df = spark.createDataFrame([("t", "c", f"{i}.rs", t) for i, t in enumerate(texts)] + [("t", "c", "null.rs", None)], FILES)
    never = [("never", "q{50}z")]
    for unit in ("file", "function", "ast-function"):
        one, two = (sorted(map(tuple, chunking.chunk(df, unit, mode, extra=e).collect())) for e in (None, never))
        assert one == two and one, unit
    one, two = (sorted(map(tuple, chunking.line_hits(df, mode, extra=e).collect())) for e in (None, never))
    assert one == two and one


def test_a_function_is_looked_at_whole(spark):
    """A match may go over lines of a function; files that can't be parsed are cut in windows."""
    got = chunking.chunk(files(spark, "fn a() { x as\n  u8 }\n", "fn b() {\n unsafe { (\n")).collect()
    assert [(r.start_line, r.end_line, r.hints, r.content) for r in sorted(got, key=lambda r: r.content)] == [(1, 2, ["cast"], "fn a() { x as\n  u8 }"), (1, 3, ["unsafe"], "fn b() {\n unsafe { (\n")]
