r"""The rule catalogue. Patterns are unanchored and case-sensitive; \b is an ASCII word edge and . stops at line ends."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import java_regex

# Hint and pattern of each rule, by mode, in the order in which hints are listed.
RULES: dict[str, list[tuple[str, str]]] = {
    "safety": [
        ("unsafe", r"\bunsafe\b"),
        ("ffi", r'\bextern\s+"C"|#\[no_mangle\]'),
        ("panic", r"\.unwrap\(\)|\.expect\("),
        ("cast", r"\bas\s+(u|i)(8|16|32|64|size)\b"),
        ("process", r"std::process::Command|Command::new"),
        ("fs", r"std::fs::|tokio::fs::"),
        ("net", r"reqwest::|hyper::|tokio::net::"),
        ("sql", r"sqlx::|diesel::|rusqlite::"),
        ("crypto", r"\bmd5\b|\bsha1\b|rand::random|ring::|openssl::"),
        ("deser", r"serde_json::from_|bincode::deserialize|rmp_serde::|toml::from_"),
        ("transmute", r"std::mem::transmute|mem::transmute"),
    ],
    "logic": [
        ("loop", r"\bloop\s*\{|\bwhile\s+let\b|\bwhile\s+!?\w"),
        ("recursion", r"\bBox<dyn\s+Future|\.boxed\(\)|async fn .*\bself\b"),
        ("alloc-sized", r"Vec::with_capacity\s*\(|String::with_capacity\s*\(|HashMap::with_capacity\s*\(|vec!\s*\[\s*\w+\s*;|\bBytes::with_capacity\s*\("),
        ("io-unbounded", r"\bread_to_end\b|\bread_to_string\b|\bread_until\b|\bread_line\b|\bBufReader::new|copy\s*\("),
        ("lock", r"\bMutex\b|\bRwLock\b|\bparking_lot::|\bMutexGuard\b|\bRwLockReadGuard\b|\bRwLockWriteGuard\b"),
        ("atomic", r"\bAtomic(?:U|I)(?:8|16|32|64|size)\b|\bAtomicBool\b|\bOrdering::"),
        ("async", r"\.await\b|\btokio::select!|\btokio::join!|\btokio::spawn\b|\bspawn_blocking\b|\bblock_on\b|\basync\s+fn\b|\basync\s+move\b|\basync\s+\{"),
        ("thread", r"\bstd::thread::spawn\b|\bthread::spawn\b|\brayon::"),
        ("channel", r"\bmpsc::|crossbeam_channel::|\btokio::sync::(mpsc|broadcast|watch|oneshot)|\bflume::"),
        ("regex", r"\bRegex::new\b|\bfancy_regex::|\bregress::|\bpcre"),
        ("time", r"\bDuration::from_|\btokio::time::|\bInstant::now\b|\bSystemTime::now\b|\btimeout\s*\("),
        ("cancel", r"\bCancellationToken\b|\bShutdown\b|\bdrop\(\s*tx\s*\)|\bAbortHandle\b"),
        ("error-swallow", r"\blet\s+_\s*=|\.ok\(\)\s*;|\.unwrap_or_default\(\)|\.unwrap_or\(\s*\)"),
        ("arith", r"\.len\(\)\s*[-+]|\bsaturating_|\bwrapping_|\bchecked_|\.checked_(add|sub|mul|div)\b"),
        ("nondet", r"\bHashMap\b|\bHashSet\b|\bf32\b|\bf64\b"),
    ],
    "panic": [
        ("unwrap", r"\.unwrap\(\)|\.expect\s*\(|\.unwrap_err\(\)|\.expect_err\s*\(|\.unwrap_unchecked\s*\("),
        ("panic-macro", r"\bpanic!\s*\(|\bunreachable!\s*\(|\btodo!\s*\(|\bunimplemented!\s*\(|\bassert!\s*\(|\bassert_eq!\s*\(|\bassert_ne!\s*\(|\bdebug_assert"),
        ("slice-op", r"\.split_at(_mut)?\s*\(|\.chunks(_exact)?\s*\(|\.windows\s*\(|\.step_by\s*\(|\.swap\s*\(|\.remove\s*\(|\.swap_remove\s*\(|\.drain\s*\("),
        ("arith", r"\bchecked_(add|sub|mul|div|rem|shl|shr)\b|\bwrapping_|\bsaturating_|\boverflowing_|\bDuration::from_|\bdiv_euclid\b|\brem_euclid\b"),
        ("parse", r"\.parse\s*(?:::|\()|\bfrom_str_radix\b|\btry_into\s*\(|\btry_from\s*\(|\bstr::from_utf8\b|\bString::from_utf8\b|\bCStr::from_bytes_with_nul\b"),
        ("refcell", r"\bRefCell\b|\.borrow\s*\(\)|\.borrow_mut\s*\(\)"),
        ("lock", r"\bMutex\b|\bRwLock\b|\bparking_lot::|\.lock\s*\(\)|\.read\s*\(\)|\.write\s*\(\)"),
        ("channel", r"\.send\s*\(|\.recv\s*\(\)|\.try_send\s*\(|\.try_recv\s*\(\)|\.blocking_send\s*\(|\.blocking_recv\s*\(\)|\.recv_async\s*\(\)"),
        ("ffi", r'\bextern\s+"C"|#\[no_mangle\]'),
        ("drop-impl", r"impl(?:<[^>]*>)?\s+Drop\s+for\b|fn\s+drop\s*\(\s*&mut\s+self\b"),
        ("env", r"\bstd::env::var\b|\benv::var\b|\bvar_os\b"),
        ("recursion", r"\bBox<dyn\s+Future|\.boxed\(\)|async fn .*\bself\b"),
        ("task-join", r"\bJoinHandle\b|\.join\s*\(\)|\btokio::task::spawn\b|\btokio::spawn\b"),
    ],
}


BUILT_IN = {p for catalogue in RULES.values() for _, p in catalogue}


def rules(mode: str, extra: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Rules of a mode and the user's own; an unknown mode means safety."""
    return RULES.get(mode, RULES["safety"]) + (extra or [])


def alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between bars outside groups and classes."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def literal(part: str) -> str:
    """The longest text that every match of a pattern without outer bars holds."""
    runs, depth, i = [""], 0, 0
    while i < len(part):
        c = part[i]
        plain = c
        if c == "\\":
            i += 1
            plain = "" if part[i] in "bsw" else part[i]
        elif c in "([":
            depth += 1
            plain = ""
        elif c in ")]":
            depth -= 1
            plain = ""
        elif c in "?*":  # what stands before may be absent
            runs[-1] = runs[-1][:-1]
            plain = ""
        elif c in "+.^$":
            plain = ""
        if depth or not plain:
            runs.append("")
        else:
            runs[-1] += plain
        i += 1
    return max(runs, key=len)


def matches(text: Column, pattern: str) -> Column:
    """rlike; for patterns of the catalogue asked only of texts that hold one of their literals: a byte search costs far
    less. literal() reads no more syntax than the catalogue has, so a user's patterns go without."""
    if pattern not in BUILT_IN:
        return text.rlike(java_regex(pattern))
    some = [F.contains(text, F.lit(literal(p))) for p in alternatives(pattern)]
    return reduce(or_, some) & text.rlike(java_regex(pattern))


def hints_in(text: Column, catalogue: list[tuple[str, str]]) -> Column:
    """Hints that match a text, in the catalogue's order."""
    return F.array_distinct(F.filter(F.array(*(F.when(matches(text, p), F.lit(h)) for h, p in catalogue)), lambda h: h.isNotNull()))


def any_rule(text: Column, catalogue: list[tuple[str, str]]) -> Column:
    """Whether a whole file can hold a hit: no pattern of the catalogue is anchored, so a hit in a line is a hit in the
    file. A user's pattern may be, so with one every file has to be looked at."""
    return reduce(or_, (matches(text, p) if p in BUILT_IN else F.lit(True) for _, p in catalogue))
