"""Column helpers for text with the semantics of the scanned ecosystem's tools, which differ from Java's defaults."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of ECMAScript regular expressions and trim().
WS = r"\t\n\x0B\f\r \xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Characters that `.` doesn't match.
LINE_ENDS = r"\n\r\u2028\u2029"
#: ASCII word edges; Java's own \\b is Unicode-aware.
BEGIN, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def java_regex(pattern: str) -> str:
    r"""A pattern in the catalogue's notation (\b next to a word character, \s, .*) for rlike and regexp_replace."""
    edged = re.sub(r"\\b(?=\w)", lambda m: BEGIN, pattern).replace(r"\b", END)
    return edged.replace(r"\s", f"[{WS}]").replace(".*", f"[^{LINE_ENDS}]*")


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"[{WS}]+", " "), "^ | $", "")


def lines_of(content: Column) -> Column:
    """Pieces between newlines; a final newline gives a last empty piece."""
    return F.split(content, "\n", -1)


def count_lines(content: Column) -> Column:
    """Lines of a file: none if empty, and a final newline adds none."""
    return F.when(content == "", 0).otherwise(F.size(lines_of(content)) - content.endswith("\n").cast("int"))


def normalize_rule(c: Column) -> Column:
    """Rule names compare in lower case with runs of white space, _ and - as one dash."""
    return F.regexp_replace(F.lower(c), f"[{WS}_-]+", "-")


def clean_name(c: Column) -> Column:
    """A part of a file name: unsafe characters become dashes, none (nor dots) at the ends; never empty."""
    dashed = F.regexp_replace(c, f'[/\\\\:*?"<>|{WS}\\x00-\\x1F]+', "-")
    bare = F.regexp_replace(dashed, "^[-.]+|[-.]+$", "")
    return F.when(bare == "", "scan").otherwise(bare)


def escape_html(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def fixed(c: Column, digits: int) -> Column:
    """Decimal text of the exact binary value, ties away from zero; c is not negative.

    A double times 10**digits is a tie only if it is exact in binary, so a quarter- or eighth-step test finds ties.
    """
    scaled = c.cast("double") * float(10**digits)
    tie = (scaled - F.floor(scaled) == 0.5) & ((F.floor(scaled) + 0.5) / float(10**digits) == c) & (c * float(2 ** (digits + 1)) == F.floor(c * float(2 ** (digits + 1))))
    return F.replace(F.when(tie, F.format_number((F.floor(scaled) + 1) / float(10**digits), digits)).otherwise(F.format_number(c.cast("double"), digits)), F.lit(","), F.lit(""))


def percent(c: Column) -> Column:
    """A share from 0 as per cent with one decimal: of the doubles, 1000 times the share to the nearest whole number, ties
    up. So 37 of 2000 is 1.9%, though 100 times 0.0185 lies a little below 1.85."""
    tenths = F.round(c * 100 * 10, 0).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def number_text(c: Column) -> Column:
    """A number as its shortest plain text: 1, not 1.0; 0.0001, not 1.0E-4."""
    plain = F.regexp_replace(F.format_number(c.cast("double"), 20), r"\.?0+$", "")
    short = F.regexp_replace(c.cast("double").cast("string"), r"\.0$", "")
    return F.when(short.contains("E"), plain).otherwise(short)
