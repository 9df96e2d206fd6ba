"""Items of a Rust source text: functions with their lines and enclosing headers, and leading `use` lines.

A token scan that knows comments, strings, characters, lifetimes and nested delimiters; macro bodies are opaque. It is
linear in the text. Sources whose delimiters don't balance are reported as not parsed.
"""

from __future__ import annotations

import re
from typing import NamedTuple

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*)|(?P<block>/\*)|(?P<string>(?:b|c)?r(?P<h>\#*)".*?"(?P=h)|[bc]?"(?:\\.|[^"\\])*"|b?'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^\\'\n])')"""
    r"""|(?P<life>'[^\W\d]\w*)|(?P<word>(?:r\#)?[^\W\d]\w*)|(?P<num>\d\w*)|(?P<arrow>->|=>|::)|(?P<mark>.)""",
    re.DOTALL | re.VERBOSE,
)
QUALIFIERS = {"pub", "const", "async", "unsafe", "extern", "default", "safe"}
STOPS = {"fn", "impl", "trait", "mod", "struct", "enum"}
CLOSERS = {"(": ")", "[": "]", "{": "}"}
NOT_MACROS = {"if", "while", "match", "return", "in", "else", "let", "mut", "ref", "move", "break", "as"}


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    at: int


class Function(NamedTuple):
    start_line: int
    end_line: int
    headers: list[str]


class Unbalanced(ValueError):
    pass


def tokens(source: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(source):
        m = TOKEN.match(source, at)
        end = m.end()
        if m.lastgroup == "block" or m["block"]:
            depth = 1
            for c in re.compile(r"/\*|\*/").finditer(source, end):
                depth += 1 if c[0] == "/*" else -1
                if not depth:
                    end = c.end()
                    break
            else:
                raise Unbalanced
        elif not m["skip"]:
            kind = next(k for k in ("string", "life", "word", "num", "arrow", "mark") if m[k] is not None)
            if kind == "mark" and m[0] in "\"":
                raise Unbalanced
            out.append(Token(kind, m[0], line, at))
        line += source.count("\n", at, end)
        at = end
    return out


def matching(t: list[Token]) -> dict[int, int]:
    """Index of the closing delimiter of each opening one."""
    out, stack = {}, []
    for i, x in enumerate(t):
        if x.kind != "mark":
            continue
        if x.text in CLOSERS:
            stack.append(i)
        elif x.text in ")]}":
            if not stack or CLOSERS[t[stack[-1]].text] != x.text:
                raise Unbalanced
            out[stack.pop()] = i
    if stack:
        raise Unbalanced
    return out


def first_of(t: list[Token], i: int, partner: dict[int, int]) -> int:
    """Index of the first qualifier before the item word at i."""
    while i > 0:
        p = t[i - 1]
        if p.kind == "word" and p.text in QUALIFIERS or p.kind == "string" and i > 1 and t[i - 2].text == "extern":
            i -= 1
        elif p.text == ")" and (o := partner.get(i - 1)) is not None and o > 0 and t[o - 1].text == "pub":
            i = o - 1
        else:
            break
    return i


def body_at(t: list[Token], i: int, pairs: dict[int, int]) -> int:
    """Index of the `{` or `;` that ends the head of the item whose word is at i."""
    angle = 0
    while i < len(t):
        x = t[i]
        if x.kind == "mark":
            if x.text == "<":
                angle += 1
            elif x.text == ">":
                angle -= 1
            elif x.text in "([" or x.text == "{" and angle > 0:
                i = pairs[i]
            elif x.text in "{;":
                return i
        i += 1
    raise Unbalanced


def items(source: str) -> tuple[list[Function], list[int]]:
    """(functions in order of their beginning, lines of leading use declarations). Raises Unbalanced."""
    t = tokens(source)
    pairs = matching(t)
    partner = {v: k for k, v in pairs.items()}
    found: list[list] = []
    uses: list[int] = []
    headers: list[str] = []
    closing: list[tuple[int, list | None]] = []  # (index of the closing brace, function) of functions and containers
    leading = True
    i, top = 0, -1  # top: index of the delimiter that closes the outermost open item
    while i < len(t):
        while closing and i >= closing[-1][0]:
            end, function = closing.pop()
            if function is None:
                headers.pop()
            else:
                function[1] = t[end].line
        x = t[i]
        if x.kind != "word":
            if x.kind == "mark" and x.text == "{" and i > top:
                top = pairs[i]
            i += 1
            continue
        after = t[i + 1] if i + 1 < len(t) else None
        outside = i > top
        if after and after.text == "!" and x.text not in NOT_MACROS:
            j = i + 2
            if j < len(t) and t[j].kind == "word":
                j += 1
            if j < len(t) and t[j].kind == "mark" and t[j].text in CLOSERS:
                i = pairs[j] + 1
                continue
        begin = first_of(t, i, partner)
        at_item = begin == 0 or t[begin - 1].text in ("{", "}", ";", "]")
        if leading and outside and x.text in STOPS and at_item:
            leading = False
        if x.text == "fn" and after and after.kind == "word":
            end = body_at(t, i + 2, pairs)
            function = [t[begin].line, t[end].line, list(headers)]
            found.append(function)
            if t[end].text == "{":
                closing.append((pairs[end], function))
                top = max(top, pairs[end])
            i = end + 1
        elif x.text in ("impl", "trait", "mod") and at_item and after and (after.kind in ("word", "life") or after.text in "<&(*!:[" or after.text == "::"):
            end = body_at(t, i + 1, pairs)
            if t[end].text == "{":
                head = source[t[begin].at :].split("\n", 1)[0][: t[pairs[end]].at + 1 - t[begin].at]
                headers.append(re.sub(r"\s*\{?\s*$", "", head).strip())
                closing.append((pairs[end], None))
                top = max(top, pairs[end])
            i = end + 1
        elif x.text == "use" and at_item and outside:
            end = i
            while end < len(t) and t[end].text != ";":
                end += 1
            if end == len(t):
                raise Unbalanced
            if leading:
                uses += range(t[begin].line, t[end].line + 1)
            i = end + 1
        else:
            i += 1
    while closing:
        end, function = closing.pop()
        if function is not None:
            function[1] = t[end].line
    return [Function(*f) for f in found], sorted(set(uses))
