"""One pass over a file for all rules: an automaton of the literals that their matches hold, and regular expressions only
on lines in which a literal of theirs stands."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

from .rules import alternatives, literal
from .text import java_regex


class Scanner:
    """Finds the rules of a catalogue in texts. Patterns are the catalogue's own, which read alike here and in Spark."""

    def __init__(self, catalogue: list[tuple[str, str]]):
        import ahocorasick

        self.hints = [h for h, _ in catalogue]
        self.patterns = [re.compile(java_regex(p), re.ASCII) for _, p in catalogue]
        rules_of: dict[str, set[int]] = {}
        for k, (_, pattern) in enumerate(catalogue):
            for part in alternatives(pattern):
                rules_of.setdefault(literal(part), set()).add(k)
        if "" in rules_of:
            raise ValueError("a rule without a literal can't be looked up")
        self.automaton = ahocorasick.Automaton()
        for text, rules in rules_of.items():
            self.automaton.add_word(text, tuple(rules))
        self.automaton.make_automaton()

    def candidates(self, text: str) -> Iterable[tuple[int, str, set[int]]]:
        """(number of the line from 0, the line, rules whose literal stands in it), in the order of lines."""
        number, start, end, found = 0, 0, -1, set()
        for at, rules in self.automaton.iter(text):
            if at > end:  # beyond the line at hand
                if found:
                    yield number, text[start:end], found
                    found = set()
                number += text.count("\n", start, at)
                start = text.rfind("\n", 0, at) + 1
                end = text.find("\n", at)
                end = len(text) if end < 0 else end
            found.update(rules)
        if found:
            yield number, text[start:end], found

    def hits(self, text: str) -> list[tuple[int, list[str]]]:
        """(line from 0, its hints in the catalogue's order) of each line in which a rule matches."""
        out = []
        for number, line, rules in self.candidates(text):
            hints = list(dict.fromkeys(self.hints[k] for k in sorted(rules) if self.patterns[k].search(line)))
            if hints:
                out.append((number, hints))
        return out

    def functions(self, text: str, some: list[tuple[int, str, set[int]]], found: list) -> list[dict]:
        """Of the functions found in a text, those in which a rule matches, with its hints. some: what candidates gives."""
        numbers = [number for number, _, _ in some]
        starts = None
        out = []
        for f in found:
            rules: set[int] = set()
            for k in range(bisect_left(numbers, f.start_line - 1), bisect_right(numbers, f.end_line - 1)):
                rules |= some[k][2]
            if not rules:
                continue
            if starts is None:
                starts = [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1]
            body = text[starts[f.start_line - 1] : starts[f.end_line] - 1]
            hints = list(dict.fromkeys(self.hints[k] for k in sorted(rules) if self.patterns[k].search(body)))
            if hints:
                out.append(f._asdict() | {"hints": hints})
        return out
