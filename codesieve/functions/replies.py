"""Strict reading of model replies: JSON somewhere in prose, then a schema that holds as a whole or not at all."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FINDING, SEVERITIES, VERDICT


class Invalid(ValueError):
    pass


def need(ok: bool, what: str) -> None:
    if not ok:
        raise Invalid(what)


def no_constant(name: str) -> None:
    raise Invalid(f"{name} is no JSON")


def is_number(v: object) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def text(o: dict, name: str) -> str:
    need(isinstance(o.get(name), str), f"{name}: not a string")
    return o[name]


def optional_text(o: dict, name: str) -> str | None:
    return text(o, name) if name in o else None


def one_of(o: dict, name: str, allowed: list[str]) -> str:
    need(isinstance(o.get(name), str) and o[name] in allowed, f"{name}: not one of {', '.join(allowed)}")
    return o[name]


def count(o: dict, name: str) -> int:
    v = o.get(name)
    need(is_number(v) and v == v and abs(v) < 2**31 and v == int(v) and v >= 0, f"{name}: not a whole number from 0")
    return int(v)


def share(o: dict, name: str) -> float:
    v = o.get(name)
    need(is_number(v) and 0 <= v <= 1, f"{name}: not a number from 0 to 1")
    return float(v)


def finding(o: object) -> dict:
    need(isinstance(o, dict), "a finding is not an object")
    return {
        "rule_id": text(o, "rule_id"), "severity": one_of(o, "severity", SEVERITIES), "cwe": optional_text(o, "cwe"), "file": text(o, "file"), "line_start": count(o, "line_start"), "line_end": count(o, "line_end"),
        "summary": text(o, "summary"), "evidence": text(o, "evidence"), "fix_suggestion": text(o, "fix_suggestion"), "confidence": share(o, "confidence"),
    }


def findings(o: object) -> list[dict]:
    need(isinstance(o, dict) and isinstance(o.get("findings"), list), "findings: not a list")
    return [finding(x) for x in o["findings"]]


def verdict(o: object) -> dict:
    need(isinstance(o, dict), "not an object")
    return {"verdict": one_of(o, "verdict", ["confirm", "reject", "downgrade"]), "new_severity": one_of(o, "new_severity", SEVERITIES) if "new_severity" in o else None, "reason": text(o, "reason"), "confidence": share(o, "confidence")}


def validator(check: Callable[[object], object], field: str, returns: str):
    """Pandas UDF: JSON text to struct(ok, <field>, error)."""

    @F.pandas_udf(f"struct<ok:boolean,{field}:{returns},error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s in b:
                try:
                    need(isinstance(s, str), "no object in the reply")
                    rows.append((True, check(json.loads(s, parse_constant=no_constant)), None))
                except (ValueError, RecursionError) as e:
                    rows.append((False, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["ok", field, "error"])

    return run


def ddl(fields: str) -> str:
    return "struct<" + ",".join(x.strip().replace(" ", ":") for x in fields.split(",")) + ">"


def parse_findings(text: Column) -> Column:
    """struct(ok, findings, error) of a reply's JSON."""
    return validator(findings, "findings", f"array<{ddl(FINDING)}>")(text)


def parse_verdict(text: Column) -> Column:
    """struct(ok, verdict, error) of a judge's JSON."""
    return validator(verdict, "verdict", ddl(VERDICT))(text)


def object_in(reply: Column) -> Column:
    """From the first { to the last }, or null."""
    first = F.locate("{", reply)
    last = F.length(reply) - F.locate("}", F.reverse(reply)) + 1
    return F.when((first > 0) & (F.locate("}", reply) > 0) & (last > first), F.substring(reply, first, last - first + 1))
