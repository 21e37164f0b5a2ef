"""Workflows: statements from a file or a column, run one after another with variables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans.dialect import run


def statements(lines: Iterable[str]) -> list[str]:
    """Whole statements of lines: ended by a semicolon outside quotes and comments. Lines that begin with -- are dropped; an unfinished end raises."""
    text = "\n".join(x for x in lines if not x.lstrip().startswith("--"))
    out, start = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|/\*.*?\*/|;", text, re.S):
        if m[0] == ";":
            out.append(text[start : m.start()].strip())
            start = m.end()
    if text[start:].strip():
        raise ValueError(f"unfinished statement: {text[start:].strip()[:60]}")
    return [s for s in out if s]


class Flow:
    """A scope of variables and what runs in it."""

    def __init__(self, spark: SparkSession, **variables: str):
        self.spark, self.variables, self.name = spark, dict(variables), None

    def var(self, name: str, value: str | None = None) -> str | None:
        if value is not None:
            self.variables[name] = value
        return self.variables.get(name)

    def requirevars(self, *names: str) -> None:
        missing = [n for n in names if n not in self.variables]
        if missing:
            raise KeyError(f"variables not set: {', '.join(missing)}")

    def flowname(self, name: str | None = None) -> str | None:
        if name is not None:
            self.name = name
            self.spark.sparkContext.setJobDescription(name)
        return self.name

    def table(self) -> DataFrame:
        """(variable, value)"""
        return self.spark.createDataFrame(sorted(self.variables.items()), "variable string, value string")

    def exec(self, lines: Iterable[str] | DataFrame, passed: dict[str, str] | None = None) -> DataFrame | None:
        """Runs statements in a scope of their own, given the variables `passed` (new name -> old name). `ignorefail` before a statement lets it fail; any other failure ends the run. Returns the last result."""
        if isinstance(lines, DataFrame):
            if len(lines.columns) != 1:
                raise ValueError("one column of statements is needed")
            lines = (r[0] for r in lines.toLocalIterator())
        inner = Flow(self.spark, **{new: self.variables[old] for new, old in (passed or {}).items()})
        last = None
        for statement in statements(lines):
            m = re.match(r"(?is)ignorefail\s+(.*)", statement)
            set_ = re.match(r"(?is)var\s+'?(\w+)'?\s+(?:from\s+(.*)|'([^']*)')$", statement)
            try:
                if set_:
                    row = inner.run(set_[2]).first() if set_[2] else None
                    inner.var(set_[1], set_[3] if set_[3] is not None else None if row is None else str(row[0]))
                else:
                    last = inner.run(m[1] if m else statement)
            except Exception:
                if not m:
                    raise
        return last

    def run(self, statement: str) -> DataFrame:
        return run(self.spark, statement, self.variables)
