"""A small dialect in which operators stand before the query they work on, compiled to DataFrame plans.

    sample 10 slidingwindow order:a n:3 SELECT a, b FROM t

reads from right to left: the SELECT is Spark's, then each operator gets the DataFrame on its right.
`name:value` sets a named argument, other words are arguments in order; quotes hold blanks together.
%{var} is replaced by a variable first. Nothing is materialised between steps.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators import tables as R

_TOKEN = re.compile(r"\s*(?:(\w+):('(?:[^']|'')*'|[^\s']+)|'((?:[^']|'')*)'|(\S+))")
_STARTS = ("select", "with", "values", "table", "from")


def _names(x: str) -> list[str]:
    return [p.strip() for p in x.split(",") if p.strip()]


#: Operator -> function of (df, *arguments as text).
OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "sample": lambda df, size, seed="0": R.sample(df, int(size), int(seed)),
    "rowidvt": lambda df, order: R.rowidvt(df, _names(order)),
    "slidingwindow": lambda df, n, order: R.slidingwindow(df, _names(order), int(n)),
    "timeslidingwindow": lambda df, by, ts, seconds: R.timeslidingwindow(df, _names(by), ts, float(seconds)),
    "toeav": lambda df, entity: R.toeav(df, entity),
    "fromeav": lambda df, attributes: R.fromeav(df, _names(attributes)),
    "setschema": lambda df, schema: R.setschema(df, schema),
    "coltypes": lambda df: R.coltypes(df),
    "queryplan": lambda df: R.queryplan(df),
    "hidden": lambda df: R.hidden(df),
    "ordered": lambda df, by: R.ordered(df, _names(by)),
    "cache": lambda df: R.cached(df),
    "unindexed": lambda df: R.unindexed(df),
    "expand": lambda df, multisets: R.expand(df, _names(multisets)),
    "partialsort": lambda df, n: R.partialsort(df, int(n)),
    "groupdiff": lambda df, key, order, by="", keep="": R.groupdiff(df, _names(by), key, _names(order), _names(keep)),
    "datediffbreak": lambda df, group, ts, maxdiff: R.datediffbreak(df, group, ts, float(maxdiff)),
    "datedifffilter": lambda df, by, ts, maxdiff: R.datedifffilter(df, _names(by), ts, float(maxdiff)),
    "freqitemsets": lambda df, row, item, threshold, maxlen=None: R.freqitemsets(df, row, item, int(threshold), None if maxlen is None else int(maxlen)),
    "graphcliques": lambda df, a, b: R.graphcliques(df, a, b),
}


def substitute(text: str, variables: dict[str, str]) -> str:
    def value(m):
        if m[1] not in variables:
            raise KeyError(f"variable {m[1]} is not set")
        return str(variables[m[1]])

    return re.sub(r"%\{(\w+)\}", value, text)


def run(spark: SparkSession, text: str, variables: dict[str, str] | None = None, operators: dict[str, Callable] | None = None) -> DataFrame:
    """The plan of a statement in the dialect; plain SQL passes through."""
    text, known = substitute(text, variables or {}).strip().rstrip(";"), {**OPERATORS, **(operators or {})}
    word = re.match(r"\w+", text)
    if not word or word[0].lower() not in known:
        return spark.sql(text)
    at, args, named = word.end(), [], {}
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            break
        bare = (m[4] or "").lower()
        if not m[1] and m[3] is None and (bare.lstrip("(") in _STARTS or bare in known):
            break
        clean = lambda v: v[1:-1].replace("''", "'") if v.startswith("'") else v
        if m[1]:
            named[m[1]] = clean(m[2])
        else:
            args.append(m[3].replace("''", "'") if m[3] is not None else m[4])
        at = m.end()
    if not text[at:].strip():
        raise ValueError(f"{word[0]} needs a query on its right")
    return known[word[0].lower()](run(spark, text[at:].strip(), None, operators), *args, **named)
