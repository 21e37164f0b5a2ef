"""Aggregates that are one expression: statistics, dates, selection by a key, concatenation, packs.

Each returns a Column for agg(), so that Spark combines partial results before the shuffle. Where
the order of rows shows in the result, an order column is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import col


def _number(x) -> Column:
    """A value as a number; text that is none, NULL and 0 are skipped."""
    n = col(x).try_cast("double")
    return F.when(n != 0, n)


def median(x) -> Column:
    return F.median(_number(x))


def rangef(x) -> Column:
    return F.max(_number(x)) - F.min(_number(x))


def amean(x) -> Column:
    return F.avg(_number(x))


def wamean(weight, x) -> Column:
    """Rows where either is skipped don't count."""
    w, v = _number(weight), _number(x)
    return F.try_divide(F.sum(w * v), F.sum(F.when(v.isNotNull(), w)))


def gmean(x, p: float = 0) -> Column:
    """Power mean; p = 0 is the geometric one."""
    v = _number(x)
    return F.exp(F.avg(F.ln(F.when(v > 0, v)))) if p == 0 else F.pow(F.avg(F.pow(v, F.lit(float(p)))), F.lit(1.0 / p))


def variance(x, population: bool = False) -> Column:
    """Zeros count; one value gives 0."""
    v = col(x).try_cast("double")
    return F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.var_pop(v) if population else F.var_samp(v))


def stdev(x, population: bool = False) -> Column:
    return F.sqrt(variance(x, population))


def pearson(x, y) -> Column:
    """0 where either side does not vary, NULL over no rows."""
    a, b = col(x).try_cast("double"), col(y).try_cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    flat = (F.max(a) == F.min(a)) | (F.max(b) == F.min(b))
    return F.when(F.count(a) == 0, F.lit(None)).when(flat, F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def fsum(x, scale: int = 10) -> Column:
    """The exact sum of a decimal column as JSON [numerator, denominator], reduced; nothing gives [0, 1]."""
    total = F.coalesce(F.sum(col(x).cast(f"decimal(28,{scale})")), F.lit(0))
    n = (total * 10**scale).cast("decimal(38,0)")

    @F.pandas_udf("string")
    def reduced(s):
        from fractions import Fraction

        return s.map(lambda v: "[%d,%d]" % Fraction(int(v), 10**scale).as_integer_ratio())

    return reduced(n)


def frecency(date, now, points: float = 100) -> Column:
    """Points by age: all up to 10 days, 70 % up to 30, 50 % up to 90, 30 % up to 180, else 10 %."""
    age = F.datediff(col(now), col(date))
    share = F.when(age <= 10, 1.0).when(age <= 30, 0.7).when(age <= 90, 0.5).when(age <= 180, 0.3).when(age.isNotNull(), 0.1)
    return F.coalesce(F.sum(share * points), F.lit(0.0))


def frecencyindex(date, now) -> Column:
    age = F.datediff(col(now), col(date))
    share = F.when(age < 30, 1.0).when(age < 90, 0.7).when(age < 180, 0.5).when(age < 360, 0.3).when(age < 720, 0.2)
    return F.coalesce(F.sum(share), F.lit(0.0))


def _micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def avgdtdiff(ts) -> Column:
    """(last - first) / rows in milliseconds; NULL below two rows."""
    m = _micros(ts)
    return F.when(F.count(m) > 1, (F.max(m) - F.min(m)) / 1000 / F.count(m))


def dategroupduration(ts) -> Column:
    """Last - first in seconds; 0 over nothing."""
    m = _micros(ts)
    return F.coalesce((F.max(m) - F.min(m)) / 1_000_000, F.lit(0.0))


def imax(i: int, x) -> Column:
    """The i-th largest value, repeats counted. Holds a group's values: for groups of bounded size; see ranked() for others."""
    return F.get(F.sort_array(F.collect_list(col(x)), asc=False), i - 1)


def minrow(key, value, order) -> Column:
    """The value at the smallest key, NULL the smallest; the first in `order` of equals."""
    return F.min_by(col(value), F.struct(col(key).isNotNull(), col(key), col(order)))


def maxrow(key, value) -> Column:
    """The value at the largest key; the largest of equals."""
    return F.max_by(col(value), F.struct(col(key).isNotNull(), col(key), col(value).isNotNull(), col(value)))


def _ordered(value: Column, order) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(col(order).alias("o"), value.alias("v")))), lambda s: s["v"])


def concatgroup(x, order) -> Column:
    return F.array_join(_ordered(col(x).cast("string"), order), "")


def concatlines(x, order) -> Column:
    return F.array_join(_ordered(col(x).cast("string"), order), "\n")


def concatterms(x, order) -> Column:
    """Joined by spaces, empty texts left out."""
    return F.array_join(F.filter(_ordered(col(x).cast("string"), order), lambda v: v != ""), " ")


def showgroups(*columns, order) -> Column:
    """The group as tab-separated lines, with a line end first."""
    row = F.concat_ws("\t", *[col(c).cast("string") for c in columns])
    return F.concat(F.lit("\n"), F.array_join(_ordered(row, order), "\n"))


def jgroup(*columns, order) -> Column:
    """An array of the values, or of arrays where there are several columns."""
    value = col(columns[0]).cast("string") if len(columns) == 1 else F.array(*[col(c).cast("string") for c in columns])
    return _ordered(value, order)


def jdictgroup(key, value, order) -> Column:
    """A map; the later of equal keys wins, a NULL key is left out. Holds a group's rows; the operator of this name in tables.py holds its distinct keys alone."""
    sorted_ = F.array_sort(F.collect_list(F.when(col(key).isNotNull(), F.struct(col(key).alias("k"), col(order).alias("o"), col(value).alias("v")))))
    # an array of the one array binds it to a name: in a lambda its expression would be worked out for every element
    last = F.get(F.transform(F.array(sorted_), lambda a: F.filter(a, lambda p, i: ~F.coalesce(F.get(a, i + 1)["k"] == p["k"], F.lit(False)))), 0)
    ordered = F.array_sort(F.transform(last, lambda p: F.struct(p["o"], p["k"], p["v"])))
    return F.map_from_entries(F.transform(ordered, lambda p: F.struct(p["k"], p["v"])))


def jgroupunion(pack, order) -> Column:
    return F.array_distinct(F.flatten(_ordered(col(pack), order)))


def jgroupintersection(pack, order) -> Column:
    packs = _ordered(col(pack), order)
    return F.aggregate(packs, F.array_distinct(F.get(packs, 0)), lambda a, p: F.array_intersect(a, p))


def jgroupunionkeys(text, order) -> Column:
    return F.array_distinct(F.flatten(_ordered(F.json_object_keys(col(text)), order)))


def sampledistvals(n: int, x) -> Column:
    """Up to n distinct values, the smallest, sorted."""
    return F.slice(F.array_sort(F.collect_set(col(x).cast("string"))), 1, n)


def graphtodot(name: str, a, b, directed: bool = True) -> Column:
    """Graphviz text of the edges, sorted."""
    arrow, word = ("->", "digraph") if directed else ("--", "graph")
    edge = F.concat(F.lit('"'), col(a).cast("string"), F.lit(f'" {arrow} "'), col(b).cast("string"), F.lit('";'))
    return F.concat(F.lit(f"{word} {name} {{\n"), F.array_join(F.array_sort(F.collect_set(edge)), "\n"), F.lit("\n}"))


def graphtotgf(a, b) -> Column:
    """Nodes, #, edges, each sorted."""
    nodes = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(col(a).cast("string"), col(b).cast("string"))))))
    edges = F.array_sort(F.collect_set(F.concat_ws(" ", col(a).cast("string"), col(b).cast("string"))))
    return F.concat(F.array_join(nodes, "\n"), F.lit("\n#\n"), F.array_join(edges, "\n"))
