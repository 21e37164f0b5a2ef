"""Packs: lists and dictionaries that travel as JSON text.

Inside a query they are ARRAY<STRING> and MAP<STRING, STRING>. `unpack` reads the text form - a JSON
list, or a bare scalar for a list of one - and `pack_text` writes it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import col


def unpack(text) -> Column:
    """A pack's text as an array; NULL and the empty text are empty packs, a dictionary counts as one element."""
    t = col(text)
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), F.array(t))).otherwise(F.array(t))


def pack_text(array) -> Column:
    """An array as a pack's text: one element stands bare, unless it would read as a list itself."""
    a = col(array)
    one = F.get(a, 0)
    return F.when((F.size(a) == 1) & one.isNotNull() & ~one.startswith("["), one).otherwise(F.to_json(a, {"ignoreNullFields": "false"}))


def jpack(*values) -> Column:
    return pack_text(F.array(*[col(v).cast("string") for v in values]))


def jsonstrict(*values) -> Column:
    """Always a JSON list."""
    return F.to_json(F.array(*[col(v) for v in values]))


def jmerge(*packs) -> Column:
    return F.concat(*[col(p) for p in packs])


def jngrams(text, n: int = 2) -> Column:
    """All runs of n terms, as an array of arrays."""
    words = F.split(col(text), " ", -1)
    return F.when(F.size(words) < n, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.slice(words, i, n)))


def jfrequentwords(text) -> Column:
    """Words that occur at least as often as the rounded-up mean over words, 3 % of extremes cut at both ends; sorted."""
    words = F.split(col(text), " ", -1)
    ordered = F.array_sort(words)
    kinds = F.array_distinct(ordered)
    counted = F.transform(kinds, lambda w: F.struct((F.size(words) - F.size(F.array_remove(words, w))).alias("n"), w.alias("w")))
    cut = F.ceil(F.size(kinds) * 3 / F.lit(100)).cast("int")
    middle = F.slice(F.array_sort(F.transform(counted, lambda c: c["n"])), cut + 1, F.greatest(F.size(kinds) - 2 * cut, F.lit(0)))
    mean = F.ceil(F.try_divide(F.aggregate(middle, F.lit(0), lambda a, x: a + x), F.size(middle)))
    return F.transform(F.filter(counted, lambda c: c["n"] >= mean), lambda c: c["w"])


def jzip(*packs) -> Column:
    """Arrays zipped up to the shortest."""
    least = F.least(*[F.size(col(p)) for p in packs]) if len(packs) > 1 else F.size(col(packs[0]))
    return F.transform(F.sequence(F.lit(0), F.greatest(least - 1, F.lit(0))), lambda i: F.array(*[F.get(col(p), i) for p in packs])) if packs else F.array()


def jzipdict(keys, *packs) -> Column:
    """A map from the first pack's elements to arrays of the others'."""
    return F.map_from_entries(F.transform(jzip(keys, *packs), lambda r: F.struct(r[0], F.slice(r, 2, len(packs)))))


def jlen(*packs) -> Column:
    total = F.lit(0)
    for p in packs:
        total = total + F.size(col(p))
    return total.cast("long")


def jrange(n) -> Column:
    """'0' to n - 1 as texts."""
    c = col(n)
    return F.when(c < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(c - 1, F.lit(0)).cast("int")), lambda i: i.cast("string")))


def jfilterempty(pack) -> Column:
    return F.filter(col(pack), lambda x: x.isNotNull() & ~x.isin("", "[]"))


def jlengthiest(pack) -> Column:
    """The longest element; the first of equals."""
    return F.aggregate(col(pack), F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))


def jchars(text) -> Column:
    return F.filter(F.split(col(text), "", -1), lambda c: c != "")


def j2s(pack) -> Column:
    return F.replace(F.array_join(col(pack), " "), F.lit("\n"), F.lit(" "))


def j2t(pack) -> Column:
    return F.array_join(F.transform(col(pack), lambda x: F.replace(F.replace(x, F.lit("\t"), F.lit("    ")), F.lit("\n"), F.lit(" "))), "\t")


def t2j(text) -> Column:
    return F.split(col(text), "\t", -1)


def s2j(text) -> Column:
    return F.filter(F.split(col(text), " ", -1), lambda x: x != "")


def nl2j(text) -> Column:
    return F.split(col(text), "\n", -1)


def j2nl(pack) -> Column:
    return F.array_join(col(pack), "\n")


def jset(*packs) -> Column:
    """Sorted distinct elements."""
    return F.array_sort(F.array_distinct(F.concat(*[col(p) for p in packs])))


def jexcept(a, b) -> Column:
    """a without b's elements; order and repeats stay."""
    return F.filter(col(a), lambda x: ~F.coalesce(F.array_contains(col(b), x), F.lit(False)))


def jintersection(first, *rest) -> Column:
    out = col(first)
    for p in rest:
        out = F.array_intersect(out, col(p))
    return F.array_sort(F.array_distinct(out))


def jsort(pack) -> Column:
    """Numbers by value, then texts."""
    keyed = F.transform(col(pack), lambda x: F.struct(x.try_cast("double").isNull().alias("t"), x.try_cast("double").alias("n"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def jsplitv(pack) -> Column:
    """One row an element."""
    return F.explode(col(pack))


def jsplit(pack, width: int) -> Column:
    """A struct C1..Cn; NULL where there are fewer."""
    return F.struct(*[F.get(col(pack), i).alias(f"C{i + 1}") for i in range(width)])


def jflatten(text) -> Column:
    """A nested JSON list of any depth as one array of texts."""
    import json

    def flat(x):
        return [z for y in x for z in flat(y)] if isinstance(x, list) else [x if isinstance(x, str) else json.dumps(x)]

    @F.pandas_udf("array<string>")
    def run(s):
        return s.map(lambda t: None if t is None else flat(json.loads(t)) if t.startswith("[") else [t])

    return run(col(text))


def jmergeregexp(pack) -> Column:
    """One regular expression for all elements; without any, one that never matches."""
    parts = F.array_join(F.transform(F.filter(col(pack), lambda x: x != ""), lambda x: F.concat(F.lit("(?:"), x, F.lit(")"))), "|")
    return F.when(parts == "", F.lit("_^")).otherwise(parts)


def jmergeregexpnamed(pack) -> Column:
    """An array of regular expressions of up to 99 groups, elements sorted."""
    a = F.array_sort(col(pack))
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(99)))
    return F.coalesce(F.transform(starts, lambda i: F.array_join(F.transform(F.slice(a, i, 99), lambda x: F.concat(F.lit("("), x, F.lit(")"))), "|")), F.array().cast("array<string>"))


def jdict(*pairs) -> Column:
    """JSON text of key, value, key, value ..."""
    return F.to_json(F.create_map(*[c for k, v in zip(pairs[::2], pairs[1::2], strict=True) for c in (col(k), col(v).cast("string"))]))


def as_map(text) -> Column:
    """A dictionary's text as a map; anything else gives NULL."""
    return F.when(col(text).startswith("{"), F.from_json(col(text), "map<string,string>"))


def jdictkeys(*dicts) -> Column:
    """Keys of all dictionaries, each once, in order."""
    return F.array_distinct(F.concat(*[F.coalesce(F.json_object_keys(F.when(col(d).startswith("{"), col(d))), F.array().cast("array<string>")) for d in dicts]))


def jdictvals(text, *keys: str) -> Column:
    """The values of `keys`, NULL where missing; without keys all values, sorted by value and key."""
    m = as_map(text)
    if keys:
        return F.array(*[m[k] for k in keys])
    pairs = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    return F.transform(pairs, lambda p: p["v"])


def jdictsplit(text, *keys: str) -> Column:
    """A struct with the keys' values."""
    m = as_map(text)
    return F.struct(*[m[k].alias(k) for k in keys])


def jdictsplitv(text, *keys: str) -> Column:
    """An array of (key, val), of `keys` only if given; inline() makes rows of it."""
    pairs = F.transform(F.map_entries(as_map(text)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("val")))
    return F.filter(pairs, lambda p: p["key"].isin(*keys)) if keys else pairs


def jdictgroupkey(text, *keys: str) -> Column:
    """A JSON list of dictionaries grouped by the values of `keys`, nested in that order."""
    import json

    def group(rows, left):
        if not left:
            return rows
        out: dict = {}
        for r in rows:
            out.setdefault(str(r.get(left[0])), []).append({k: v for k, v in r.items() if k != left[0]})
        return {k: group(v, left[1:]) for k, v in out.items()}

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda t: None if t is None else json.dumps(group(json.loads(t), keys), separators=(",", ":"), ensure_ascii=False))

    return run(col(text))


def jsplice(pack, start: int, end: int | None = None) -> Column:
    """The element at `start`, or the elements from it up to `end`; negative places count from the end. Out of range gives NULL or the part that is there."""
    a = col(pack)
    n = F.size(a)
    at = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    if end is None:
        return F.when((F.lit(start) < n) if start >= 0 else (n >= -start), F.get(a, F.lit(start) if start >= 0 else n + start))
    to = F.least(F.lit(end), n) if end >= 0 else n + end
    return F.slice(a, at + 1, F.greatest(to - at, F.lit(0)))


def jcombinations(pack, r: int = 1) -> Column:
    """An array of structs C1..Cr of all combinations, in order of places."""
    return _deep(col(pack), r, lambda last, i: i > last)


def jpermutations(pack, r: int = 1) -> Column:
    """An array of structs C1..Cr of all permutations of r places."""
    return _deep(col(pack), r, None)


def _deep(a: Column, r: int, after) -> Column:
    """Grows lists of places one by one, for arrays of any length."""
    n = F.size(a)
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))
    rows = F.transform(places, lambda i: F.array(i))
    for _ in range(r - 1):
        rows = F.flatten(F.transform(rows, lambda p: F.transform(F.filter(places, lambda i: (i > F.element_at(p, -1)) if after else ~F.array_contains(p, i)), lambda i: F.concat(p, F.array(i)))))
    return F.transform(rows, lambda p: F.struct(*[F.get(a, p[k]).alias(f"C{k + 1}") for k in range(r)]))


def jsonpath(text, *paths: str) -> Column:
    """An array of structs C1..Cn: if all paths ($.a[*].b) find as many values, one struct each, else one struct of packs. No row where all are missing."""
    found = [F.get_json_object(col(text), p) for p in paths]
    lists = [F.when(f.startswith("["), F.from_json(f, "array<string>")).when(f.isNotNull(), F.array(f)) for f in found]
    sizes = F.array(*[F.coalesce(F.size(x), F.lit(-1)) for x in lists])
    equal = F.size(F.array_distinct(sizes)) == 1
    zipped = F.transform(F.arrays_zip(*[x.alias(f"p{i}") for i, x in enumerate(lists)]), lambda r: F.struct(*[r[f"p{i}"].alias(f"C{i + 1}") for i in range(len(paths))]))
    one = F.array(F.struct(*[F.when(F.size(x) == 1, F.get(x, 0)).otherwise(F.to_json(x)).alias(f"C{i + 1}") for i, x in enumerate(lists)]))
    return F.when(F.array_max(sizes) < 0, F.slice(one, 1, 0)).when(equal, zipped).otherwise(one)


# ---------------------------------------------------------------- sets of terms and similarity


def _set(terms) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(col(terms), " ", -1), lambda x: x != "")))


def tset(*texts) -> Column:
    return F.array_join(_set(F.concat_ws(" ", *[col(t) for t in texts])), " ")


def tsetdiff(a, b) -> Column:
    return F.array_join(F.array_sort(F.array_except(_set(a), _set(b))), " ")


def tsetcombinations(text, r: int) -> Column:
    """An array of texts: all r-combinations of the sorted terms."""
    return F.transform(jcombinations(_set(text), r), lambda s: F.concat_ws(" ", *[s[f"C{k + 1}"] for k in range(r)]))


def jaccard(a, b) -> Column:
    """Shared over all elements of two packs; NULL if both are empty."""
    return F.try_divide(F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b))))


def sorensendice(a, b) -> Column:
    x, y = F.array_distinct(col(a)), F.array_distinct(col(b))
    return F.try_divide(2 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y))


def levendist(a, b) -> Column:
    return F.levenshtein(col(a), col(b)).cast("long")


def damlevendist(a, b) -> Column:
    """Edits with swaps of neighbours, none edited twice."""

    def one(x, y):
        if x is None or y is None:
            return None
        before, last, now = None, None, list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            before, last, now = last, now, [i]
            for j, q in enumerate(y, 1):
                best = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (p != q))
                if i > 1 and j > 1 and p == y[j - 2] and x[i - 2] == q:
                    best = min(best, before[j - 2] + 1)
                now.append(best)
        return now[-1]

    @F.pandas_udf("long")
    def run(s, t):
        import pandas as pd

        return pd.Series([one(x, y) for x, y in zip(s, t, strict=True)], dtype="Int64")

    return run(col(a), col(b))


def quickstrdist(a, b) -> Column:
    """Sum over differing stretches of the longer side."""
    from difflib import SequenceMatcher

    def one(x, y):
        if x is None or y is None:
            return None
        return sum(max(i2 - i1, j2 - j1) for op, i1, i2, j1, j2 in SequenceMatcher(None, x, y).get_opcodes() if op != "equal")

    @F.pandas_udf("long")
    def run(s, t):
        import pandas as pd

        return pd.Series([one(x, y) for x, y in zip(s, t, strict=True)], dtype="Int64")

    return run(col(a), col(b))
