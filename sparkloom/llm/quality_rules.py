"""Operator 8: quality rules as a short-circuit cascade, ordered by rejections per cost. Built-in expressions only.

Each rule names the measures it reads. The cascade is a chain of columns: a rule's measures are made
only for texts that no earlier rule has rejected (they stay null for the others), so what a cheap rule
turns away never has its word triples built, its lines parted or its letters counted.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._shared import WORD

#: Rows of the sample that orders the rules, and the characters after which it is enough; it has no say in any verdict.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 16_000_000
#: Runs of a rule over the sample; the fastest counts, in steps of a power of four, so that noise rarely changes the order.
RUNS = 2
SYMBOLS = "#*$%&|<>"
#: Low bits of a packed number that say where a word triple begins; the others are of its hash.
PLACE_BITS = 31


@dataclass(frozen=True)
class Rule:
    """`rejects` gives, from the columns of the measures in `needs`, what is true for a text that the rule turns away."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Callable[[str], Column]], Column]


def _suspects(m: Callable[[str], Column]) -> Column:
    """Places of the word triples that share 33 bits of hash with a neighbour in sorted order: all that are found twice, and a few more."""
    packed = m("packed")
    top = lambda x: F.shiftrightunsigned(x, PLACE_BITS)
    return F.filter(packed, lambda x, j: F.coalesce(top(x) == top(F.get(packed, j + 1)), F.lit(False)) | F.coalesce(top(x) == top(F.get(packed, j - 1)), F.lit(False)))


def _triples(m: Callable[[str], Column]) -> Column:
    """The suspects as (a, b, c, i), sorted by their words."""
    words = m("words")
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")).cast("int")
    return F.sort_array(F.transform(m("suspects"), lambda x: F.struct(F.get(words, place(x)).alias("a"), F.get(words, place(x) + 1).alias("b"), F.get(words, place(x) + 2).alias("c"), place(x).alias("i"))))


def _packed(m: Callable[[str], Column]) -> Column:
    words = m("words")
    high = F.lit(-(1 << PLACE_BITS)).cast("long")
    triple = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))
    return F.when(F.size(words) >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), triple)))


def _starts(m: Callable[[str], Column]) -> Column:
    """Places of the triples found twice, ascending."""
    s = m("triples")
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    twin = F.transform(s, lambda x, j: F.when(F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j - 1)), F.lit(False)), x["i"]))
    return F.sort_array(F.array_compact(twin))


def _covered(m: Callable[[str], Column]) -> Column:
    """Words that lie in a triple found twice."""
    fresh = F.struct(F.lit(-3).alias("p"), F.lit(0).alias("n"))
    n = F.aggregate(m("starts"), fresh, lambda a, i: F.struct(i.alias("p"), (a["n"] + F.least(F.lit(3), i - a["p"])).alias("n")), lambda a: a["n"])
    return F.coalesce(n, F.lit(0)).cast("long")


def _without(m: Callable[[str], Column], chars: str) -> Column:
    return F.length(F.translate(m("text"), chars, ""))


#: name -> (measures that it reads, expression). `text` is given.
MEASURES: dict[str, tuple[tuple[str, ...], Callable[[Callable[[str], Column]], Column]]] = {
    "words": (("text",), lambda m: F.regexp_extract_all(m("text"), F.lit(WORD), F.lit(0))),
    "n_words": (("words",), lambda m: F.size(m("words")).cast("long")),
    "word_chars": (("text",), lambda m: _without(m, " \t\n\x0b\x0c\r").cast("long")),
    "n_symbols": (("text",), lambda m: (F.length(m("text")) - _without(m, SYMBOLS)).cast("long")),
    "lines": (("text",), lambda m: F.filter(F.split(m("text"), "\n", -1), lambda x: x.rlike(WORD))),
    "n_lines": (("lines",), lambda m: F.size(m("lines")).cast("long")),
    "n_dup_lines": (("lines",), lambda m: (F.size(m("lines")) - F.size(F.array_distinct(m("lines")))).cast("long")),
    "packed": (("words",), _packed),
    "suspects": (("packed",), _suspects),
    "triples": (("words", "suspects"), _triples),
    "starts": (("triples",), _starts),
    "n_repeat_words": (("starts",), _covered),
    "upper": (("text",), lambda m: F.length(m("text")) - F.length(F.regexp_replace(m("text"), "\\p{Lu}+", ""))),
    "letters": (("text",), lambda m: F.length(m("text")) - F.length(F.regexp_replace(m("text"), "\\p{L}+", ""))),
}


def default_rules() -> list[Rule]:
    """Limits wide enough that plain prose in any of the languages passes. The first two are the base: too short, or over half of the words in word triples found twice or more."""
    return [
        Rule("short", ("n_words",), lambda m: m("n_words") < 50),
        Rule("repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
        Rule("symbols", ("n_words", "n_symbols"), lambda m: m("n_symbols") * 4 > m("n_words")),
        Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda m: m("n_dup_lines") * 2 > m("n_lines")),
        Rule("word_length", ("n_words", "word_chars"), lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
        Rule("shouting", ("upper", "letters"), lambda m: m("upper") * 2 > F.greatest(m("letters"), F.lit(1))),
        Rule("letters", ("letters", "word_chars"), lambda m: m("letters") * 2 < m("word_chars")),
    ]


class Cascade:
    """Rows `row` (the input's, packed, so that its names clash with nothing), `text` and measures; grows by a layer of columns at a time."""

    def __init__(self, df: DataFrame, text: str):
        packed = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in df.columns])
        self.df = df.select(packed.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
        self.known = {"text"}

    def measure(self, names: tuple[str, ...], alive: Column | None = None) -> None:
        """Adds the measures that are not there yet; where `alive` is false they are null and not computed."""
        for name in names:
            if name in self.known:
                continue
            needs, made = MEASURES[name]
            self.measure(needs, alive)
            value = made(F.col)
            self.df = self.df.withColumn(name, value if alive is None else F.when(alive, value))
            self.known.add(name)

    def judge(self, rules: list[Rule], lazily: bool) -> None:
        """Adds `kept`: no rule rejects. Lazily: a rule's measures are made for texts that passed all earlier ones."""
        self.df = self.df.withColumn("alive0", F.lit(True))
        alive = F.lit(True)
        for i, rule in enumerate(rules, 1):
            self.measure(rule.needs, alive if lazily else None)
            self.df = self.df.withColumn(f"alive{i}", F.when(alive, ~F.coalesce(rule.rejects(F.col), F.lit(False))).otherwise(F.lit(False)))
            alive = F.col(f"alive{i}")
        # a filter over deterministic columns would be pushed below the layers and expand them inside the lambdas that read them
        self.df = self.df.withColumn("kept", F.when(F.monotonically_increasing_id() >= 0, alive))


def order_rules(df: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejections per cost, both measured on a sample of `rows` whole texts at most.

    A rule's cost is the time of a job over the sample that computes it alone, less that of a job
    that computes nothing. The order changes what is computed, never the verdict. An empty sample
    leaves the order as it is. Texts are taken from the first partitions, one partition after the
    other, until there are `rows` of them or SAMPLE_CHARS characters; no other partition is read.
    """
    picked, held = [], 0
    for r in df.select(F.col(f"`{text}`").alias("text")).sample(0.1, seed=7).toLocalIterator():
        picked.append(r)
        held += len(r["text"] or "")
        if len(picked) >= rows or held >= SAMPLE_CHARS:
            break
    if not picked:
        return rules
    sample = df.sparkSession.createDataFrame(picked, "text string").coalesce(1)

    def took(rule: Rule | None) -> tuple[float, int]:
        made = Cascade(sample, "text")
        if rule:
            made.measure(rule.needs)
        rejects = rule.rejects(F.col) if rule else F.col("text").isNull()
        job, best, hits = made.df.agg(F.count(F.when(rejects, 1)).alias("n")), float("inf"), 0
        for _ in range(RUNS):
            began = time.perf_counter()
            hits = job.first()["n"]
            best = min(best, time.perf_counter() - began)
        return best, hits

    floor, _ = took(None)
    timed: list[tuple[float, int, Rule]] = []
    for i, rule in enumerate(rules):
        seconds, hits = took(rule)
        # powers of four of 15 ms
        cost = 4 ** max(0, round(math.log(max(seconds - floor, 1e-3) / 0.015, 4)))
        timed.append((-hits / cost, i, rule))
    return [rule for *_, rule in sorted(timed, key=lambda x: x[:2])]


def keep_good(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of df whose text passes every rule, with df's columns, whatever their names.

    Null and empty texts have no words and go; repeated rows fare alike; an empty table stays empty;
    texts of any length are read whole.
    """
    made = Cascade(df, text)
    made.judge(order_rules(df, default_rules(), text) if rules is None else rules, lazily=True)
    return made.df.where("kept").select(*[F.col(f"row.`{c}`") for c in df.columns])


def judged(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the base measures, base_failed and the cascade's verdict of every row of df.

    A null or empty text has no words and fails; repeated rows get equal answers; an empty table
    gives an empty one; texts of any length are read whole; other columns are not read.
    """
    docs = df.select("doc_id", F.col(f"`{text}`").alias("text"))
    made = Cascade(docs, "text")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    made.measure(base)
    # the base measures are asked for in every row; what else the rules read is made for those still alive
    made.judge(order_rules(docs, default_rules()), lazily=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return made.df.select(F.col("row.doc_id").alias("doc_id"), *base, failed.alias("base_failed"), "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, the base rule and the cascade's verdict for every document."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT doc_id, t, w, len(w) AS n,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: [w[i], w[i + 1], w[i + 2]]) AS g,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS upper_n,
    length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS letter_n
  FROM d
), e AS (
  SELECT rowid_, i, g[i] AS tri FROM (SELECT row_number() OVER () AS rowid_, doc_id, g, n FROM m), unnest(range(1, len(g) + 1)) AS u(i)
), k AS (SELECT *, row_number() OVER () AS rowid_ FROM m
), twice AS (
  SELECT rowid_, i FROM (SELECT rowid_, i, count(*) OVER (PARTITION BY rowid_, tri) AS c FROM e) WHERE c > 1
), cover AS (
  SELECT rowid_, count(DISTINCT p) AS r FROM (SELECT rowid_, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rowid_
), f AS (
  SELECT k.*, coalesce(r, 0) AS r, len(lines) - len(list_distinct(lines)) AS dup FROM k LEFT JOIN cover USING (rowid_)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(dup AS BIGINT) AS n_dup_lines, CAST(r AS BIGINT) AS n_repeat_words,
  (n < 50 OR 100 * r > 50 * n) AS base_failed,
  NOT (n < 50 OR 100 * r > 50 * n OR n_symbols * 4 > n OR dup * 2 > len(lines) OR word_chars < 2 * n OR word_chars > 20 * n
    OR upper_n * 2 > greatest(letter_n, 1) OR letter_n * 2 < word_chars) AS kept
FROM f
"""
