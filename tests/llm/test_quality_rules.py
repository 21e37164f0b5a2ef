import random
import re
import unicodedata
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.llm.quality_rules import MEASURES, ORACLE_SQL, Cascade, default_rules, judged, keep_good, op8_quality_rules, order_rules

SF = "/root/testdata/sf0.01"


def measured(text):
    """The measures by plain loops."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, x in enumerate(triples) if triples.count(x) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "é\x85b  c\x0bd", "x\n\nx\n x\nx"]
    for letters in ("ab", "abcdé", "ab\n #", "a b"):
        out += ["".join(rng.choice([*letters, " ", "\n"]) for _ in range(rng.randrange(150))) for _ in range(40)]
    return out + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(400)), "word " * 3000]


def test_measures_equal_brute_force(spark):
    cases = texts()
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in judged(df).collect()}
    assert got == {i: measured(t) for i, t in enumerate(cases)}


def test_clashing_hashes_do_not_count(spark, monkeypatch):
    """With no bits of hash left every triple is suspected of equalling its neighbour; the words decide."""
    cases = texts()
    monkeypatch.setitem(MEASURES, "suspects", (("packed",), lambda m: m("packed")))
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in judged(df).collect()} == {i: measured(t)[4] for i, t in enumerate(cases)}


def test_order_of_rules_never_changes_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    rules = default_rules()
    ways = [rules, rules[::-1], order_rules(docs, rules)]
    seen = []
    for way in ways:
        for lazily in (True, False):
            made = Cascade(docs, "text")
            made.judge(way, lazily)
            seen.append({r["doc_id"]: r["kept"] for r in made.df.select("row.doc_id", "kept").collect()})
    assert all(x == seen[0] for x in seen) and {r.name for r in ways[2]} == {r.name for r in rules}


def test_what_a_cheap_rule_rejects_builds_no_triples(spark, monkeypatch):
    needs, made = MEASURES["packed"]
    loud = lambda m: F.when(F.col("n_words") < 50, F.raise_error(F.lit("triples of a short text"))).otherwise(made(m))
    monkeypatch.setitem(MEASURES, "packed", (needs, loud))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = default_rules()
    kept = keep_good(docs, rules=rules).count()
    assert 0 < kept < docs.count()
    with pytest.raises(Exception, match="triples of a short text"):
        keep_good(docs, rules=[rules[0], *rules[2:], rules[1]][::-1]).count()
    one = Cascade(docs, "text")
    one.judge(rules, lazily=True)
    # looked at without a filter, which would be pushed below the columns
    built = one.df.selectExpr("n_words", "packed IS NOT NULL OR suspects IS NOT NULL OR lines IS NOT NULL OR upper IS NOT NULL AS built").collect()
    assert not any(r["built"] for r in built if r["n_words"] < 50) and any(r["built"] for r in built)


def test_very_long_text(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(200_000)) + " one two three one two three"
    df = spark.createDataFrame([(1, text), (2, "x" * 1_200_000)], "doc_id long, text string")
    assert len(text) > 1_000_000
    got = {r["doc_id"]: (r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in judged(df).collect()}
    ws = text.split()
    seen = Counter(zip(ws, ws[1:], ws[2:]))
    inside = {i + k for i, x in enumerate(zip(ws, ws[1:], ws[2:])) if seen[x] > 1 for k in range(3)}
    assert got == {1: (len(ws), len(inside), False), 2: (1, 0, True)}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL).df()
    got = op8_quality_rules(spark, SF).toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").reset_index(drop=True).astype(str).equals(want.sort_values("doc_id").reset_index(drop=True).astype(str))


def test_good_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in keep_good(docs).select("doc_id").collect()}
    short = {r["doc_id"] for r in docs.collect() if (m := measured(r["text"]))[0] < 50 or 100 * m[4] > 50 * m[0]}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()} - short
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert good <= kept and len(bad & kept) < 0.1 * len(bad)


def test_columns_nulls_and_empty(spark):
    rows = [(1, None, 1, "a"), (1, None, 1, "a"), (2, "plain words " * 9 + " ".join(unicodedata.name(chr(c), "w") for c in range(97, 123)), 2, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _q_words int, `k.x` string").withColumn("alive1", F.lit(1)).withColumn("words", F.lit("w"))
    got = keep_good(df)
    assert got.columns == df.columns and got.count() <= 1 and keep_good(df.limit(0)).count() == 0
