"""Registered queries over whole tables, compared with brute force on small ones."""

import hashlib
import re
from collections import Counter
from itertools import combinations

from sparkloom.operators import tables as R
from sparkloom.plans import dialect
from sparkloom.suite import load

QUERIES, SQL = load()


def run(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, str(tmp_path)).collect()}


def references(text):
    """As the reference does it: the window over 5 lines moved a line at a time from the end of the text."""
    if text is None:
        return None
    text = text.replace("\r\n", "\n")
    if text.count("\n") < 10:
        return text
    lines = [x for x in text.split("\n")[10:] if len(x) > 10][::-1]
    year = [bool(re.search(r"(?:\b|_)(?:1[5-9]\d\d|20\d\d)(?:\b|_)", x)) for x in lines]
    near = [sum(True if j < 0 else year[j] if j < len(year) else False for j in range(i - 2, i + 3)) / 5 for i in range(len(year))]
    return "\n".join([x for x, n in zip(lines, near, strict=True) if n >= sum(near) / len(near)][::-1])


def listing(*years):
    return "\n".join([f"line number {i} of the text" for i in range(18)] + [f"An author, a title, {y}, p. 7" for y in years] + ["the end of the text", "short"])


def test_references_of_long_documents(spark, tmp_path):
    texts = ["one line", "", None, "\n" * 12, listing(1914, 2014, 2008, 2005), listing(1914, 2014, 2008, 2005).replace("\n", "\r\n"), listing("_1999_", 12008, "no year", 1850), listing()]
    got = run(spark, tmp_path, "txt_references_all", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert got == {i: (references(x),) for i, x in enumerate(texts)}
    assert "2014" in got[4][0] and "line number 3" not in got[4][0]


def test_references_of_all_years(spark, tmp_path):
    texts = [listing(2023, 1750, 2099, 1500, 2020), listing(1499, 2100, 1499, 2100, 1499), listing(1750, 1914, 2023)]
    got = run(spark, tmp_path, "txt_references_all", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert got == {i: (references(x),) for i, x in enumerate(texts)}
    assert [got[0][0].count(f" {y},") for y in (2023, 1750, 2099, 1500, 2020)] == [1] * 5 and "line number 12" not in got[0][0]


def terms(text):
    if text is None:
        return None, None, None
    words = [x for x in re.findall(r"[\d.]+\b|\w+|\$[\d.]+", text) if x != "."]
    return len(text.split(" ")), len(set(text.split(" ")) - {""}), hashlib.md5(" ".join(words).encode()).hexdigest()


def test_terms_of_any_text(spark, tmp_path):
    texts = ["plain a plain", None, "", "   ", "café naïve café", "πρωτο δευτερο τέταρτο 3.5", "x . $5 b.c 1.5é", "日本語 テキスト", "Straße_9 “quoted” — dash", "ü\nä ü"]
    got = run(spark, tmp_path, "txt_terms_all", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert got == {i: terms(x) for i, x in enumerate(texts)}


def test_itemsets_of_any_length(spark, tmp_path):
    baskets = [(o, i) for o in range(5) for i in range(1, 7)] + [(o, i) for o in range(5, 9) for i in (2, 4, 30 + o)]
    rows = {o: sorted({str(i) for x, i in baskets if x == o}) for o, _ in baskets}
    every = Counter(c for r in rows.values() for k in range(1, len(r) + 1) for c in combinations(r, k))
    want = {c: n for c, n in every.items() if n >= 4}
    assert max(map(len, want)) == 6
    df = spark.createDataFrame(baskets, "o int, i int")
    df.createOrReplaceTempView("baskets")
    for made in (R.freqitemsets(df, "o", "i", 4), dialect.run(spark, "freqitemsets o i 4 SELECT * FROM baskets")):
        assert {tuple(x["items"]): x["itemset_frequency"] for x in made.collect()} == want
    assert max(x["itemset_length"] for x in dialect.run(spark, "freqitemsets o i 4 2 SELECT * FROM baskets").collect()) == 2
    got = run(spark, tmp_path, "mine_freqitemsets_all", "lineitem", baskets, "l_orderkey int, l_suppkey int")
    assert got == {"|".join(c): (len(c), n) for c, n in want.items()}


def test_models_see_the_whole_embedding(spark, tmp_path):
    # alike in dimensions 0-7; dimensions 8-63 tell the four groups, and the two labels
    rows = [(i, [0.5] * 8 + [float(10 * (i % 4) + i // 4 / 100)] * 28 + [float(i % 2)] * 28, i % 2) for i in range(40)]
    made = {name: run(spark, tmp_path, name, "embeddings", rows, "vec_id long, embedding array<float>, label int") for name in ("ml_cluster", "ml_reduce", "ml_train_predict")}
    assert all(sorted(m) == list(range(40)) for m in made.values())
    assert len({made["ml_cluster"][i] for i in range(4)}) == 4 and all(made["ml_cluster"][i] == made["ml_cluster"][i % 4] for i in range(40))
    assert len({round(made["ml_reduce"][i][0], 6) for i in range(40)}) == 40
    assert all(made["ml_train_predict"][i][0] == i % 2 for i in range(40))


def human(seconds):
    (days, rest), text = divmod(seconds, 86400), ""
    for n, name in ((days, "day"), (rest // 3600, "hour")):
        text += f"{n} {name}{'s' if n > 1 else ''} " if n else ""
    return text + (f"{rest % 3600 // 60} min " if rest % 3600 // 60 else "") + (f"{rest % 60} sec" if rest % 60 else "")


def test_human_hours_and_days(spark, tmp_path):
    keys = [0, 1, 499, 500, 515, 3600, 12342, 12343, 12858, 19999, 86400]
    got = run(spark, tmp_path, "date_human_all", "part", [(k,) for k in keys], "p_partkey long")
    assert got == {k: (human(k * 7),) for k in keys}
    assert got[12343] == ("1 day 1 sec",) and got[19999] == ("1 day 14 hours 53 min 13 sec",)


class Turn:
    """Stands for a table of one cell."""

    def __init__(self, value):
        self.value = value

    def first(self):
        return (self.value,)


def test_whilevt_has_no_bound_of_its_own(spark):
    def body(i):
        return Turn(1 if i < 1500 else 0)

    assert [r[0] for r in R.whilevt(spark, body).collect()] == list(range(1500))
    assert [r[0] for r in R.whilevt(spark, body, 3, 4).collect()] == [3, 4, 5, 6]
