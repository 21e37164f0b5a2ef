"""Cases of larger or odder tables: dictionaries of big groups, texts without terms, windows, graphs and item sets."""

import random
import unicodedata

import duckdb
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import aggregates as A
from sparkloom.operators import tables as R
from sparkloom.suite import load

QUERIES, SQL = load()


def test_dictionaries_of_big_groups(spark):
    # 40,000 rows of a group: it took the square of them, and a NULL key lost those before it
    df = spark.range(40_000).selectExpr("id % 2 AS g", "id AS o", "IF(id % 7 = 0, NULL, 'k' || id % 300) AS k", "IF(id % 11 = 0, NULL, id) AS v")
    want = {0: {}, 1: {}}
    for i in range(40_000):
        if i % 7:
            want[i % 2][f"k{i % 300}"] = None if i % 11 == 0 else i
    assert {r["g"]: r["dict"] for r in R.jdictgroup(df, ["g"], "k", "v", "o").collect()} == want
    assert {r["g"]: r["d"] for r in df.groupBy("g").agg(A.jdictgroup("k", "v", "o").alias("d")).collect()} == want


def test_texts_without_terms_agree_with_sql(spark, tmp_path):
    texts = ["", " ", "   ", "a", " a ", "\t", ".", ".. a", "$5. b", "a\nb a", None, "é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(con.execute(f"SELECT doc_id, kwnum, n_unique, keywords_md5 FROM ({SQL['txt_terms']})").fetchall())
    got = QUERIES["txt_terms"](spark, str(tmp_path)).select("doc_id", "kwnum", "n_unique", "keywords_md5")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 10


def windows(times, seconds):
    """(wid, places) by the definition, row after row."""
    out, head, wid = [], 0, 0
    for i, t in enumerate(times):
        if t is None or t <= times[head] + seconds:
            continue
        if wid == 0:
            out += [(0, j) for j in range(head, i)]
        while head < i and t > times[head] + seconds:
            head += 1
        wid += 1
        out += [(wid, j) for j in range(head, i + 1)]
    return out or [(0, j) for j in range(len(times))]


def test_time_windows_of_many_groups(spark):
    # groups over many Arrow batches, one of them larger than a batch, NULL keys and times; the plan gives no group a call of its own
    rng = random.Random(5)
    groups = {g: sorted(rng.sample(range(4000), rng.randint(1, 40))) for g in [None, *range(900)]} | {1000: sorted(rng.sample(range(400_000), 12_500)), 1001: [0, 5, None], 1002: [None], 1003: [0, 500, None]}
    rows = [(g, i, t) for g, times in groups.items() for i, t in enumerate(times)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, i int, t int").select("g", "i", F.timestamp_seconds("t").alias("ts"))
    made = R.timeslidingwindow(df, ["g"], "ts", 300)
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
    got: dict = {}
    for r in made.collect():
        got.setdefault(r["g"], []).append((r["wid"], r["i"]))
    assert {g: sorted(x) for g, x in got.items()} == {g: windows(times, 300) for g, times in groups.items()}


def test_power_hashes_of_many_graphs(spark):
    # 3,000 graphs in few forms, one of 12,000 edges, nodes that are NULL: alike where isomorphic; the plan gives no graph a call of its own
    rng = random.Random(6)
    forms = [[("a", "b")], [("a", "b"), ("b", "c")], [("a", "b"), ("c", "b")], [("a", "a"), (None, "a")], [("a", "b"), ("a", "b")]]
    rows = []
    for g in range(3000):
        nodes = dict(zip("abc", rng.sample("pqrstu", 3), strict=True)) | {None: None}
        rows += [(g, nodes[u], nodes[v]) for u, v in rng.sample(forms[g % 5], len(forms[g % 5]))]
    rows += [(3000, f"x{i}", f"x{i + 1}") for i in range(12_000)]
    made = R.graphpowerhash(spark.createDataFrame(rows, "g int, a string, b string"), ["g"], "a", "b", 2)
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
    got = {r["g"]: r["hash"] for r in made.collect()}
    assert len(got) == 3001 and len(set(got.values())) == 6 and all(got[g] == got[g % 5] for g in range(3000))


def sizes_of_batches(made):
    """How the plan sends rows to Python: by Arrow batches of 10,000 rows, however long their texts, or by 100."""
    plan = made._jdf.queryExecution().executedPlan().toString()
    return [x for x in ("ArrowEvalPython", "BatchEvalPython") if x in plan]


def test_references_go_to_python_by_few_rows(spark):
    texts = [None, "", "a\r\nb", "\n".join(f"line number {i} of the text, {1900 + i}" for i in range(30))]
    made = spark.createDataFrame([(x,) for x in texts], "t string").select("t", X.textreferences("t").alias("r"))
    assert sizes_of_batches(made) == ["BatchEvalPython"]
    got = dict(map(tuple, made.collect()))
    assert got[None] is None and got[""] == "" and got["a\r\nb"] == "a\nb" and "number 9 " not in got[texts[3]] and got[texts[3]].endswith("1929")


def test_unicode_goes_to_python_by_few_rows(spark):
    texts = [None, "", "tab\t\\ \\u00e9", "é é 中 \U0001f600 \x00\x7f"]
    made = spark.createDataFrame([(x,) for x in texts], "t string").select("t", X.unitosuni("t").alias("s"), X.sunitouni(X.unitosuni("t")).alias("b"), X.normuni("t").alias("n"), X.sunitouni(F.lit("\\u12")).alias("broken"))
    assert sizes_of_batches(made) == ["BatchEvalPython"]
    want = [(t, None, None, None, "\\u12") if t is None else (t, t.encode("unicode_escape").decode(), t, unicodedata.normalize("NFC", t), "\\u12") for t in texts]
    assert list(map(tuple, made.collect())) == want


def test_itemsets_are_shuffled_by_their_rows(spark, monkeypatch):
    # each level is laid out by the number of its rows, which is known before it is made; the setting comes back
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    seen, made = [], R._partitions

    def watched(s, rows):
        seen.append(rows)
        return made(s, rows)

    monkeypatch.setattr(R, "_partitions", watched)
    baskets = spark.range(1000).selectExpr("id AS o", "explode(array('a', 'b', 'c', 'd' || id)) AS i")
    got = {tuple(r["items"]): (r["itemset_length"], r["itemset_frequency"]) for r in R.freqitemsets(baskets, "o", "i", 1000).collect()}
    assert got == {tuple(x): (len(x), 1000) for x in ("a", "b", "c", "ab", "ac", "bc", "abc")}
    assert seen == [4000, 3000, 1000, 0] and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert R.freqitemsets(baskets, "o", "i", 1000, 2).count() == 6


def test_cliques_by_blocks_of_edges(spark, monkeypatch):
    # several blocks, names and numbers alike; no wedge is shuffled, so the plan of triangles has no join
    monkeypatch.setattr(R, "BLOCK_EDGES", 300)
    rng = random.Random(7)
    edges = [(u, v) for u in range(60) for v in range(u) if rng.random() < 0.4] + [(100, n) for n in range(60)] + [(100 + 3 * i + j, 100 + 3 * i + k) for i in range(300) for j, k in ((1, 2), (1, 3), (2, 3))]
    df = spark.createDataFrame(edges + edges[:9] + [(5, 5), (None, 3)], "a long, b long")
    near: dict = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    want, stack = set(), [(frozenset(), frozenset(near), frozenset())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x and len(r) > 2:
            want.add(tuple(sorted(map(str, r))))
        for n in list(p):
            stack.append((r | {n}, p & near[n], x & near[n]))
            p, x = p - {n}, x | {n}
    for given in (df, df.select(*[F.col(c).cast("string").alias(c) for c in "ab"]), df.select(F.col("a") - 200, F.col("b") - 200).toDF("a", "b")):
        low = -200 if given.dtypes[0][1] == "bigint" and given.agg(F.min("a")).first()[0] < 0 else 0
        got: dict = {}
        for r in R.graphcliques(given, "a", "b").collect():
            got.setdefault(r["cliqueid"], []).append(r["nodeid"])
        # numbered in the order of their sorted members
        assert [tuple(sorted(got[i])) for i in range(len(got))] == sorted(tuple(sorted(str(int(m) + low) for m in c)) for c in want)
    inner = R._triangles(df.selectExpr("CAST(least(a, b) AS INT) AS u", "CAST(greatest(a, b) AS INT) AS v").where("u < v").distinct())
    assert "Join" not in inner._jdf.queryExecution().optimizedPlan().toString()
