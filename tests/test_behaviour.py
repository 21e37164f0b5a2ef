"""Cases that the tables don't hold: nulls, ties, empty tables, quirks, files, the dialect, streams."""

import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import packs as P
from sparkloom.functions import text as X
from sparkloom.functions import values as V
from sparkloom.operators import aggregates as A
from sparkloom.operators import tables as R
from sparkloom.plans import dialect
from sparkloom.plans.flow import statements
from sparkloom.sources import files as S
from sparkloom.streaming import sessions as W


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_text(spark):
    lit = F.lit
    assert one(spark, X.regexpr("(a)(b)?", lit("xa"))) == '["a",""]' and one(spark, X.regexpr("z", lit("x"))) is None and one(spark, X.regexpr("x", lit("x"))) == "1"
    assert one(spark, X.hashmd5mod(lit(65), divisor=10**6)) == int(one(spark, F.md5(lit("65").cast("binary"))), 16) % 10**6
    assert one(spark, X.normalizetext(lit("first(second)   third"))) == "first_second_ third"
    assert one(spark, X.cqlfields(lit('(title all "a") and (creator all "b")'))) == "title creator"
    assert one(spark, X.filterstopwords(lit("this and wood NO more"))) == "wood NO more"
    assert one(spark, X.strsplitv(lit('a,"b,c",d'), ",")) == ["a", "b,c", "d"]
    assert one(spark, X.unitosuni(lit("é"))) == "\\xe9" and one(spark, X.sunitouni(lit("\\u03b1"))) == "α"
    assert one(spark, X.kwnum(lit(""))) == 1 and one(spark, X.keywords(lit("a . $5 b.c"))) is not None


def test_packs(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, P.pack_text(a("x"))) == "x" and one(spark, P.pack_text(a("[x"))) == '["[x"]' and one(spark, P.unpack(F.lit(""))) == []
    assert one(spark, P.jsplice(a("a", "b", "c"), -2, 3)) == ["b", "c"] and one(spark, P.jsplice(a("a"), 4)) is None
    assert one(spark, P.jcombinations(a("a", "b", "c"), 2)) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert one(spark, P.jflatten(F.lit('[["a",[1]],"b"]'))) == ["a", "1", "b"]
    assert one(spark, P.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) is None
    assert one(spark, P.damlevendist(F.lit("ab"), F.lit("ba"))) == 1 and one(spark, P.quickstrdist(F.lit("abc"), F.lit("axc"))) == 1
    assert one(spark, P.jngrams(F.lit("a b c"), 2)) == [["a", "b"], ["b", "c"]] and one(spark, P.jngrams(F.lit("a"), 2)) == []
    assert one(spark, P.jdictvals(F.lit('{"b":"1","a":"2"}'))) == ["1", "2"]


def test_values(spark):
    lit = F.lit
    assert one(spark, V.dateformat(lit("32-01-09"))) is None and one(spark, V.dateformat(lit("28-01-09"))) == "2009-01-28"
    assert one(spark, V.sectohuman(lit(93785))) == "1 day 2 hours 3 min 5 sec"
    assert one(spark, V.ip2long(lit("1.2.3.256"))) is None and one(spark, V.ip2long(lit("123.123.123.123"))) == 2071690107
    assert one(spark, V.htmlstriptags(lit("a<br>b<sup>3</sup><x>"))) == "a\nb_3 "
    assert [V.stem_word(w) for w in ("caresses", "ponies", "running", "relational", "hopeful", "cats", "agreed")] == ["caress", "poni", "run", "relat", "hope", "cat", "agre"]
    u = one(spark, V.urlsplit(lit("http://www.test.com/apath/bpath/fname.pdf")))
    assert (u["scheme"], u["netloc"], u["path"], u["filename"], u["type"], u["subtype"]) == ("http", "www.test.com", "/apath/bpath/", "fname.pdf", "application", "pdf")
    assert one(spark, V.farith(lit("/ 1 3"))) == "[1,3]" and one(spark, V.farith(lit("/ 1 0"))) is None
    assert one(spark, V.register_pyfun("f", lambda a: a / 0, "double", True)(lit(1.0))) is None


def test_aggregates_over_nothing_and_ties(spark):
    e = spark.createDataFrame([], "a double, b double, t timestamp, s string")
    r = e.agg(A.median("a").alias("m"), A.pearson("a", "b").alias("p"), A.frecencyindex("t", F.current_date()).alias("f"), A.fsum("a").alias("s"), A.concatgroup("s", "a").alias("c")).first()
    assert (r["m"], r["p"], r["f"], r["s"], r["c"]) == (None, None, 0.0, "[0,1]", "")
    d = spark.createDataFrame([(1.0, "x", 1), (1.0, "y", 0), (None, "z", 2), (0.0, "w", 3)], "a double, b string, o int")
    r = d.agg(A.minrow("a", "b", "o").alias("lo"), A.maxrow("a", "b").alias("hi"), A.median("a").alias("m"), A.variance("a").alias("v")).first()
    assert (r["lo"], r["hi"], r["m"]) == ("z", "y", 1.0) and r["v"] == pytest.approx(1 / 3)


def test_tables_edges(spark):
    e = spark.createDataFrame([(1, 5, "a"), (1, 6, "a"), (1, 7, "b"), (2, 9, None)], "g int, o int, k string")
    runs = {(r["g"], r["compid"], r["repetition"]) for r in R.groupdiff(e, ["g"], "k", ["o"], []).collect()}
    assert runs == {(1, "a", 2), (1, "b", 1), (2, None, 1)}
    assert [r["rowid"] for r in R.rowidvt(e, ["o"]).orderBy("o").collect()] == [1, 2, 3, 4]
    assert R.rowidvt(e.limit(0), ["o"]).count() == 0 and R.slidingwindow(e.limit(0), ["o"], 2).count() == 0
    cliques = R.graphcliques(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 3), (5, 6), (2, 1)], "a int, b int"), "a", "b").collect()
    assert {(r["cliqueid"], r["nodeid"]) for r in cliques} == {(0, "1"), (0, "2"), (0, "3"), (1, "3"), (1, "4"), (1, "5")}
    h = {r["g"]: r["hash"] for r in R.graphpowerhash(spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (2, "x", "y"), (2, "y", "z"), (3, "x", "y"), (3, "z", "y")], "g int, a string, b string"), ["g"], "a", "b").collect()}
    assert h[1] == h[2] != h[3]
    items = R.freqitemsets(spark.createDataFrame([(i, x) for i in range(3) for x in "abc"] + [(9, "a"), (9, "")], "r int, i string"), "r", "i", 3).collect()
    assert {("".join(r["items"]), r["itemset_frequency"]) for r in items} == {("a", 4), ("b", 3), ("c", 3), ("ab", 3), ("ac", 3), ("bc", 3), ("abc", 3)}
    p = spark.createDataFrame([(float(x),) for x in range(-5, 20)] + [(None,)], "p double")
    i = spark.createDataFrame([(0.0, 3.5), (2.0, 2.0), (9.0, 1.0), (None, 1.0), (-4.2, 12.0)], "lo double, hi double")
    plain = p.join(i, F.expr("p BETWEEN lo AND hi")).collect()
    assert sorted(map(tuple, R.range_join(p, "p", i, "lo", "hi", 2.5).collect())) == sorted(map(tuple, plain))


def test_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b\n1,"x,y"\nnull,z\n1,2,3\n')
    assert [tuple(r) for r in S.file(spark, str(path), ",", header=True, strict=0).collect()] == [("1", "x,y"), (None, "z")]
    assert S.file(spark, str(path), ",", header=True, strict=-1).first()["contents"] == "1,2,3"
    with pytest.raises(Exception, match="expected 2 columns"):
        S.file(spark, str(path), ",", header=True).collect()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.txt", "l1\nl2\n")
    assert [r["line"] for r in S.ziplines(spark, str(tmp_path / "a.zip")).collect()] == ["l1", "l2"]
    with sqlite3.connect(tmp_path / "a.db") as c:
        c.execute("CREATE TABLE t (a INTEGER, b TEXT, c REAL)")
        c.execute("INSERT INTO t VALUES (1, 'x', 2.5), (NULL, NULL, NULL)")
    assert {tuple(r) for r in S.sqlite(spark, str(tmp_path / "a.db"), "SELECT * FROM t").collect()} == {(1, "x", 2.5), (None, None, None)}
    assert S.dirfiles(spark, str(tmp_path)).count() == 3
    assert S.html_tables("<table><tr><td>a<td>b</tr><tr><td>c</table>") == [[["a", "b"], ["c"]]]


def test_dialect_and_statements(spark):
    assert statements(["-- no", "select ';';", "select 2", ";"]) == ["select ';'", "select 2"]
    with pytest.raises(ValueError, match="unfinished"):
        statements(["select 1"])
    assert dialect.run(spark, "coltypes select 1 as a").first()["type"] == "int"
    with pytest.raises(ValueError, match="query"):
        dialect.run(spark, "sample 3")
    with pytest.raises(KeyError):
        dialect.run(spark, "select %{nothing}")


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:00:05", "a"), ("2024-01-01 00:01:00", "a"), ("2024-01-01 02:00:00", "b")]
    spark.createDataFrame(rows, "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    q = W.sessions(stream, "t", "10 seconds", "1 minute", ["k"], [F.count(F.lit(1)).alias("n")]).writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["k"], r["n"]) for r in spark.table("sess").collect()) == [("a", 1), ("a", 2)]
