"""Cases that went wrong once: numbering at size, clique wedges, hashes, dates, logs and headers."""

import base64
import hashlib
import itertools
import json
import random

from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import values as V
from sparkloom.operators import tables as R
from sparkloom.sources import files as S


def test_rowid_of_three_million_rows(spark):
    df = spark.range(3_000_000).selectExpr("id", "IF(id % 3 = 0, -1, CAST(rand(3) * 100000 AS LONG)) AS k")
    for _ in range(2):
        got = R.rowidvt(df, ["k"])
        seen = got.agg(F.count("*").alias("n"), F.countDistinct("rowid").alias("d"), F.min("rowid").alias("a"), F.max("rowid").alias("z"), F.countDistinct("id").alias("i")).first()
        assert tuple(seen) == (3_000_000, 3_000_000, 1, 3_000_000, 3_000_000)
    later = got.select("k", (F.lead("k").over(R.Window.orderBy("rowid")) < F.col("k")).alias("down")).where("down")
    assert later.isEmpty()


def test_rowid_of_odd_tables(spark):
    df = spark.createDataFrame([(2, "a"), (None, "b"), (2, "a"), (1, None)], "`a.b` int, _pid string")
    df = df.withColumnRenamed("_pid", "x y")
    got = R.rowidvt(df.withColumnRenamed("a.b", "k"), ["k"]).collect()
    assert sorted(r["rowid"] for r in got) == [1, 2, 3, 4] and {r["rowid"] for r in got if r["k"] is None} == {1}
    assert R.rowidvt(df.limit(0).withColumnRenamed("a.b", "k"), ["k"]).count() == 0


def test_windows_over_many_rows(spark):
    got = R.slidingwindow(spark.range(600_000), ["id"], 3)
    assert got.count() == 3 * 600_000 - 3
    sizes = got.groupBy("wid").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    assert sizes.where("n <> least(3, wid + 1) OR m <> wid").isEmpty()


def maximal(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    found = set()
    for n in range(3, 8):
        for c in itertools.combinations(sorted(near), n):
            if all(b in near[a] for a, b in itertools.combinations(c, 2)) and not any(set(c) <= near[x] for x in near):
                found.add(c)
    return sorted(found)


def test_cliques_with_a_hub(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(14)]
    edges = [("hub", n) for n in names] + [(a, b) for a, b in itertools.combinations(names, 2) if rng.random() < 0.35]
    df = spark.createDataFrame(edges + edges[:5] + [("hub", "hub")], "a string, b string")
    got = {}
    for r in R.graphcliques(df, "a", "b").collect():
        got.setdefault(r["cliqueid"], []).append(r["nodeid"])
    assert [tuple(sorted(got[i])) for i in sorted(got)] == maximal(edges)


def test_power_hash_by_hand(spark):
    """A path of three nodes: digests by the definition, sorted as bytes, in as many rounds as the bound says."""
    md5 = lambda b: hashlib.md5(b).digest()
    near = {1: [(2, b"1")], 2: [(1, b"0"), (3, b"1")], 3: [(2, b"0")]}
    state = {n: md5(f"{len(x)}\x1f\x1e".encode()) for n, x in near.items()}
    for _ in range(R._rounds([1, 2, 1])):
        state = {n: md5(f"{len(x)}\x1f\x1e".encode() + b"\x1e".join(sorted(state[m] + b"\x1d" + t for m, t in x))) for n, x in near.items()}
    want = json.dumps([base64.b64encode(h).decode()[:22] for h in sorted(state.values())], separators=(",", ":"))
    df = spark.createDataFrame([("g", 1, 2), ("g", 2, 3)], "g string, a int, b int")
    assert R.graphpowerhash(df, ["g"], "a", "b").first()["hash"] == want
    assert [R._rounds([2] * n) for n in (1, 3, 10)] == [0, 1, 5]


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def test_fields_hashes_dates_and_logs(spark):
    assert one(spark, X.cqlfields(F.lit("issn all 5 and type all x person all y title all z"))) == "issn type title"
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert one(spark, X.hashmd5(F.lit("ab'c"))) == md5("u'ab\\'c'") and one(spark, X.hashmd5(F.lit(5))) == md5("5")
    cases = {"2007-12-31": "2007-12-31T00:00:00+00:00", "2010-01-01": "2010-01-01T00:00:00+00:00", "2010W06": "2010-02-05T00:00:00+00:00", "18/Jan/2011:11:13:00 +0100": "2011-01-18T11:13:00+01:00", "2011-01-18T11:13:00Z": "2011-01-18T11:13:00+00:00", "2011-01-18 11:13": "2011-01-18T11:13:00+00:00", "5 March 2012": "2012-03-05T00:00:00+00:00", "what": None, "Mon, 5 Mar 2012 10:00:00 GMT": "2012-03-05T10:00:00+00:00"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", V.date2iso("t").alias("d")).collect()} == cases
    got = one(spark, V.apachelogsplit(F.lit('1.1.1.1 - - [01/Feb/2001:01:02:03 +0001] "HEAD /test.com HTTP/1.1" 200 - "-" "reftest"')))
    assert tuple(got) == ("1.1.1.1", None, None, "2001-02-01T01:02:03+0001", "HEAD", "/test.com", "1.1", 200, None, None, "reftest")


def test_only_first_lines_are_headers(spark, tmp_path):
    for name, lines in (("a.csv", "a,b\n1,2\na,b\n3,4\n"), ("b.csv", "a,b\n5,6\n")):
        (tmp_path / name).write_text(lines)
    got = sorted(map(tuple, S.file(spark, str(tmp_path), delimiter=",", header=True).collect()))
    assert got == [("1", "2"), ("3", "4"), ("5", "6"), ("a", "b")]
