from pyspark.sql import functions as F

from sparkloom.functions import packs as P
from sparkloom.functions import text as X
from sparkloom.functions import values as V
from sparkloom.registry import FUNCTIONS, register_all


def test_sql_names_equal_the_columns(spark):
    assert register_all(spark) == sorted(FUNCTIONS)
    df = spark.createDataFrame([("a b a  é", "1.2.3.4"), ("", "x"), (None, None), ("x\ny . $5", "1.2.3.999")], "t string, ip string")
    pairs = {"kwnum(t)": X.kwnum("t"), "uniqueterms(t)": X.uniqueterms(F.coalesce("t", F.lit(""))), "escapechars(t)": X.escapechars("t"), "ip2long(ip)": V.ip2long("ip"), "long2ip(ip2long(ip))": V.long2ip(V.ip2long("ip")), "htmlencode(t)": V.htmlencode("t"), "tset(t)": P.tset(F.coalesce("t", F.lit(""))), "j2s(s2j(t))": P.j2s(P.s2j("t")), "jaccard(s2j(t), array('a'))": P.jaccard(P.s2j("t"), F.array(F.lit("a"))), "levendist(t, ip)": P.levendist("t", "ip")}
    for sql, column in pairs.items():
        rows = df.select(F.expr(sql).alias("a"), column.alias("b"), "t").collect()
        assert all(r["a"] == r["b"] for r in rows if r["t"] is not None), (sql, rows)
    assert spark.sql("SELECT jlen('[1,2]') AS a, jlen('x') AS b, jlen('') AS c, sqroot(-1) AS d, safediv(9, 1, 0) AS e, keywords('a . $5 b') AS f, query('s') AS g").first() == (2, 1, 0, None, 9.0, "a $5 b", "s;")
