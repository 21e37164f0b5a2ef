"""Queries for the operators from tables to tables."""

from pyspark.sql import functions as F

from sparkloom.operators import tables as R
from sparkloom.suite import query

DAY = 86_400
_S = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400000000 THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM g) """


@query("flagship_sessions", _S + "SELECT CAST(user_id AS VARCHAR) || CAST(k AS VARCHAR) AS bgroupid, user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total, arg_max(event_type, (value, event_type)) AS top FROM s GROUP BY user_id, k")
def sessions(t):
    from sparkloom.operators.aggregates import maxrow

    made = R.datediffbreak(t("events"), "user_id", "ts", DAY * 1000, ["event_id"])
    return made.groupBy("bgroupid", "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), maxrow("value", "event_type").alias("top"))


@query("sess_datediffbreak", _S + "SELECT event_id, CAST(user_id AS VARCHAR) || CAST(k AS VARCHAR) AS bgroupid FROM s")
def _(t):
    return R.datediffbreak(t("events"), "user_id", "ts", DAY * 1000, ["event_id"]).select("event_id", "bgroupid")


@query("sess_newsesid", _S + "SELECT event_id, CAST(user_id AS VARCHAR) || CAST(k AS VARCHAR) AS bgroupid FROM s WHERE k > 0")
def _(t):
    return R.datediffnewsesid(t("events"), "user_id", "ts", DAY, ["event_id"]).select("event_id", "bgroupid")


@query("sess_filter", "SELECT event_id FROM (SELECT event_id, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS g FROM events) WHERE g IS NULL OR g > 86400000000")
def _(t):
    return R.datedifffilter(t("events"), ["user_id"], "ts", DAY, ["event_id"]).select("event_id")


@query("sess_group", _S + "SELECT event_id, CAST(k + 1 AS VARCHAR) AS groupid FROM s WHERE n > 1")
def _(t):
    return R.datediffgroup(t("events"), ["user_id"], "ts", DAY, ["event_id"]).select("event_id", "groupid")


@query("sess_condbreak", "SELECT event_id, CAST(user_id AS VARCHAR) || CAST(CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS VARCHAR) AS bgroupid FROM events")
def _(t):
    return R.condbreak(t("events"), "user_id", F.col("event_type") == "click", ["ts", "event_id"]).select("event_id", "bgroupid")


@query("sess_window_builtin", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 86400000000 THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def _(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n")).select("user_id", "n")


@query("win_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def _(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start_us"), "n")


@query("win_rowid", "SELECT row_number() OVER (ORDER BY ts, event_id) AS rowid, event_id FROM events")
def _(t):
    return R.rowidvt(t("events"), ["ts", "event_id"]).select("rowid", "event_id")


@query("win_sliding", "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT CAST(w AS BIGINT) AS wid, p_partkey FROM r, LATERAL unnest(generate_series(i, least(i + 2, n - 1))) AS u(w)")
def _(t):
    return R.slidingwindow(t("part"), ["p_partkey"], 3).select("wid", "p_partkey")


@query("win_time_sliding")
def _(t):
    return R.timeslidingwindow(t("events").select("user_id", "event_id", "ts"), ["user_id"], "ts", 7 * DAY).select("wid", "user_id", "event_id")


@query("eav_to", "SELECT n_nationkey AS rid, 'n_name' AS colname, n_name AS val FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation")
def _(t):
    return R.toeav(t("nation"), "n_nationkey")


@query("eav_from", "SELECT n_nationkey AS rid, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def _(t):
    return R.fromeav(R.toeav(t("nation"), "n_nationkey"), ["n_name", "n_regionkey"])


@query("tab_setschema", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS DOUBLE) AS region, CAST(NULL AS VARCHAR) AS more FROM nation")
def _(t):
    return R.setschema(t("nation"), "k long, name string, region double, more string")


@query("tab_coltypes", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) AS v(\"column\", type)")
def _(t):
    return R.coltypes(t("region"))


@query("tab_queryplan")
def _(t):
    return R.queryplan(t("nation").where("n_regionkey = 1").select("n_name"))


@query("tab_range", "SELECT CAST(i AS BIGINT) AS C1 FROM range(1, 101) AS r(i)")
def _(t):
    return R.range_(t.spark, 100)


@query("tab_sample", "SELECT count(*) AS n FROM (SELECT 1 FROM customer LIMIT 50)")
def _(t):
    return R.sample(t("customer"), 50).agg(F.count(F.lit(1)).alias("n"))


@query("tab_samplegroup", "SELECT c_nationkey, least(count(*), 3) AS n FROM customer GROUP BY c_nationkey")
def _(t):
    return R.samplegroup(t("customer"), ["c_nationkey"], 3).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("tab_partialsort", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return R.partialsort(t("nation").select("n_nationkey", "n_name"), 1)


@query("tab_ordered", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey")
def _(t):
    return R.ordered(t("orders"), ["o_custkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("tab_hidden", "SELECT n_name FROM nation WHERE false")
def _(t):
    return R.hidden(t("nation").select("n_name"))


@query("tab_whilevt", "SELECT CAST(i AS BIGINT) AS C1 FROM range(0, 5) AS r(i)")
def _(t):
    return R.whilevt(t.spark, lambda i: t("region").agg(F.when(F.count(F.lit(1)) > i, 1).otherwise(0)))


@query("tab_expand", "SELECT n_nationkey, a, b FROM nation, (VALUES (1), (2)) AS x(a), (VALUES (3), (4)) AS y(b)")
def _(t):
    df = t("nation").select("n_nationkey", F.array(*[F.struct(F.lit(i).alias("a")) for i in (1, 2)]).alias("m"), F.array(*[F.struct(F.lit(i).alias("b")) for i in (3, 4)]).alias("n"))
    return R.expand(df, ["m", "n"])


@query("rangejoin_price_band", """SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_totalprice BETWEEN abs(s_acctbal) * 20 AND abs(s_acctbal) * 20 + 500""")
def range_join(t):
    bands = t("supplier").select("s_suppkey", (F.abs("s_acctbal") * 20).alias("lo"), (F.abs("s_acctbal") * 20 + 500).alias("hi"))
    return R.range_join(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", bands, "lo", "hi", 500).select("o_orderkey", "s_suppkey")


@query("mine_freqitemsets", """WITH r AS (SELECT DISTINCT l_orderkey AS o, CAST(l_suppkey AS VARCHAR) AS i FROM lineitem), f AS (SELECT i, count(*) AS n FROM r GROUP BY i HAVING count(*) >= 4),
k AS (SELECT r.* FROM r JOIN f USING (i)), p AS (SELECT a.i || '|' || b.i AS items, count(*) AS n FROM k a JOIN k b ON a.o = b.o AND a.i < b.i GROUP BY ALL HAVING count(*) >= 4)
SELECT i AS items, 1 AS itemset_length, n AS itemset_frequency FROM f UNION ALL SELECT items, 2, n FROM p""")
def _(t):
    got = R.freqitemsets(t("lineitem"), "l_orderkey", "l_suppkey", 4, 2)
    return got.select(F.array_join("items", "|").alias("items"), "itemset_length", "itemset_frequency")


@query("mine_freqitemsets_all", """WITH RECURSIVE r AS (SELECT DISTINCT l_orderkey AS o, CAST(l_suppkey AS VARCHAR) AS i FROM lineitem),
s AS (SELECT o, i AS items, i AS last, 1 AS n FROM r UNION ALL SELECT s.o, s.items || '|' || r.i, r.i, s.n + 1 FROM s JOIN r ON s.o = r.o AND s.last < r.i)
SELECT items, n AS itemset_length, count(*) AS itemset_frequency FROM s GROUP BY items, n HAVING count(*) >= 4""")
def _(t):
    got = R.freqitemsets(t("lineitem"), "l_orderkey", "l_suppkey", 4)
    return got.select(F.array_join("items", "|").alias("items"), "itemset_length", "itemset_frequency")


@query("graph_cliques")
def _(t):
    lines = t("lineitem").select("l_orderkey", "l_partkey").distinct()
    pairs = lines.alias("a").join(lines.alias("b"), "l_orderkey").where("a.l_partkey < b.l_partkey")
    return R.graphcliques(pairs.select(F.col("a.l_partkey").alias("a"), F.col("b.l_partkey").alias("b")), "a", "b")


@query("graph_powerhash")
def _(t):
    lines = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("a"), F.col("l_returnflag").alias("b"))
    return R.graphpowerhash(lines, ["l_orderkey"], "a", "b", 2)
