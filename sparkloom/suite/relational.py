"""Plain relational queries and aggregates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import aggregates as A
from sparkloom.operators import tables as R
from sparkloom.suite import query

r6 = lambda c, name: F.round(c, 6).alias(name)


def view(t, *names):
    for n in names:
        t(n).createOrReplaceTempView(n)
    return t.spark


def same(name, sql, *tables):
    """A query whose SQL both engines read."""

    @query(name, sql)
    def run(t):
        return view(t, *tables).sql(sql)


same("base_filter_agg", """SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-01 00:00:00' GROUP BY l_returnflag, l_linestatus""", "lineitem")
same("base_join_star", """SELECT n_name, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""", "orders", "customer", "nation", "region")
same("base_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "customer", "orders")
same("base_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "customer", "orders")
same("base_left_outer", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", "customer", "orders")
same("base_cross_join", "SELECT a.r_name AS a_name, b.n_name AS b_name FROM region a CROSS JOIN nation b", "region", "nation")
same("base_theta_join", "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", "supplier")
same("base_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", "customer", "supplier")
same("base_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier", "customer", "supplier")
same("base_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier", "customer", "supplier")
same("base_except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0", "orders", "customer")
same("base_distinct_count", "SELECT o_orderpriority, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority", "orders")
same("base_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", "orders")
same("base_having_topk", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 3 ORDER BY n DESC, o_custkey LIMIT 20", "orders")
same("base_window_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rk FROM orders", "orders")
same("base_cube", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
same("base_case_like_in", "SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' WHEN p_size IN (1, 2, 3) THEN 'small' ELSE 'other' END AS kind FROM part WHERE p_size BETWEEN 1 AND 30", "part")


@query("base_pivot", """SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS O, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS P FROM orders GROUP BY o_orderpriority""")
def _(t):
    return t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("agg_statistics", """SELECT l_returnflag, round(median(q), 6) AS median, round(max(q) - min(q), 6) AS rangef, round(avg(q), 6) AS amean,
  round(sum(q * d) / sum(CASE WHEN d IS NOT NULL THEN q END), 6) AS wamean, round(var_samp(l_discount), 6) AS variance, round(stddev_pop(l_discount), 6) AS stdev, round(corr(l_quantity, l_extendedprice), 6) AS pearson
FROM (SELECT *, nullif(l_quantity, 0) AS q, nullif(l_discount, 0) AS d FROM lineitem) GROUP BY l_returnflag""")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(r6(A.median("l_quantity"), "median"), r6(A.rangef("l_quantity"), "rangef"), r6(A.amean("l_quantity"), "amean"), r6(A.wamean("l_quantity", "l_discount"), "wamean"), r6(A.variance("l_discount"), "variance"), r6(A.stdev("l_discount", True), "stdev"), r6(A.pearson("l_quantity", "l_extendedprice"), "pearson"))


@query("agg_gmean", """SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS g0, round(1 / avg(1 / p_retailprice), 4) AS gm1, round(avg(p_retailprice), 4) AS g1, round(sqrt(avg(p_retailprice * p_retailprice)), 4) AS g2 FROM part WHERE p_retailprice <> 0 GROUP BY p_brand""")
def _(t):
    return t("part").groupBy("p_brand").agg(*[F.round(A.gmean("p_retailprice", p), 4).alias(n) for p, n in ((0, "g0"), (-1, "gm1"), (1, "g1"), (2, "g2"))])


@query("agg_variance_single", "SELECT l_orderkey, CASE WHEN count(*) = 1 THEN 0.0 ELSE round(var_samp(l_quantity), 6) END AS variance FROM lineitem GROUP BY l_orderkey")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(r6(A.variance("l_quantity"), "variance"))


@query("agg_modeop", """WITH c AS (SELECT c_nationkey, lower(c_mktsegment) AS v, count(*) AS n FROM customer GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY c_nationkey) AS x FROM c)
SELECT DISTINCT c_nationkey, CASE WHEN x <= 1 THEN 'None' ELSE v END AS ModeOpElements, CASE WHEN x <= 1 THEN 'None' ELSE CAST(n AS VARCHAR) END AS ModeOpValue FROM m WHERE n = x OR x <= 1""")
def _(t):
    return R.modeop(t("customer"), ["c_nationkey"], "c_mktsegment")


@query("agg_fsum", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def _(t):
    pair = F.from_json("s", "array<double>")
    return t("orders").groupBy("o_custkey").agg(A.fsum(F.round("o_totalprice", 4)).alias("s")).select("o_custkey", F.round(pair[0] / pair[1], 2).alias("total"))


@query("agg_frecency", """SELECT user_id, CAST(sum(CASE WHEN a <= 10 THEN 100 WHEN a <= 30 THEN 70 WHEN a <= 90 THEN 50 WHEN a <= 180 THEN 30 ELSE 10 END) AS DOUBLE) AS frecency,
  round(coalesce(sum(CASE WHEN a < 30 THEN 1.0 WHEN a < 90 THEN 0.7 WHEN a < 180 THEN 0.5 WHEN a < 360 THEN 0.3 WHEN a < 720 THEN 0.2 END), 0), 6)::DOUBLE AS frecencyindex
FROM (SELECT user_id, date_diff('day', CAST(ts AS DATE), DATE '2024-12-31') AS a FROM events) GROUP BY user_id""")
def _(t):
    now = F.lit("2024-12-31").cast("date")
    return t("events").groupBy("user_id").agg(r6(A.frecency("ts", now), "frecency"), r6(A.frecencyindex("ts", now), "frecencyindex"))


@query("agg_date_gaps", """SELECT user_id, CASE WHEN count(*) > 1 THEN round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0 / count(*), 3) END AS avgdtdiff, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 6) AS duration FROM events GROUP BY user_id""")
def _(t):
    return t("events").groupBy("user_id").agg(F.round(A.avgdtdiff("ts"), 3).alias("avgdtdiff"), r6(A.dategroupduration("ts"), "duration"))


@query("agg_mindtdiff", "SELECT user_id, round(min(g) / 1000.0, 3) AS mindtdiff FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events) GROUP BY user_id")
def _(t):
    return R.mindtdiff(t("events"), ["user_id"], "ts").select("user_id", F.round("mindtdiff", 3).alias("mindtdiff"))


@query("sel_minrow_maxrow", """SELECT o_custkey, arg_min(o_orderpriority, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY o_custkey""")
def _(t):
    return t("orders").groupBy("o_custkey").agg(A.minrow("o_totalprice", "o_orderpriority", "o_orderkey").alias("cheapest"), A.maxrow("o_totalprice", "o_orderkey").alias("dearest"))


@query("sel_imax", "SELECT o_custkey, max(CASE WHEN r = 3 THEN o_totalprice END) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) GROUP BY o_custkey")
def _(t):
    return R.ranked(t("orders"), ["o_custkey"], 3, "o_totalprice")


@query("sel_imax_collected", "SELECT c_nationkey, list_extract(list_reverse_sort(list(c_acctbal)), 2) AS second FROM customer GROUP BY c_nationkey")
def _(t):
    return t("customer").groupBy("c_nationkey").agg(A.imax(2, "c_acctbal").alias("second"))


@query("sel_ontop", "SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r <= 5")
def _(t):
    return R.ontop(t("lineitem"), ["l_returnflag"], 5, [F.desc("l_extendedprice"), F.desc("l_orderkey"), F.desc("l_linenumber")], ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("sel_groupdiff", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_type AS compid, arg_min(event_id, (ts, event_id)) AS event_id, CAST(count(*) AS BIGINT) AS repetition FROM a GROUP BY user_id, event_type, g""")
def _(t):
    return R.groupdiff(t("events"), ["user_id"], "event_type", ["ts", "event_id"], ["event_id"])


@query("txt_concat", """SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS concatgroup, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS concatlines, string_agg(n_name, ' ' ORDER BY n_nationkey) AS concatterms,
  chr(10) || string_agg(CAST(n_nationkey AS VARCHAR) || chr(9) || n_name, chr(10) ORDER BY n_nationkey) AS showgroups FROM nation GROUP BY n_regionkey""")
def _(t):
    o = "n_nationkey"
    return t("nation").groupBy("n_regionkey").agg(A.concatgroup("n_name", o).alias("concatgroup"), A.concatlines("n_name", o).alias("concatlines"), A.concatterms("n_name", o).alias("concatterms"), A.showgroups("n_nationkey", "n_name", order=o).alias("showgroups"))


@query("pack_groups", """SELECT n_regionkey, list(n_name ORDER BY n_nationkey).array_to_string('|') AS jgroup, list_distinct(list(left(n_name, 1))).list_sort().array_to_string('|') AS jset,
  CAST(count(DISTINCT left(n_name, 1)) AS BIGINT) AS jlen, list_sort(list(DISTINCT n_name))[1:2].array_to_string('|') AS sampled FROM nation GROUP BY n_regionkey""")
def _(t):
    from sparkloom.functions import packs as P

    first = t("nation").withColumn("one", F.array(F.left("n_name", F.lit(1))))
    g = first.groupBy("n_regionkey").agg(A.jgroup("n_name", order="n_nationkey").alias("a"), A.jgroupunion("one", "n_nationkey").alias("u"), A.sampledistvals(2, "n_name").alias("s"))
    return g.select("n_regionkey", F.array_join("a", "|").alias("jgroup"), F.array_join(P.jset("u"), "|").alias("jset"), P.jlen("u").alias("jlen"), F.array_join("s", "|").alias("sampled"))


@query("pack_group_intersection", """WITH p AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS f FROM lineitem GROUP BY l_orderkey), q AS (SELECT o_custkey, f FROM p JOIN orders ON o_orderkey = l_orderkey)
SELECT o_custkey, coalesce(string_agg(e, '|' ORDER BY e) FILTER (k = n), '') AS common FROM (SELECT o_custkey, e, count(*) AS k FROM (SELECT o_custkey, unnest(f) AS e FROM q) GROUP BY o_custkey, e) JOIN (SELECT o_custkey, count(*) AS n FROM q GROUP BY o_custkey) USING (o_custkey) GROUP BY o_custkey""")
def _(t):
    flags = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    met = flags.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("o_custkey").agg(F.array_join(F.array_sort(A.jgroupintersection("f", "o_orderkey")), "|").alias("common"))


@query("pack_dictgroup", "SELECT c_nationkey, arg_max(c_acctbal, c_custkey) FILTER (c_mktsegment = 'BUILDING') AS building FROM customer GROUP BY c_nationkey")
def _(t):
    made = R.jdictgroup(t("customer"), ["c_nationkey"], "c_mktsegment", "c_acctbal", "c_custkey")
    return made.select("c_nationkey", F.try_element_at("dict", F.lit("BUILDING")).alias("building"))


@query("pack_dictkeys", "SELECT event_type, 'k' AS keys, CAST(max(1) AS BIGINT) AS size FROM events GROUP BY event_type")
def _(t):
    keys = t("events").groupBy("event_type").agg(F.array_join(A.jgroupunionkeys("props", "event_id"), "|").alias("keys"))
    return keys.join(R.jdictgroupunion(t("events"), ["event_type"], "props").select("event_type", "size"), "event_type")


@query("pack_uniquelimit", """WITH f AS (SELECT o_orderpriority, o_custkey, min(o_orderkey) AS k FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY k) AS n FROM f)
SELECT o_orderpriority, max(CASE WHEN n = 50 THEN k END) AS k FROM r GROUP BY o_orderpriority""")
def _(t):
    return R.jgroupuniquelimit(t("orders").withColumn("p", F.array(F.col("o_custkey").cast("string"))), ["o_orderpriority"], "p", "o_orderkey", 50)


@query("agg_groupsum_groupmax", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity, max(l_extendedprice) AS top FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def _(t):
    keys = ["l_returnflag", "l_linestatus"]
    top = R.groupmax(t("lineitem"), keys, ["l_extendedprice"]).withColumnRenamed("l_extendedprice", "top")
    return R.groupsum(t("lineitem"), keys, ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 2)).join(top, keys)


@query("graph_text", """WITH e AS (SELECT DISTINCT s_nationkey AS a, s_suppkey AS b FROM supplier) SELECT a, 'digraph g {' || chr(10) || string_agg('"' || a || '" -> "' || b || '";', chr(10) ORDER BY '"' || a || '" -> "' || b || '";') || chr(10) || '}' AS dot FROM e GROUP BY a""")
def _(t):
    return t("supplier").groupBy(F.col("s_nationkey").alias("a")).agg(A.graphtodot("g", "s_nationkey", "s_suppkey").alias("dot"))


@query("win_moving_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return t("events").select("event_id", r6(F.sum("value").over(w), "s"))
