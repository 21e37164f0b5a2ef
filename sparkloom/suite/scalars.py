"""Queries for the functions of single values."""

from pyspark.sql import functions as F

from sparkloom.functions import packs as P
from sparkloom.functions import text as X
from sparkloom.functions import values as V
from sparkloom.suite import query

W = r"'[^\s]+'"


def _unique(text):
    """Number of distinct terms; a text without terms has none, where kwnum counts one."""
    terms = X.uniqueterms(text)
    return F.when(terms == "", F.lit(0).cast("long")).otherwise(X.kwnum(terms))


@query("txt_terms", r"""SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS kwnum, CAST(len(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS BIGINT) AS n_unique, md5(array_to_string(list_filter(regexp_extract_all(text, '[\d.]+\b|[\pL\pM\pN_]+|\$[\d.]+'), lambda x: x <> '.'), ' ')) AS keywords_md5 FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\x00-\x7F]')""")
def _(t):
    d = t("documents").where(F.col("text").isNotNull() & (F.length("text") == F.octet_length("text")))
    return d.select("doc_id", X.kwnum("text").alias("kwnum"), _unique("text").alias("n_unique"), F.md5(X.keywords("text")).alias("keywords_md5"))


# Every document: DuckDB's \b and classes are ASCII, so tests/test_whole.py has brute force. NULL texts give NULLs, texts without terms 0 unique ones.
@query("txt_terms_all")
def _(t):
    known = F.col("text").isNotNull()
    return t("documents").select("doc_id", X.kwnum("text").alias("kwnum"), F.when(known, _unique("text")).alias("n_unique"), F.when(known, F.md5(X.keywords("text"))).alias("keywords_md5"))


@query("txt_spaces", r"""SELECT item_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS comprspaces, replace(replace(text, chr(10), '\x0a'), chr(13), '\x0d') AS escaped, regexp_replace(text, '^[\s.]+|[\s.]+$', '', 'g') AS stripped FROM benchmark""")
def _(t):
    return t("benchmark").select("item_id", X.comprspaces("text").alias("comprspaces"), X.escapechars("text").alias("escaped"), X.stripchars("text", " .\n\t").alias("stripped"))


@query("txt_regex", r"""SELECT item_id, regexp_matches(text, 't[aeiou]n') AS m, CAST(len(list_distinct(regexp_extract_all(text, 't[aeiou]'))) AS BIGINT) AS uniq, regexp_replace(text, '([aeiou])([a-z])', '\2\1', 'g') AS swapped, CAST(len(regexp_extract_all(text, 'on')) AS BIGINT) AS words, CASE WHEN regexp_matches(text, '(t[aeiou])n') THEN regexp_extract(text, '(t[aeiou])n', 1) END AS grp FROM benchmark""")
def _(t):
    c = "text"
    return t("benchmark").select("item_id", X.regexprmatches("t[aeiou]n", c).alias("m"), X.regexpcountuniquematches("t[aeiou]", c).alias("uniq"), X.regexpr("([aeiou])([a-z])", c, r"\2\1").alias("swapped"), X.regexpcountwords("on", c).alias("words"), X.regexpr("(t[aeiou])n", c).alias("grp"))


@query("txt_regex_positions")
def _(t):
    return t("benchmark").select("item_id", X.regexpcountwithpositions("the", "text").alias("late"), X.regexpcountwithpositions("the", "text", 1).alias("early"), X.regexprfindall("th.", "text").alias("found"))


@query("txt_hash", "SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS h, md5('u''' || p_brand || '''') AS hq, md5(CAST(p_partkey AS VARCHAR) || chr(30) || CAST(p_size AS VARCHAR)) AS h2, CAST(('0x' || md5(CAST(p_partkey AS VARCHAR)))::UHUGEINT % 97 AS BIGINT) AS hmod FROM part")
def _(t):
    return t("part").select("p_partkey", X.hashmd5("p_partkey").alias("h"), X.hashmd5("p_brand", quoted=True).alias("hq"), X.hashmd5("p_partkey", "p_size").alias("h2"), X.hashmd5mod("p_partkey", divisor=97).alias("hmod"))


@query("txt_crc32")
def _(t):
    return t("part").select("p_partkey", X.crc32("p_partkey").alias("c"), X.hashmod("p_partkey", divisor=11).alias("m"))


@query("txt_window", r"""WITH w AS (SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, CAST(i AS BIGINT) AS at, array_to_string(w[greatest(i - 2, 1):i - 1], ' ') AS prev, w[i] AS middle, coalesce(array_to_string(w[i + 1:i + 2], ' '), '') AS next FROM w, LATERAL unnest(range(1, len(w) + 1)) AS u(i)""")
def _(t):
    rows = t("benchmark").select("item_id", F.posexplode(X.textwindow2s("text", 2, 1, 2)).alias("at", "r"))
    return rows.select("item_id", (F.col("at") + 1).cast("long").alias("at"), "r.*")


@query("txt_window_wide")
def _(t):
    return t("benchmark").select("item_id", F.inline(X.textwindow("text", -1, 1, 1, "[aeiou]n")))


@query("txt_stopwords", "SELECT n_nationkey, trim(regexp_replace(' ' || lower(n_name) || ' the tale of two ' || lower(n_name), ' (the|of)\\b', '', 'g')) AS kept FROM nation")
def _(t):
    phrase = F.concat(F.lower("n_name"), F.lit(" the tale of two "), F.lower("n_name"))
    return t("nation").select("n_nationkey", X.filterstopwords(phrase).alias("kept"))


@query("txt_split_join", "SELECT n_nationkey, n_name AS \"C1\", CAST(n_regionkey AS VARCHAR) AS \"C2\", CAST(NULL AS VARCHAR) AS \"C3\" FROM nation")
def _(t):
    line = X.strjoin("n_name", "n_regionkey")
    return t("nation").select("n_nationkey", X.strsplit(line, 3, ",").alias("s")).select("n_nationkey", "s.*")


@query("txt_splitv", "SELECT item_id, unnest(string_split(text, ' ')) AS c FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", F.explode(X.strsplitv("text", " ")).alias("c"))


@query("txt_normalize")
def _(t):
    return t("benchmark").select("item_id", X.normalizetext("text").alias("n"), X.cqlkeywords("text").alias("k"), X.cqlfields("text").alias("f"), X.isvalidutf8("text").alias("v"), X.utf8clean("text").alias("c"))


@query("txt_unicode", "SELECT doc_id, text AS back, text AS nfc FROM documents WHERE doc_id < 1e18")
def _(t):
    return t("documents").select("doc_id", X.sunitouni(X.unitosuni("text")).alias("back"), X.normuni("text").alias("nfc"))


@query("txt_references", "SELECT doc_id, text AS kept FROM documents WHERE len(text) - len(replace(text, chr(10), '')) < 10")
def _(t):
    short = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < 10
    return t("documents").where(short).select("doc_id", X.textreferences("text").alias("kept"))


# Every document, those with lists of references too; SQL cannot say the windows, tests/test_whole.py has brute force.
@query("txt_references_all")
def _(t):
    return t("documents").select("doc_id", X.textreferences("text").alias("kept"))


@query("lang_stem")
def _(t):
    return t("benchmark").select("item_id", V.stem("text").alias("s"))


@query("lang_detect")
def _(t):
    return t("benchmark").select("item_id", V.detectlang("text").alias("lang"))


@query("dist_edit", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS lev FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), P.levendist("a.n_name", "b.n_name").alias("lev"))


@query("dist_python")
def _(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), P.damlevendist("a.n_name", "b.n_name").alias("dam"), P.quickstrdist("a.n_name", "b.n_name").alias("quick"))


@query("sim_sets", """WITH s AS (SELECT item_id, list_distinct(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM benchmark WHERE item_id % 4 = 0 OR true)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard, round(2 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)), 6) AS dice FROM s a JOIN s b ON a.item_id + 1 = b.item_id""")
def _(t):
    s = t("benchmark").select("item_id", P.s2j("text").alias("w"))
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, F.expr("a.item_id + 1 = b.item_id")).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(P.jaccard("a.w", "b.w"), 6).alias("jaccard"), F.round(P.sorensendice("a.w", "b.w"), 6).alias("dice"))


@query("set_terms", """SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))), ' ') AS tset, array_to_string(list_sort(list_distinct(list_filter(string_split(text, ' '), lambda x: x NOT IN ('', 'the', 'of')))), ' ') AS tsetdiff FROM benchmark""")
def _(t):
    return t("benchmark").select("item_id", P.tset("text").alias("tset"), P.tsetdiff("text", F.lit("the of")).alias("tsetdiff"))


@query("set_combinations", "WITH n AS (SELECT r_regionkey, list_sort(list_distinct(regexp_extract_all(r_name, '[A-Z]'))) AS c FROM region), u AS (SELECT r_regionkey, unnest(c) AS x FROM n) SELECT a.r_regionkey, a.x || ' ' || b.x AS \"C1\" FROM u a JOIN u b ON a.r_regionkey = b.r_regionkey AND a.x < b.x")
def _(t):
    letters = F.array_join(P.jchars(F.regexp_replace("r_name", "[^A-Z]", "")), " ")
    return t("region").select("r_regionkey", F.explode(P.tsetcombinations(letters, 2)).alias("C1"))


@query("pack_permutations", "WITH u AS (SELECT * FROM (VALUES ('a'), ('b'), ('c'), ('d')) AS v(x)) SELECT r_regionkey, p.x AS \"C1\", q.x AS \"C2\" FROM region, u p, u q WHERE p.x <> q.x")
def _(t):
    return t("region").select("r_regionkey", F.inline(P.jpermutations(F.array(*map(F.lit, "abcd")), 2)))


@query("pack_basics", """WITH s AS (SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, replace(array_to_string(w, ' '), chr(10), ' ') AS j2s, replace(array_to_string(w, chr(9)), chr(10), ' ') AS j2t, array_to_string(w, chr(10)) AS j2nl, array_to_string(list_sort(list_distinct(w)), ' ') AS jset, CAST(len(w) AS BIGINT) AS jlen, CAST(greatest(len(w) - 1, 0) AS BIGINT) AS n_bigrams, w[1] AS first, w[-1] AS last, array_to_string(list_filter(w, lambda x: x <> 'the'), ' ') AS jexcept FROM s""")
def _(t):
    w = P.s2j("text")
    return t("benchmark").select("item_id", P.j2s(w).alias("j2s"), P.j2t(w).alias("j2t"), P.j2nl(w).alias("j2nl"), F.array_join(P.jset(w), " ").alias("jset"), P.jlen(w).alias("jlen"), P.jlen(P.jngrams(F.array_join(w, " "), 2)).alias("n_bigrams"), P.jsplice(w, 0).alias("first"), P.jsplice(w, -1).alias("last"), F.array_join(P.jexcept(w, F.array(F.lit("the"))), " ").alias("jexcept"))


@query("pack_round_trip", "SELECT n_nationkey, n_name AS one, '[\"' || n_name || '\",\"' || n_regionkey || '\"]' AS two, n_name AS back FROM nation")
def _(t):
    two = P.jpack("n_name", "n_regionkey")
    return t("nation").select("n_nationkey", P.jpack("n_name").alias("one"), two.alias("two"), P.unpack(two)[0].alias("back"))


@query("pack_sorting", "SELECT r_regionkey, '2 10 a b' AS jsort, '(?:x)|(?:y)' AS rx, '0 1 2' AS jrange, 'long' AS longest, 'b' AS inter FROM region")
def _(t):
    a = lambda *x: F.array(*map(F.lit, x))
    return t("region").select("r_regionkey", F.array_join(P.jsort(a("b", "10", "a", "2")), " ").alias("jsort"), P.jmergeregexp(a("x", "", "y")).alias("rx"), F.array_join(P.jrange(F.lit(3)), " ").alias("jrange"), P.jlengthiest(a("ab", "long", "abcd")).alias("longest"), F.array_join(P.jintersection(a("b", "a"), a("c", "b")), " ").alias("inter"))


@query("json_dict", """SELECT event_id, CAST(props ->> '$.k' AS VARCHAR) AS k, 'k' AS keys, CAST(props ->> '$.k' AS VARCHAR) AS vals FROM events""")
def _(t):
    return t("events").select("event_id", P.jdictsplit("props", "k").alias("s"), F.array_join(P.jdictkeys("props"), "|").alias("keys"), F.array_join(P.jdictvals("props"), "|").alias("vals")).select("event_id", "s.k", "keys", "vals")


@query("json_dict_rows", "SELECT event_id, 'k' AS key, props ->> '$.k' AS val FROM events")
def _(t):
    return t("events").select("event_id", F.inline(P.jdictsplitv("props")))


@query("json_path", "SELECT event_id, props ->> '$.k' AS \"C1\" FROM events")
def _(t):
    return t("events").select("event_id", F.inline(P.jsonpath("props", "$.k")))


@query("html_strip")
def _(t):
    return t("pages").select("page_id", V.htmlstriptags("html").alias("plain"), V.htmldecode("html").alias("decoded"))


@query("html_encode", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS enc FROM pages")
def _(t):
    return t("pages").select("page_id", V.htmlencode("html").alias("enc"))


@query("url_parts", r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS netloc, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '^([a-z]+://[^?#;]*)', 1) AS location FROM pages""")
def _(t):
    return t("pages").select("page_id", V.urlsplit("url").alias("u"), V.urllocation("url").alias("location")).select("page_id", "u.scheme", "u.netloc", "u.query", "location")


@query("url_coding", "SELECT page_id, url AS back FROM pages")
def _(t):
    return t("pages").select("page_id", V.urldecode(V.urlencode("url")).alias("back"))


@query("url_query_dict")
def _(t):
    return t("pages").select("page_id", V.urlquery2jdict("url").alias("q"))


@query("html_links", "SELECT page_id, '<a href=\"' || url || '\">x</a>' AS link, regexp_replace(url, '([./-])([^./\\-0-9\\s])', '\\1<wbr>\\2', 'g') AS breaks FROM pages")
def _(t):
    return t("pages").select("page_id", V.htmllink("url", F.lit("x")).alias("link"), V.htmladdbreaks("url").alias("breaks"))


@query("ip_numbers", """SELECT c_custkey, c_custkey * 65539 % 4294967296 AS n, (c_custkey * 65539 % 4294967296 // 16777216) || '.' || (c_custkey * 65539 // 65536 % 256) || '.' || (c_custkey * 65539 // 256 % 256) || '.' || (c_custkey * 65539 % 256) AS ip, CAST(c_custkey * 65539 % 4294967296 // 16777216 AS VARCHAR) AS prefix FROM customer""")
def _(t):
    n = F.col("c_custkey") * 65539 % 4294967296
    ip = V.long2ip(n)
    return t("customer").select("c_custkey", V.ip2long(ip).alias("n"), ip.alias("ip"), V.ip_prefix(ip, 1).alias("prefix"))


@query("maths", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN -1 ELSE CAST(floor(p_partkey / (p_size % 3)) AS BIGINT) END AS d, round(sqrt(p_retailprice), 6) AS root, CAST(p_size AS DOUBLE) AS num FROM part""")
def _(t):
    return t("part").select("p_partkey", V.safediv(F.lit(-1).cast("long"), "p_partkey", F.col("p_size") % 3).alias("d"), F.round(V.sqroot("p_retailprice"), 6).alias("root"), V.tonumber(F.col("p_size").cast("string")).alias("num"))


@query("maths_fractions", "SELECT p_partkey, p_size + 1 || '' AS n FROM part")
def _(t):
    return t("part").select("p_partkey", V.farith(F.concat(F.lit("+ 1/3 + 2/3 "), F.col("p_size").cast("string"))).alias("n"))


@query("date_formats", """SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS d, strftime(o_orderdate, '%Y-%m-%d') AS t, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') < 30 THEN 5 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') < 90 THEN 4 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') < 180 THEN 3 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') < 360 THEN 2 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') < 720 THEN 1 ELSE 0 END AS activity FROM orders""")
def _(t):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t("orders").select("o_orderkey", V.dateformat(text, "%Y-%m-%d", "%Y/%m/%d").alias("d"), F.left(V.cleantimezone(F.concat(text, F.lit("T10:00:00+02:00"))), F.lit(10)).alias("t"), V.activityindex("o_orderdate", F.lit("1998-08-02").cast("date")).alias("activity"))


@query("date_human", "SELECT p_partkey, CASE WHEN p_partkey * 7 // 60 > 0 THEN (p_partkey * 7 // 60) || ' min ' ELSE '' END || CASE WHEN p_partkey * 7 % 60 > 0 THEN (p_partkey * 7 % 60) || ' sec' ELSE '' END AS human FROM part WHERE p_partkey < 500")
def _(t):
    return t("part").where("p_partkey < 500").select("p_partkey", V.sectohuman(F.col("p_partkey") * 7).alias("human"))


@query("date_human_all", "WITH s AS (SELECT p_partkey, CAST(p_partkey AS BIGINT) * 7 AS s FROM part) SELECT p_partkey, CASE WHEN s // 86400 > 0 THEN (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day ' ELSE ' days ' END ELSE '' END || CASE WHEN s % 86400 // 3600 > 0 THEN (s % 86400 // 3600) || CASE WHEN s % 86400 // 3600 = 1 THEN ' hour ' ELSE ' hours ' END ELSE '' END || CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || ' min ' ELSE '' END || CASE WHEN s % 60 > 0 THEN (s % 60) || ' sec' ELSE '' END AS human FROM s")
def _(t):
    return t("part").select("p_partkey", V.sectohuman(F.col("p_partkey") * 7).alias("human"))


@query("date_weeks", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '2008W53' ELSE '2009W05' END AS w, '2009-01-02T05:30:00+02:00' AS z FROM part")
def _(t):
    week = F.when(F.col("p_partkey") % 2 == 0, "2009W00").otherwise("2009W05")
    return t("part").select("p_partkey", V.datestrf2isoweek(week).alias("w"), V.tzconverter(F.lit("2009-01-02T03:30:00"), "+02:00").alias("z"))


@query("log_apache", """SELECT c_custkey, '10.0.0.' || (c_custkey % 256) AS ip, 'GET' AS method, '/p/' || c_custkey AS uri, 200 AS status, CAST(c_custkey AS BIGINT) AS bytes, '2000-10-10T13:55:36-0700' AS date FROM customer""")
def _(t):
    k = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 256).cast("string"), F.lit(' - bob [10/Oct/2000:13:55:36 -0700] "GET /p/'), k, F.lit(' HTTP/1.0" 200 '), k, F.lit(' "-" "agent"'))
    return t("customer").select("c_custkey", V.apachelogsplit(line).alias("l")).select("c_custkey", "l.ip", "l.method", "l.uri", "l.status", "l.bytes", "l.date")


@query("zip_round_trip", "SELECT item_id, text AS back FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", V.ungz(V.gz("text")).alias("back"))


@query("logic", "SELECT p_partkey, CASE WHEN p_size % 2 <> 0 THEN 'odd' ELSE 'even' END AS k, contains(p_type, 'STEEL') AS c, '.pdf' AS ext FROM part")
def _(t):
    return t("part").select("p_partkey", V.ifthenelse(F.col("p_size") % 2, F.lit("odd"), F.lit("even")).alias("k"), X.contains("p_type", F.lit("STEEL")).alias("c"), V.fileextension(F.lit("/a.b/X.PDF")).alias("ext"))
