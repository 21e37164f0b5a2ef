import re

import duckdb

from sparkloom.llm import registry

SF = "/root/testdata/sf0.01"


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 11))


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got, want = registry.queries()[name](spark, SF), con.sql(sql)
        assert set(want.columns) <= set(got.columns)
        rows = sorted(tuple(map(str, r)) for r in got.select(*want.columns).collect())
        assert rows == sorted(tuple(map(str, r)) for r in want.fetchall()), name
