"""Every query with SQL gives what DuckDB gives; every other one runs."""

import os

import duckdb
import pandas as pd
import pytest

from sparkloom.suite import load

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def canon(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    text = lambda v: "None" if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, row)) for row in df.astype(object).itertuples(index=False, name=None))


def kinds(types) -> list[str]:
    return [{"bigint": "int", "int": "int", "integer": "int", "hugeint": "int", "varchar": "string"}.get(x, x.split("(")[0]) for x in types]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    rows = got.toPandas()
    if name not in SQL:
        assert list(rows.columns)
        return
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert kinds(dict(got.dtypes)[c] for c in sorted(got.columns)) == kinds(str(dict(zip(want.columns, want.types, strict=True))[c]).lower() for c in sorted(want.columns))
    assert canon(rows) == canon(pd.DataFrame(want.fetchall(), columns=want.columns))
