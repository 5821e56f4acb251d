import os
from pathlib import Path

import duckdb
import pytest

from tesserae import queries as usual
from tesserae import queries_more

QUERIES, SQL = usual.queries() | queries_more.queries(), usual.oracle_sql() | queries_more.oracle_sql()

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    want = con.execute(sql).fetchall()
    names = [d[0] for d in con.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r) for r in df.select(*names).collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    same(spark, SF, QUERIES[name], SQL[name])
