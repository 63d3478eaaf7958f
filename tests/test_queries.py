"""Every query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pytest

from lexiloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    plain = lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, float | np.floating) else int(x) if isinstance(x, np.integer) else x
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    mine = catalog.queries()[name](spark, SF).toPandas()
    sql = con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    assert rows(mine) == rows(sql[mine.columns])
