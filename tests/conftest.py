import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stemwright.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def _plain(row):
    return tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Asserts that a query and its SQL give the same rows and columns."""

    def check(query, sql):
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        found = sorted((_plain(tuple(r[c] for c in columns)) for r in df.collect()), key=repr)
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        wanted = sorted((_plain(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall()), key=repr)
        assert found == wanted

    return check
