import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from arcweave.session import local_session

    os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")
    session = local_session(8, "4g", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.codegen.wholeStage", "false")  # tiny data: compiling takes longer than running
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return connection


def _value(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    return x


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compare a query with its SQL, row by row, whatever the order."""

    def compare(query, sql):
        df = query(spark, DATA)
        columns = sorted(df.columns)
        got = sorted((tuple(_value(row[c]) for c in columns) for row in df.collect()), key=repr)
        answer = duck.execute(sql)
        names = [c[0] for c in answer.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        expected = sorted((tuple(_value(row[i]) for i in order) for row in answer.fetchall()), key=repr)
        assert got == expected

    return compare
