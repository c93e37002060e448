import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def same_as_sql(duck):
    """Holds a DataFrame against SQL: the same columns by name, the same rows in any order."""

    def value(v):
        return None if v is None else round(v, 6) if isinstance(v, float) else v

    def check(df, sql):
        cols = sorted(df.columns)
        q = duck.sql(sql)
        assert sorted(q.columns) == cols
        at = [q.columns.index(c) for c in cols]
        got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr)
        want = sorted((tuple(value(r[i]) for i in at) for r in q.fetchall()), key=repr)
        assert got == want

    return check
