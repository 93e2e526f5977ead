import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return c


def plain(rows):
    """Rows as comparable tuples, columns by name, floats rounded, in order."""
    out = [tuple((k, round(v, 6) if isinstance(v, float) else v) for k, v in sorted(r.items())) for r in rows]
    return sorted(out, key=str)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql):
        got = plain(r.asDict() for r in query(spark, SMALL).collect())
        rel = duck.sql(sql)
        assert got == plain(dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall())

    return check
