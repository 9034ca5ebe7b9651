from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[2]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL over the smallest tables, as the driver does."""

    def plain(x):
        return round(x, 6) if isinstance(x, float) else x if isinstance(x, (int, str, bool, type(None))) else str(x)

    def check(query, sql):
        frame = query(spark, SMALL)
        cols = sorted(frame.columns)
        got = sorted((tuple(plain(r[c]) for c in cols) for r in frame.collect()), key=str)
        rel = duck.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)

    return check
