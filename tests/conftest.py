import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same():
    """Whether a DataFrame and a DuckDB result hold the same rows under the same names."""

    def compare(df, con, sql):
        a = df.toArrow()
        b = con.execute(sql).to_arrow_table() if hasattr(con, "to_arrow_table") else con.execute(sql).arrow()
        b = b.read_all() if hasattr(b, "read_all") else b
        names = sorted(a.column_names)
        assert names == sorted(b.column_names)
        rows = lambda t: sorted(repr(tuple(r[c] for c in names)) for r in t.select(names).to_pylist())
        assert rows(a) == rows(b)

    return compare
