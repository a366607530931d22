"""Every query of the reference set against DuckDB on the smallest tables."""

import pytest

from docquarry.operators import matching
from docquarry.plans import queries as q

from .conftest import SF


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, duck, same, name):
    same(q.queries()[name](spark, SF), duck, q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_runs(spark, name):
    assert q.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pushdown(spark):
    """Filters and columns reach the scans, and top-k needs no full sort."""
    plan = q.queries()["catalog_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualTo(p_type,))" in plan and "p_size" not in plan.split("ReadSchema")[1]
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    plan = matching.match(rows, [0.5] * 64, 5, metadata=None)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = q.queries()["match_documents_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan and "embedding" not in plan.split("FileScan")[1]


@pytest.mark.parametrize("text", ["x" * 70 + "\n" + "y" * 900, "short", "", None, "none", "ab " * 400])
def test_service_locate_of_odd_documents(spark, same, tmp_path, text):
    """A passage with a line end, none, or no document: SQL's row of nulls; the last one is found."""
    import duckdb
    from pyspark.sql import functions as F

    for name in ("documents", "embeddings"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "documents":
            rows = rows.where("doc_id <> 0") if text == "none" else rows.withColumn("text", F.when(F.col("doc_id") == 0, F.lit(text)).otherwise(F.col("text")))
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(q.queries()["service_locate"](spark, str(tmp_path)), con, q.oracle_sql()["service_locate"])
