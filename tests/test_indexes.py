"""The SQL function, shredded metadata, trigram-pruned search and services as sources: results as without them, and plans that read less."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from docquarry.functions import sqlapi
from docquarry.functions.jsonfilter import contains
from docquarry.operators import matching, metadata_index, substring_index
from docquarry.session import scratch
from docquarry.sources import answers, services

DOCUMENTS = [
    {"a": 1}, {"a": 1.0}, {"a": "1"}, {"a": True}, {"a": None}, {"a": [1, 2]}, {"a": {"b": "x", "c": [1]}}, {"a": {"b": None}}, {"b": 1}, {}, [], [1, "x"], "x", 1, None, {"a": ""}, {"a": -0.0}, {"a": 0},
    {"a": 9007199254740993}, {"a": 9007199254740992}, {"a": {"b": {"c": 2}}}, {"a.b": "x"}, {"a": {"b": "x"}, "b": [{"c": 1}, {"c": 2}]}, {"a": 1e300}, {"a": 0.1}, {"a": "\"'\\ é"},
]
FILTERS = [{}, {"a": {}}, {"a": []}, {"a": {"b": "x"}}, {"a": {"b": None}}, {"a": {"c": [1]}}, {"b": [{"c": 2}]}, {"a": {"b": {"c": 2}}}, {"a.b": "x"}, [], [1], 1, "x", None, {"b": 1, "a": 1}]
FILTERS += [{"a": v} for v in (1, 1.0, "1", True, False, None, "", 0, -0.0, 9007199254740993, 1e300, 0.1, "\"'\\ é", [2], [1, 2])]


@pytest.fixture(scope="module")
def documents(spark):
    texts = [*map(json.dumps, DOCUMENTS), None, "not json", '{"a": 1, "z": 3}']
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, metadata string")


def test_shredded_containment_equals_plain(spark, documents):
    table = metadata_index.write(documents, scratch(spark, "shredded"), ["a", ("a", "b"), ("a.b",), "b"][:2] + ["b"])
    paths = ["a", ("a", "b"), "b"]
    for wanted in FILTERS:
        want = {r.id for r in documents.where(contains(F.col("metadata"), wanted)).collect()}
        assert {r.id for r in metadata_index.containing(table, wanted, paths).collect()} == want, wanted
    assert table.count() == documents.count() and metadata_index.containing(table, {}, paths).columns == ["id", "metadata"]
    with pytest.raises(ValueError, match="name"):
        metadata_index.write(documents, scratch(spark, "shredded"), ["a_b", "a.b"])


def test_shredded_filter_reaches_the_scan(spark):
    rows = spark.range(40_000).select("id", F.to_json(F.struct((F.col("id") % 400).alias("k"))).alias("metadata"))
    table = metadata_index.write(rows, scratch(spark, "shredded"), ["k"])
    found = metadata_index.containing(table, {"k": 7}, ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(meta_k" in plan or "PushedFilters: [Or(EqualTo(meta_k" in plan or "meta_k, [" in plan.split("PushedFilters:")[1]
    assert found.count() == 100
    strings = metadata_index.write(rows.withColumn("metadata", F.to_json(F.struct(F.col("id").cast("string").alias("k")))), scratch(spark, "shredded"), ["k"])
    assert "EqualTo(meta_k,s:7)" in metadata_index.containing(strings, {"k": "7"}, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_json_contains_equals_the_expression(spark, documents):
    for wanted in FILTERS:
        if wanted is None:  # no filter in Python, and null in SQL's JSON
            continue
        want = {r.id: r.c for r in documents.select("id", contains(F.col("metadata"), wanted).alias("c")).collect()}
        got = {r.id: sqlapi.contains_text(r.metadata, json.dumps(wanted)) for r in documents.collect()}
        assert got == want, wanted


def test_sql_function(spark):
    chunks = [(str(i), f"text {i}", json.dumps({"lang": "en" if i % 2 else "de"}), [float(i), 1.0]) for i in range(9)]
    chunks += [("n", "null vector", "{}", None), ("z", "no length", "{}", [0.0, 0.0]), ("m", "no metadata", None, [1.0, 1.0]), ("d", "other dimension", "{}", [1.0]), ("t", None, "{}", [2.0, 2.0])]
    frame = spark.createDataFrame(chunks, "id string, content string, metadata string, embedding array<double>")
    path = scratch(spark, "chunks")
    frame.write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("sql_chunks")
    sqlapi.register(spark, "sql_chunks", name="match_documents")
    same = lambda rows: [(r.id, r.content, r.metadata, repr(r.similarity)) for r in rows]
    for count, wanted in ((None, None), (3, None), (20, {"lang": "en"}), (0, None), (2, {"lang": "none"})):
        extra = ", " + ("NULL" if count is None else str(count)) + (f", '{json.dumps(wanted)}'" if wanted else "")
        got = same(spark.sql(f"SELECT * FROM match_documents(array(1D, 1D){extra})").collect())
        # a vector of another dimension is at no distance in SQL
        assert [g for g in got if g[0] != "d"] == same(matching.match_documents(frame.where("id <> 'd'"), [1.0, 1.0], count, wanted).collect())
    plan = spark.sql("SELECT id FROM match_documents(array(1D, 1D), 3)")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=3" in plan and "Python" not in plan and "content" not in plan.split("ReadSchema")[1]
    # a call joins other tables, and calls in a correlated join have each row's query
    rows = spark.sql("SELECT q.k, m.id FROM VALUES (1, array(0D, 1D)), (2, array(9D, 1D)) AS q(k, v), LATERAL match_documents(q.v, 1) m").collect()
    assert {(r.k, r.id) for r in rows} == {(1, "0"), (2, "8")}
    with pytest.raises(ValueError, match="name"):
        sqlapi.register(spark, "a; DROP TABLE b")


def test_substring_search(spark, monkeypatch):
    words = ["Stryker", "STRYKER Corp", "other", "abc", None, "", "ab", "Überstryk", "a_b%c", "back\\slash", "żółw ŻÓŁW"]
    rows = spark.createDataFrame([(i, f"{w} {i % 7}" if w and i % 2 else w) for i, w in enumerate(itertools.islice(itertools.cycle(words), 300))], "id int, name string")
    index = substring_index.build(rows, scratch(spark, "substrings"), "name", 20)
    for term in ("stryker", "STRYK", "r 3", "ab", "", "zzz", "corp", "a_b", "str%er", "über", "żółw", "ther 1", "slash"):
        want = {r.id for r in rows.where(F.col("name").ilike(f"%{term}%")).collect()}
        assert {r.id for r in index.search(term).collect()} == want, term
    every = len(index.search("").inputFiles())
    assert every > 10 and 0 < len(index.search("stryker corp").inputFiles()) < every / 3 and index.files("zzz") == [] and index.files("ab") is None


def test_services_are_asked_in_tasks(spark, tmp_path):
    """A partition for each request, retries, filters before requests, and no rows of a request that fails."""
    requests = spark.createDataFrame([(str(i), i) for i in range(6)] + [(None, 9)], "k string, n int")

    def ask(request):
        seen = tmp_path / f"asked-{request['n']}"
        seen.write_text(seen.read_text() + "x" if seen.exists() else "x")
        if request["n"] == 4 or (request["n"] == 2 and len(seen.read_text()) < 2):
            raise OSError("down")
        return [(request.get("k"), request["n"] * 10 + i) for i in range(request["n"])]

    found = services.asked(requests, "docquarry_test", ask, "k string, v int", "k")
    rows = found.collect()
    assert found.rdd.getNumPartitions() == 7
    assert sorted((r.k or "", r.v) for r in rows) == sorted([("" if n == 9 else str(n), n * 10 + i) for n in (1, 2, 3, 5, 9) for i in range(n)])
    assert (tmp_path / "asked-4").read_text().count("x") >= 3
    for f in tmp_path.iterdir():
        f.unlink()
    assert {r.v for r in found.where("k in ('3', '5') and v > 31").collect()} == {32, 50, 51, 52, 53, 54}
    assert {f.name for f in tmp_path.iterdir()} == {"asked-3", "asked-5"}
    assert services.asked(requests.limit(0), "docquarry_test", ask, "k string, v int", "k").collect() == []


def test_product_requests_equal_single_ones(spark):
    made = answers.product_requests(spark.createDataFrame([("a\"b",), ("",)], "query string"), country="DE", size=3, current_date="2026-01-01").collect()
    assert [{"params": r.params.asDict(), "body": r.body.asDict(recursive=True)} for r in made] == [answers.product_request(q, country="DE", size=3, current_date="2026-01-01") for q in ("a\"b", "")]
