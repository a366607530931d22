"""The bucketed table, the vector store and row policies."""

import pytest
from docquarry import policies
from docquarry.models import HashingEmbedder
from docquarry.operators import catalog, vector_store
from docquarry.schemas import DEVICES
from docquarry.session import scratch
from docquarry.sources import versioned
from docquarry.sources.versioned import VersionedTable

FIELDS = "primary_di string, brand_name string, description string, seq int"


def load(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def shown(frame):
    return sorted((r.primary_di or "", r.brand_name or "", r.description or "", r.id) for r in frame.collect())


def test_upserts_equal_those_of_the_whole_table(spark):
    """Three loads, with repeated keys and rows without a key, against catalog.upsert() over everything; a small load leaves the other buckets' folders as they are."""
    table, whole = VersionedTable(spark, scratch(spark, "devices"), buckets=8), spark.createDataFrame([], DEVICES)
    loads = [
        [(str(i), f"b{i}", "first", i) for i in range(60)] + [(None, "n", "x", 1), (None, "n", "x", 2)],
        [("3", "late", "second", 9), ("3", "early", "second", 1), ("99", "new", None, 5)],
        [(None, "m", "y", 1), ("3", None, "third", 1)],
    ]
    for k, rows in enumerate(loads):
        before = table.manifest()["folders"]
        assert table.upsert(load(spark, rows)) == k + 1
        whole = spark.createDataFrame(catalog.upsert(whole, load(spark, rows)).collect(), DEVICES)
        assert shown(table.read()) == shown(whole)
        after = table.manifest()["folders"]
        kept = {b for b in before if after[b] == before[b]}
        assert len(kept) >= len(before) - len(rows)
    assert shown(table.read(1)) != shown(table.read()) and VersionedTable(spark, table.root, buckets=99).buckets == 8
    created = {r.primary_di: r.created_at for r in table.read(1).collect()}
    assert all(r.created_at == created[r.primary_di] for r in table.read().where("primary_di in ('3', '5')").collect())
    assert table.upsert(load(spark, []).limit(0)) == 3
    files = set(table.read().inputFiles())
    assert table.remove_old(keep=1) and set(table.read().inputFiles()) == files and table.versions() == [3]


def test_failed_and_late_commits(spark, monkeypatch):
    table = VersionedTable(spark, scratch(spark, "devices"), buckets=4)
    table.upsert(load(spark, [("1", "a", "x", 1)]))
    want = shown(table.read())

    def broken(self, version, manifest):
        raise OSError("down")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", broken)
        with pytest.raises(OSError, match="down"):
            table.upsert(load(spark, [("1", "b", "x", 1)]))
    assert table.version() == 1 and shown(table.read()) == want
    with pytest.raises(versioned.Conflict):  # another load was faster
        table._commit(1, {})
    assert table.upsert(load(spark, [("1", "b", "x", 1)])) == 2 and shown(table.read())[0][1] == "b"


def test_texts_are_embedded_once(spark):
    root = scratch(spark, "vectors")
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None), (5, "")], "id int, content string")
    first, n = vector_store.embedded(rows, HashingEmbedder(16), root, "hash-1")
    again, m = vector_store.embedded(rows, HashingEmbedder(16), root, "hash-1")
    assert (n, m) == (3, 0)
    want = {i: None if t is None else HashingEmbedder(16).embed([t])[0] for i, t in [(1, "a b"), (2, "a b"), (3, "c"), (4, None), (5, "")]}
    for found in (first, again):
        assert {r.id: r.embedding for r in found.collect()} == {i: None if v is None else pytest.approx(v) for i, v in want.items()}
    more = rows.unionByName(spark.createDataFrame([(6, "d"), (7, "d")], "id int, content string"))
    assert vector_store.embedded(more, HashingEmbedder(16), root, "hash-1")[1] == 1
    assert vector_store.embedded(rows, HashingEmbedder(16), root, "hash-2")[1] == 3
    assert vector_store.embedded(rows.limit(0), HashingEmbedder(16), root, "hash-1")[0].collect() == []
    with pytest.raises(ValueError, match="name"):
        vector_store.embedded(rows, HashingEmbedder(16), root, "a/b")


def test_two_users_of_one_table(spark):
    rows = spark.createDataFrame([(1, "en"), (2, "de"), (3, None)], "id int, lang string")
    policies.protect(spark, rows, "guarded", {"o'ne": "lang = 'en'", "two": "lang is null or id > 1", "all": "true"})
    seen = {}
    for user in ("o'ne", "two", "all", "nobody", ""):
        policies.act_as(spark, user)
        seen[user] = sorted(r.id for r in spark.sql("SELECT * FROM guarded").collect())
        assert seen[user] == sorted(r.id for r in spark.table("guarded").collect())
    assert seen == {"o'ne": [1], "two": [2, 3], "all": [1, 2, 3], "nobody": [], "": []}
    policies.protect(spark, rows, "guarded", {"*": "id = 2"}, variable=False)
    assert [r.id for r in spark.table("guarded").collect()] == [2]


def test_null_members_stay_null(spark):
    """A missing name has a default, a null one is null."""
    from docquarry.operators import feeds

    raw = '{"content": [{"id": "1", "documents": []}, {"id": "2", "name": null, "gtin": null}, {"id": "3", "name": "n", "gtin": "g", "documents": [{"id": "d", "title": "t", "fileUuid": "", "documentType": {"name": "Instructions for use"}}]}]}'
    rows = feeds.product_documents_json(spark.createDataFrame([(raw,), ("not json",), (None,)], "json string"), "u").collect()
    assert [tuple(r) for r in rows] == [("1", "Unknown Product", "N/A", None, None), ("2", None, None, None, None), ("3", "n", "g", "t", None)]
