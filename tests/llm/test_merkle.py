"""The manifest against a tree built in the driver, and its odd cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docquarry.llm import merkle
from docquarry.llm import queries as q

from ..conftest import SF
from .test_registered import odd_dir, texts  # noqa: F401


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(nodes):
    """The root over nodes, and for each node its (place in the run, the run's others) level by level."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for path, k in zip(paths, at):
            run = level[k // 8 * 8 : k // 8 * 8 + 8]
            path.append((k % 8, [*run[: k % 8], *run[k % 8 + 1 :]]))
        level, at = [digest(level[i : i + 8]) for i in range(0, len(level), 8)], [k // 8 for k in at]
    return level[0], paths


def led_to(leaf, path):
    for k, others in path:
        leaf = digest([*others[:k], leaf, *others[k:]])
    return leaf


def brute(rows):
    """{doc_id: what op11 returns for it} of rows (doc_id, source, lang, n_chars, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda r, text: digest(map(framed, (*r[:4], text)))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: r[0]) for g in {r[2] for r in rows}}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climbed([leaf(r, r[4]) for r in groups[g]]) for g in order}
    root, above = climbed([trees[g][0] for g in order])
    found = {}
    for g, upper in zip(order, above):
        for r, path in zip(groups[g], trees[g][1]):
            text = r[4].translate(lower) if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4]
            led = led_to(leaf(r, text), path + upper)
            found[r[0]] = (leaf(r, r[4]), trees[g][0], root, digest(s for _, others in path + upper for s in others), led, led == root)
    return found


def returned(spark, folder):
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return {r.doc_id: tuple(r[n] for n in names) for r in q.op11_merkle_manifest(spark, folder).collect()}


def test_against_sql(spark, duck, same):
    same(q.op11_merkle_manifest(spark, SF), duck, q.oracle_sql()["op11_merkle_manifest"])


@pytest.mark.parametrize("height", [4, 1])
def test_whole_query(spark, odd_dir, monkeypatch, height):  # noqa: F811
    """Blocks of eight leaves make several rounds."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    for folder in (SF, odd_dir[0]):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
        assert returned(spark, folder) == brute(rows)


def test_null_groups_many_groups_and_no_rows(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else "s", [None, "", "é", "b", "zz", f"l{i}"][i % 6], i if i % 4 else None, [None, "", "Aa:1", "-"][i % 4]) for i in range(120)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert returned(spark, f"{tmp_path}/a") == brute(rows)
    spark.createDataFrame(rows[:1], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert returned(spark, f"{tmp_path}/b") == brute(rows[:1])  # a lone leaf is the root, and its proof is empty
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/c/documents.parquet")
    assert returned(spark, f"{tmp_path}/c") == {}


def test_equal_rows_each_have_a_leaf(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (1, "b")], "k long, group string").select("k", "group", merkle.leaf(F.col("k")).alias("digest"))
    made = merkle.folded(merkle.manifest(rows, [F.col("k").asc_nulls_first()]), "digest", "led")
    assert sorted(((r.group or "", r.place, r.n) for r in made.collect())) == [("", 0, 1), ("a", 0, 3), ("a", 1, 3), ("a", 2, 3), ("b", 0, 1)]
    assert all(r.led == r.root for r in made.collect())
    with pytest.raises(ValueError, match="place"):
        merkle.manifest(rows.withColumn("place", F.lit(1)), [])


def test_walk_equals_the_levels():
    for n in (1, 2, 8, 9, 64, 65, 100, 520):
        leaves = [random.Random(i).randbytes(32) for i in range(n)]
        root, paths = climbed([x.hex() for x in leaves])
        top, siblings = merkle.walk(leaves, 0, n)
        assert top.hex() == root
        assert [s.hex() for s in siblings] == ["".join(x for _, others in p for x in others) for p in paths]
        assert all(merkle.fold(d, s, [(i, n)]) == top for i, (d, s) in enumerate(zip(leaves, siblings)))
        assert n == 1 or merkle.fold(b"\0" * 32, siblings[0], [(0, n)]) != top
