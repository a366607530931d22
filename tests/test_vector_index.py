"""The vector index against brute force: metrics, odd vectors, ties, several blocks and packs, pruning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import matching, vector_index
from docquarry.operators.vector_index import VectorIndex
from docquarry.session import scratch

from .conftest import SF

random.seed(5)
#: Clusters of vectors, copies, and vectors that have no place in an index.
CLUSTERED = [(i, [random.gauss(10 * (i % 6 == d), 0.3) for d in range(6)]) for i in range(600)]
ODD = [(700, None), (701, [0.0] * 6), (702, [1.0, 2.0]), (703, [float("nan")] * 6), (704, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (705, []), *((710 + i, CLUSTERED[3][1]) for i in range(40))]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(CLUSTERED + ODD, "id long, embedding array<double>").repartition(3)


def brute(metric, q, k):
    v = [(i, np.array(x)) for i, x in CLUSTERED + ODD if x is not None and len(x) == 6 and None not in x and np.isfinite(x).all() and (metric == "inner" or any(x))]
    q = np.array(q)
    cost = [(round(1 - float(x @ q) / float(np.linalg.norm(x) * np.linalg.norm(q)), 9) if metric == "cosine" else round(-float(x @ q), 9), i) for i, x in v]
    return [i for _, i in sorted(cost)[:k]]


@pytest.mark.parametrize("metric", ["cosine", "inner"])
@pytest.mark.parametrize("block_bytes", [vector_index.BLOCK_BYTES, 480])
def test_exact_search(spark, rows, monkeypatch, metric, block_bytes):
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(vector_index, "PACKED", 20)
    monkeypatch.setattr(vector_index, "TASK_ROWS", 100)
    index = VectorIndex.build(rows, scratch(spark, "index"), metric=metric)
    kept = set(range(700)) & {i for i, _ in CLUSTERED} | {710 + i for i in range(40)} | ({701} if metric == "inner" else set())
    assert index.rows.sum() == len(kept)
    assert {r.id for r in index.apart().collect()} == {i for i, _ in CLUSTERED + ODD} - kept
    asked = rows.where("id % 7 = 0 or id >= 700")
    got = {}
    for r in sorted(index.search(asked, 5).collect(), key=lambda r: (r.q_id, r.rk)):
        got.setdefault(r.q_id, []).append(r.id)
    want = {i: brute(metric, x, 5) for i, x in CLUSTERED + ODD if (i % 7 == 0 or i >= 700) and i in kept}
    assert got == want


def test_other_lists_and_blocks_are_not_read(spark, rows):
    """On clusters, the cutoff of the nearest lists leaves the others out, and of their files none is opened."""
    index = VectorIndex.build(rows, scratch(spark, "index"), lists=6)
    asking = rows.where("id = 12").select(F.col("id").alias("q_id"), F.col("embedding").alias("v"), F.lit(0.01).alias("cutoff"))
    assert index.asked(asking, 1, cutoffs=True).count() == 0
    reads = index.reads(rows.where("id < 60"), 1).collect()
    assert all(r.lists == 1 and r.rows < 300 for r in reads)
    plan = index.blocks_at(spark, index.path).where(F.col("list").isin([1, 2]))
    files = {f for f in plan.inputFiles()}
    scanned = plan._jdf.queryExecution().executedPlan().toString()
    assert len(files) > 2 and "PartitionFilters: [" in scanned and "list" in scanned.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_and_all_apart(spark):
    for data in ([], [(1, None), (2, [0.0, 0.0])]):
        frame = spark.createDataFrame(data, "id long, embedding array<double>")
        index = VectorIndex.build(frame, scratch(spark, "index"))
        assert index.search(frame, 3).collect() == [] and index.apart().count() == len(data)
    with pytest.raises(ValueError, match="metric"):
        VectorIndex.build(frame, scratch(spark, "index"), metric="other")


@pytest.mark.parametrize("k", [3, 700])
def test_nearest_by_index_equals_nearest_without(spark, rows, monkeypatch, k):
    """Null, zero and shorter vectors included, on both sides."""
    asked = rows.where("id % 50 = 0 or id between 700 and 711")
    get = lambda: sorted((r.q_id, r.rk, r.id, None if r.distance is None else repr(round(r.distance, 9))) for r in matching.nearest(rows, asked, k, key="id", query_key="id").collect())
    want = get()
    monkeypatch.setattr(matching, "TOGETHER", 10)
    assert get() == want


def test_nearest_searches_once(spark, rows, monkeypatch):
    """The result is read for the union and for the queries that are short of rows; the search isn't part of either plan."""
    monkeypatch.setattr(matching, "TOGETHER", 10)
    plan = matching.nearest(rows, rows, 3, key="id", query_key="id")._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan


def test_recall(spark):
    """Random vectors are the worst case: half of the lists hold nine tenths of the nearest rows."""
    frame = spark.read.parquet(f"{SF.rpartition('/')[0]}/sf0.1/embeddings.parquet")
    index, asked = VectorIndex.build(frame, scratch(spark, "index"), "vec_id"), frame.where("vec_id % 10 = 0")
    exact, near = ({(r.q_id, r.id) for r in index.search(asked, 5, p, "vec_id").collect()} for p in (None, len(index.centroids) // 2))
    assert len(exact & near) >= 0.9 * len(exact)


def test_queries_go_in_packs(spark, rows):
    """Queries and lists don't multiply into rows: a pack holds its queries once, whatever it asks for."""
    index = VectorIndex.build(rows, scratch(spark, "index"))
    asking = rows.select(F.col("id").alias("q_id"), F.col("embedding").alias("v"), F.lit(float("inf")).alias("cutoff"))
    packs = index.asked(asking, len(index.centroids)).collect()
    assert len(packs) == 1 and len(packs[0].lists) > 10
    assert sorted(packs[0].q_ids) == sorted(r.id for r in rows.where("id < 600 or id >= 710").collect())


def test_what_is_shuffled_grows_with_the_rows(spark, monkeypatch):
    """Packs meet blocks in every pairing, but no pairing is written: four times the rows as queries, about four times the shuffle."""
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(vector_index, "PACKED", 50)
    context, written = spark.sparkContext._jsc.sc(), []
    for n in (1000, 4000):
        v = np.random.default_rng(n).random((n, 8)).astype(np.float32)
        frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, embedding array<float>").repartition(4).localCheckpoint()
        index = VectorIndex.build(frame, scratch(spark, "index"), lists=8)
        shuffled = lambda: (context.listenerBus().waitUntilEmpty(), context.statusStore().executorSummary("driver").totalShuffleWrite())[1]
        before = shuffled()
        found = {(r.q_id, r.rk): r.id for r in index.search(frame, 3).collect()}
        written.append(shuffled() - before)
        x = v[:40].astype(float)
        cost = np.round(1 - x @ v.T.astype(float) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(v.astype(float), axis=1)), 12)
        assert len(found) == 3 * n and [[found[q, rk] for rk in (1, 2, 3)] for q in range(40)] == np.argsort(cost, 1, kind="stable")[:, :3].tolist()
    assert written[1] < 6 * written[0], written


def test_distances_at_once():
    """A pack against all rows of a group: not all distances are held together."""
    import tracemalloc

    import pandas as pd

    v, asked = np.random.default_rng(1).random((4600, 3)), 1600
    group = pd.DataFrame({"q_id": pd.array([*range(asked), *[None] * (len(v) - asked)], "Float64").to_numpy(float, na_value=np.nan), "id": np.arange(len(v)), "v": list(v)})
    tracemalloc.start()
    found = matching._pack_search(group, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2 * asked and peak < 48 << 20


def test_numbers_at_once(spark, monkeypatch):
    """What tasks hold beside their input doesn't grow with a batch, nor with a pack of queries times a tile, also where all rows tie."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    tasks, mapped, cogrouped = [], DataFrame.mapInArrow, PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a: (tasks.append(f), mapped(self, f, *a))[1])
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, *a: (tasks.append(f), cogrouped(self, f, *a))[1])
    dim, n, asked = 16, 40_000, 4096
    data = spark.createDataFrame([(i, [float(i == d) + 0.1 for d in range(dim)]) for i in range(dim)], "id long, embedding array<double>")
    index = VectorIndex.build(data, scratch(spark, "index"), lists=4)
    asking = data.select(F.col("id").alias("q_id"), F.col("embedding").alias("v"), F.lit(float("inf")).alias("cutoff"))
    index.scan(index.asked(asking, 1), 5)
    assign, _, placed, packed, best = tasks

    def peak(run):
        run()  # imports and the like
        tracemalloc.start()
        found = run()
        most = tracemalloc.get_traced_memory()[1] / (1 << 20)
        tracemalloc.stop()
        return found, most

    v = np.random.default_rng(2).random((n, dim))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), flat, pa.array(np.full(n, np.inf))], names=["id", "v", "cutoff"])
    for task in (assign, placed):
        rows, most = peak(lambda: sum(b.num_rows for b in task(iter([batch]))))  # noqa: B023
        assert rows == n and most < 8, (task.__name__, most)

    one = np.tile(np.ones(dim) / np.sqrt(dim), (asked, 1))
    queries = pa.table({"q_id": np.arange(asked), "own": pa.array(np.zeros(asked), pa.int32()), "cutoff": np.full(asked, np.inf), "q": pa.array([r.tobytes() for r in one], pa.binary())})
    (pack,), most = peak(lambda: list(packed(iter(queries.to_batches()))))
    assert len(pack["lists"][0]) == 1 and len(pack["lists"][0][0]["mask"].as_py()) == asked // 8 and most < 16, most
    left = pa.Table.from_batches([pack])
    ids = pa.ListArray.from_arrays(pa.array([0, asked], pa.int32()), pa.array(np.arange(asked)[::-1]))
    right = pa.table({"n": [asked], "ids": ids, "body": pa.array([one.tobytes()], pa.binary()), "mask": pack["lists"].values.field("mask")})
    found, most = peak(lambda: best(left, right))
    assert sorted(zip(found["q_id"].to_pylist(), found["id"].to_pylist())) == [(q, i) for q in range(asked) for i in range(5)]
    assert most < 48, most
