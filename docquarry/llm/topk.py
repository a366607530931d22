"""Exact top-k search by inner product with a three-phase uniform threshold.

The components are dealt to LISTS lists; a vector's score is the sum of its scores in the lists. Queries are packed into blocks of bounded size, files in the
shared folder; each task holds its partition of the vectors and takes one block of queries after another.

1. Gather: a task returns, for each query, the whole scores of the K vectors that lead each of its local lists. The K-th best of these scores of all tasks is a
   safe cutoff: K vectors reach it. Cutoffs are written beside the query blocks.
2. Collect: a vector whose score in no list reaches cutoff / LISTS can't reach the cutoff. All pairs are tested so at once; there is no selection for each query any more.
3. Resolve: only the pairs that are left are summed over their lists, and of those that reach the cutoff the K best of a query and task are returned and ranked.

No query comes to the driver; it knows the names of the blocks, one for each BLOCK queries. Scores are integers and exact: 64-bit floats hold them while they
stay below 2^53, which is checked, and Python's integers else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, materialise, remove, shared_path, small_batches, tidy

LISTS = 4
#: Queries of a block, and bytes of its vectors.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Scores that are held at once.
AT_ONCE = 1 << 21
FOUND = "query_id long, vec_id long, score decimal(38,0)"
#: Whole numbers in floats are exact below this.
EXACT = 2.0**53


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): the vectors with floor(scale * x) for each component, as doubles; without null vectors, null ids, and null or non-finite components."""
    doubles = F.col(vector_col).cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(doubles, lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def blocks_of(queries: DataFrame, store: Store) -> DataFrame:
    """(block, size, ids): the queries packed into files of one dimension each, BLOCK rows and BLOCK_BYTES at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, waiting = TaskContext.get().partitionId(), 0, {}

        def packed(size: int) -> pa.RecordBatch:
            nonlocal number
            name, number, rows = f"{part}-{number}", number + 1, waiting.pop(size)
            ids = [i for i, _ in rows]
            store.write(pa.table({"ids": pa.array([ids], pa.list_(pa.int64())), "body": pa.array([np.array([v for _, v in rows], np.float64).tobytes()], pa.large_binary())}), name)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int32()), pa.array([ids], pa.list_(pa.int64()))], ["block", "size", "ids"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = waiting.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) >= max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, len(v))))):
                    yield packed(len(v))
        for size in list(waiting):
            yield packed(size)

    return materialise(queries.mapInArrow(run, "block string, size int, ids array<long>"), "query-blocks")


def matrices(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a partition, by dimension."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        sizes, ids, v = batch.column(1).value_lengths().to_numpy(), batch.column(0).to_numpy(), batch.column(1)
        for size in np.flatnonzero(np.bincount(sizes)).tolist() if len(sizes) else []:
            mine = np.flatnonzero(sizes == size)
            found.setdefault(size, []).append((ids[mine], v.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)))
    return {size: tuple(np.concatenate(x) for x in zip(*parts)) for size, parts in found.items()}


def list_scores(q: np.ndarray, x: np.ndarray, lists: int) -> list[np.ndarray]:
    """Exact scores in each list, a row for each query: doubles where whole scores are exact in them, else Python's integers."""
    cuts = np.linspace(0, x.shape[1], min(lists, max(1, x.shape[1])) + 1).astype(int)
    if x.size and q.size and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] >= EXACT:
        x, q = (np.array([[int(c) for c in r] for r in m], object).reshape(m.shape) for m in (x, q))
    return [q[:, a:b] @ x[:, a:b].T for a, b in zip(cuts, cuts[1:])]


def leaders(parts: list[np.ndarray], other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places of the k best pairs of each query in each list; other: which pairs count."""
    found = []
    for part in parts:
        if part.dtype == object:
            found += [(j, i) for j in range(len(part)) for i in sorted(np.flatnonzero(other[j]).tolist(), key=lambda i: -part[j, i])[:k]]
            continue
        part = np.where(other, part, -np.inf)
        n = min(k, part.shape[1])
        at = np.argpartition(part, part.shape[1] - n, axis=1)[:, part.shape[1] - n :]
        found += zip(np.repeat(np.arange(len(part)), n).tolist(), at.ravel().tolist())
    pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
    pairs = pairs[other[pairs[:, 0], pairs[:, 1]]]
    return pairs[:, 0], pairs[:, 1]


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best scores of each query, ties to the lesser id."""
    if score.dtype == object:
        order = np.array(sorted(range(len(score)), key=lambda p: (query[p], -score[p], ids[p])), np.int64)
    else:
        order = np.lexsort((ids, -score, query))
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[rank < k]


def rows_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    from decimal import Decimal

    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array([Decimal(int(s)) for s in score], pa.decimal128(38, 0))], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, lists: int = LISTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (decimal(38,0)): for each row of queries the k vectors with the greatest inner product, or all if there are fewer; ties go to the lesser id.

    A query isn't compared with rows of its own id. Vectors or ids that are null, and vectors with null or non-finite components, take no part;
    vectors of another number of components than the query's don't either. Repeated rows of vectors stand for themselves; repeated rows of
    queries count once, and of queries that repeat an id with other vectors one is taken. An empty table on either side gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    store = Store(shared_path(spark, "queries"))
    every = quantised(vectors, id_col, vector_col, scale)
    asked = quantised(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    packed = blocks_of(asked.coalesce(max(1, -(-asked.count() // BLOCK))), store)
    names = [(r["block"], r["size"]) for r in packed.select("block", "size").collect()]  # a row for each BLOCK queries

    def run(batches: Iterator[pa.RecordBatch], phase: int) -> Iterator[pa.RecordBatch]:
        held = matrices(batches)
        for name, size in names:
            if size not in held:
                continue
            ids, x = held[size]
            block = store.read(name)
            asked = np.array(block.column("ids")[0].as_py(), np.int64)
            q = np.frombuffer(block.column("body")[0].as_buffer(), np.float64).reshape(len(asked), size)
            cutoff = None
            if phase > 1:
                known = store.read(f"{name}.cutoffs")
                cutoff = np.array([int(c) if c is not None else None for c in known.column("cutoff").to_pylist()], object)
            step, found = max(256, AT_ONCE // len(asked)), []
            for at in range(0, len(ids), step):
                some = ids[at : at + step]
                parts = list_scores(q, x[at : at + step], lists)
                other = asked[:, None] != some[None, :]
                if cutoff is None:
                    j, i = leaders(parts, other, k)
                else:
                    exact = parts[0].dtype == object
                    least = np.array([-float("inf") if c is None else c if exact else float(c) for c in cutoff], object if exact else np.float64)[:, None]
                    enough = np.zeros(other.shape, bool)
                    for part in parts:
                        enough |= (part * len(parts) >= least).astype(bool)
                    j, i = np.nonzero(enough & other)
                whole = sum(part[j, i] for part in parts)
                if cutoff is not None:
                    reach = (whole >= least[j, 0]).astype(bool)
                    j, i, whole = j[reach], i[reach], whole[reach]
                top = best(j, some[i], whole, k)
                found.append((j[top], some[i[top]], whole[top]))
            j, some, whole = (np.concatenate(c) for c in zip(*found))
            top = best(j, some, whole, k)
            yield rows_of(asked[j[top]], some[top], whole[top])
        tidy()

    gathered = every.mapInArrow(lambda batches: run(batches, 1), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    last = gathered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))

    def put(group: pa.Table) -> pa.Table:
        name, by = group.column("block")[0].as_py(), dict(zip(group.column("query_id").to_pylist(), group.column("cutoff").to_pylist()))
        ids = store.read(name).column("ids")[0].as_py()
        store.write(pa.table({"cutoff": pa.array([by[i] for i in ids], pa.decimal128(38, 0))}), f"{name}.cutoffs")
        return pa.table({"block": [name]})

    placed = packed.select("block", F.explode("ids").alias("query_id")).join(last, "query_id", "left")
    materialise(placed.groupBy("block").applyInArrow(put, "block string"), "cutoffs")
    found = materialise(every.mapInArrow(lambda batches: run(batches, 2), FOUND), "found")
    remove(spark, store.root)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
