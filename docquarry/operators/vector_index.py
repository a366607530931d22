"""A stored inverted-file index of vectors, for approximate search and for exact search with pruning.

Vectors are dealt to lists by their nearest centroid. A list is stored in the order of distance from its centroid, in blocks of BLOCK_BYTES, each with its ring: the least and the greatest of
these distances. Files are partitioned by list, so that a search reads the lists that it asks for and no others.

An approximate search scans the `probes` nearest lists of each query. An exact one takes the k-th best cost of the nearest list as a cutoff and then scans what the triangle inequality leaves: with D
between query and centroid, no vector of a ring is nearer than D - far or near - D (cosine, on unit vectors); none has a product above that of the centroid plus far times the query's length (inner
product). Lists are passed over as wholes first, then blocks. Queries go in packs of neighbours, each with a bit for every query and list that it asks for. Only the packs are shuffled: a task takes one
and reads the lists' files from the shared folder, block by block, so packs meet blocks without a copy of either for each meeting. Cutoffs fall as it goes, and it gives each query's k best only, from
COSTS costs at a time. Where there are fewer packs than tasks that can run, a pack goes to several, with a share of the lists for each.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import scratch

#: Lists at most, and sampled vectors for each from which centroids are made on the driver; every vector is indexed.
LISTS, SAMPLED = 1024, 32
#: Bytes of a block and of a pack's vectors, vectors that a task sorts, queries of a pack at most, costs (or numbers of vectors that come in) that a task takes at once, and rounds of the clustering.
BLOCK_BYTES, TASK_ROWS, PACKED, COSTS, ROUNDS = 4 << 20, 200_000, 8192, 1 << 17, 8
#: Decimals of a cost: equal vectors tie. Bounds are slack by more than products are off.
DECIMALS, SLACK = 12, 1e-9


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(-1))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    half, step = (centroids * centroids).sum(1) / 2, max(1, COSTS // len(centroids))
    return np.concatenate([np.zeros(0, np.int64), *((x[i : i + step] @ centroids.T - half).argmax(1) for i in range(0, len(x), step))])


def _centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of a clustering of the sample, from rows that a fixed seed chooses."""
    found = sample[np.random.default_rng(7).choice(len(sample), lists, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = _nearest(sample, found)
        order = np.argsort(nearest, kind="stable")
        have, begin = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(sample[order], begin)
        found[have] = sums / np.diff(np.append(begin, len(order)))[:, None]
    return found


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of an array<double> column as rows, zeros where there is none of this dimension; and which of them are whole and finite."""
    good = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    out, found = np.zeros((len(column), dim)), column.filter(good)
    good = good.to_numpy(zero_copy_only=False)
    out[good] = found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), dim)  # a null is NaN here
    finite = np.isfinite(out).all(1)
    out[~finite] = 0
    return out, good & finite


def _parts(batches, dim: int):
    """The batches in parts of COSTS numbers at most: what is made of a part doesn't grow with the batch."""
    step = max(1, COSTS // max(1, dim))
    for batch in batches:
        yield from (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def _floats(body: bytes, n: int, dim: int) -> np.ndarray:
    """n vectors that are stored as bytes of 32-bit or 64-bit numbers."""
    return np.frombuffer(body, "<f4" if len(body) == 4 * dim * n else "<f8").reshape(n, dim).astype(np.float64)


def _queries(body: bytes, n: int, dim: int, cosine: bool) -> np.ndarray:
    """n queries as they are compared. Those in 32-bit numbers are stored as they came, the others by cosine with unit length."""
    x = _floats(body, n, dim)
    return x / _length(x)[:, None] if cosine and len(body) == 4 * dim * n else x


def _slack(limit: np.ndarray) -> np.ndarray:
    return limit + SLACK * np.maximum(1, np.abs(limit))


def _stored(system, name: str):
    """The blocks of a file, one after another."""
    with system.open_input_file(name) as f:
        yield from pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(1, columns=["near", "far", "n", "ids", "body"], use_threads=False)


def _bounds(metric: str, centroids: np.ndarray, radius: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query and list: what orders the lists (the distance or negative product of the centroid), and the least cost that a vector of the list can have."""
    product = x @ centroids.T
    if metric == "inner":
        return -product, -(product + _length(x)[:, None] * radius)
    away = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (centroids**2).sum(1) - 2 * product))
    return away, np.maximum(0, away - radius) ** 2 / 2


@dataclass
class VectorIndex:
    """An index at a path, opened. metric: "cosine" (cost: 1 - cosine) or "inner" (cost: the negative product)."""

    spark: SparkSession
    path: str
    metric: str
    dim: int
    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    @classmethod
    def build(cls, chunks: DataFrame, path: str, key: str = "id", vector: str = "embedding", metric: str = "cosine", dim: int | None = None, lists: int | None = None) -> VectorIndex:
        """Index the vectors of one dimension (None: the commonest one) at a new path. Keys must not be null; those of vectors that have no place in the index (null, of another dimension, with a
        null or non-finite component, of length zero by cosine) are stored beside it, see apart(). lists: None for the square root of the rows, LISTS at most."""
        if metric not in ("cosine", "inner"):
            raise ValueError(f"not a metric: {metric}")
        spark, cosine = chunks.sparkSession, metric == "cosine"
        single = isinstance(chunks.schema[vector].dataType.elementType, T.FloatType)
        rows = chunks.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        sizes = rows.where("v is not null").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim")
        found = (sizes if dim is None else sizes.where(F.col("dim") == dim)).first()
        dim, n = (found["dim"], found["count"]) if found else (dim or 0, 0)
        lists = min(LISTS, lists or max(1, int(n**0.5)))
        sample = rows.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(max(1, n // (lists * SAMPLED)))) == 0)).select("v").limit(2 * lists * SAMPLED)
        x, good = _matrix(sample.toArrow().column("v").combine_chunks(), dim) if n else (np.zeros((0, dim)), np.zeros(0, bool))  # LISTS * SAMPLED * 2 vectors at most
        x = x[good & (_length(x) > 0)]
        x = x / _length(x)[:, None] if cosine else x
        centroids = _centroids(x, min(lists, len(x))) if len(x) else np.zeros((1, dim))

        def assign(batches):
            for batch in _parts(batches, dim):
                x, good = _matrix(batch.column(1), dim)
                length = _length(x)
                good &= (length > 0) | (not cosine)
                u = x / np.where(length > 0, length, 1)[:, None] if cosine else x
                own = _nearest(u, centroids)
                away = _length(u - centroids[own])
                kept = x.astype("<f4" if single else "<f8")
                columns = [batch.column(0), pa.array(np.where(good, own, -1).astype(np.int32)), pa.array(away), pa.array([r.tobytes() if g else None for r, g in zip(kept, good)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pc.list_value_length(batch.column(1))], names=["id", "list", "away", "body", "dim"])

        kind = rows.schema["id"].dataType.simpleString()
        rows.mapInArrow(assign, f"id {kind}, list int, away double, body binary, dim int").write.parquet(f"{path}/assigned")
        assigned = spark.read.parquet(f"{path}/assigned")
        assigned.where("list < 0").select("id", "dim").write.parquet(f"{path}/apart")
        most = max(1, BLOCK_BYTES // max(1, dim * (4 if single else 8)))

        def pack(batches):
            waiting: list[pa.RecordBatch] = []

            def block(parts):
                t = pa.Table.from_batches(parts)
                away = t["away"].to_numpy()
                body = b"".join(t["body"].to_pylist())
                ids = pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t["id"].combine_chunks())
                columns = [t["list"].slice(0, 1).combine_chunks(), pa.array([float(away.min())]), pa.array([float(away.max())]), pa.array([len(t)]), ids, pa.array([body], pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["list", "near", "far", "n", "ids", "body"])

            for batch in batches:
                own = batch.column(1).to_numpy()
                cuts = np.flatnonzero(np.diff(own)) + 1
                for begin, end in zip([0, *cuts], [*cuts, len(own)]):
                    part = batch.slice(begin, end - begin)
                    if waiting and waiting[0].column(1)[0] != part.column(1)[0]:
                        yield block(waiting)
                        waiting = []
                    while part.num_rows:
                        room = most - sum(b.num_rows for b in waiting)
                        waiting.append(part.slice(0, room))
                        part = part.slice(room)
                        if sum(b.num_rows for b in waiting) >= most:
                            yield block(waiting)
                            waiting = []
            if waiting:
                yield block(waiting)

        dealt = assigned.where("list >= 0").select("id", "list", "away", "body").repartitionByRange(max(1, -(-n // TASK_ROWS)), "list", "away", "id").sortWithinPartitions("list", "away", "id")
        blocks = dealt.mapInArrow(pack, f"list int, near double, far double, n long, ids array<{kind}>, body binary").withColumn("block", F.uuid())
        blocks.write.option("parquet.page.row.count.limit", 1).partitionBy("list").parquet(f"{path}/blocks")  # tasks read them block by block
        made = cls.blocks_at(spark, path).groupBy("list").agg(F.sum("n").alias("rows"), F.max("far").alias("radius"))
        held = {r["list"]: r for r in made.collect()}  # LISTS at most
        lists_table = [(i, c.tolist(), held[i]["radius"] if i in held else 0.0, held[i]["rows"] if i in held else 0, metric) for i, c in enumerate(centroids)]
        spark.createDataFrame(lists_table, "list int, centroid array<double>, radius double, rows long, metric string").coalesce(1).write.parquet(f"{path}/lists")
        return cls.open(spark, path)

    @staticmethod
    def blocks_at(spark: SparkSession, path: str) -> DataFrame:
        kind = spark.read.parquet(f"{path}/apart").schema["id"].dataType.simpleString()
        return spark.read.schema(f"near double, far double, n long, ids array<{kind}>, body binary, block string, list int").parquet(f"{path}/blocks")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        """An index that build() has stored."""
        rows = sorted(spark.read.parquet(f"{path}/lists").collect())  # LISTS at most
        x = np.array([r["centroid"] for r in rows])
        return cls(spark, path, rows[0]["metric"], x.shape[1], x, np.array([r["radius"] for r in rows]), np.array([r["rows"] for r in rows]))

    def apart(self) -> DataFrame:
        """(id, dim) of the rows that the index can't hold; dim is null for null vectors."""
        return self.spark.read.parquet(f"{self.path}/apart")

    def _takes(self, probes: int, cutoffs: bool):
        """A function of queries and their limits, for tasks: it gives `at` of _bounds() and which lists each query scans."""
        metric, centroids, radius, filled = self.metric, self.centroids, self.radius, self.rows > 0

        def take(x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, least = _bounds(metric, centroids, radius, x)
            first = np.zeros(at.shape, bool)
            if probes:
                np.put_along_axis(first, np.argsort(np.where(filled, at, np.inf), 1, kind="stable")[:, :probes], True, 1)
            return at, (~first & (least <= limit[:, None]) if cutoffs else first) & filled

        return take, max(8, COSTS // max(len(centroids), self.dim) // 8 * 8)  # eights: their bits fill bytes

    def _placed(self, queries: DataFrame) -> DataFrame:
        """(q_id, own, cutoff, q): queries (q_id, v, cutoff) with a place in the index, their nearest list and vector, see _queries()."""
        metric, dim, centroids = self.metric, self.dim, self.centroids
        single = isinstance(queries.schema["v"].dataType.elementType, T.FloatType)

        def run(batches):
            for batch in _parts(batches, dim):
                x, good = _matrix(batch.column(1), dim)
                length = _length(x)
                good &= (length > 0) | (metric == "inner")
                kept = x[good].astype("<f4") if single else None
                x = (x / np.where(length > 0, length, 1)[:, None] if metric == "cosine" else x)[good]
                some = pa.array(np.flatnonzero(good))
                columns = [batch.column(0).take(some), pa.array(_nearest(x, centroids).astype(np.int32)), batch.column(2).take(some), pa.array([r.tobytes() for r in (kept if single else x)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["q_id", "own", "cutoff", "q"])

        kind = queries.schema["q_id"].dataType.simpleString()
        return queries.select("q_id", "v", "cutoff").mapInArrow(run, f"q_id {kind}, own int, cutoff double, q binary")

    def asked(self, queries: DataFrame, probes: int, cutoffs: bool = False) -> DataFrame:
        """(pack, q_ids, cutoffs, q, lists): packs of queries (q_id, v, and its cutoff), neighbours together, with the lists to scan: the `probes` nearest of each query, or with cutoffs all others that can
        hold a row within them. A list has a bit for each query of the pack.

        Queries without a place in the index are in no pack, packs without a list are left out."""
        dim, cosine = self.dim, self.metric == "cosine"
        take, step = self._takes(probes, cutoffs)
        most = max(1, min(PACKED, BLOCK_BYTES // max(1, 8 * dim)))

        def made(parts):
            t = pa.Table.from_batches(parts)
            q = b"".join(t["q"].to_pylist())
            x = _queries(q, len(t), dim, cosine)
            cutoff = t["cutoff"].to_numpy()
            limit = _slack(cutoff)
            bits = np.concatenate([np.packbits(take(x[i : i + step], limit[i : i + step])[1], axis=0) for i in range(0, len(x), step)])
            lists = [{"list": int(j), "mask": bits[:, j].tobytes()} for j in np.flatnonzero(bits.any(0))]
            if lists:
                ids = pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t["q_id"].combine_chunks())
                kind = pa.list_(pa.struct([("list", pa.int32()), ("mask", pa.binary())]))
                columns = [pa.array([uuid.uuid4().hex]), ids, pa.array([cutoff.tobytes()], pa.binary()), pa.array([q], pa.binary()), pa.array([lists], kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["pack", "q_ids", "cutoffs", "q", "lists"])

        def pack(batches):
            waiting, n = [], 0
            for batch in batches:
                while batch.num_rows:
                    part = batch.slice(0, most - n)
                    batch, n = batch.slice(part.num_rows), n + part.num_rows
                    waiting.append(part)
                    if n == most:
                        yield from made(waiting)
                        waiting, n = [], 0
            if waiting:
                yield from made(waiting)

        placed = self._kept(self._placed(queries), "placed")
        dealt = placed.repartitionByRange(max(1, -(-placed.count() // most)), "own", "q_id").sortWithinPartitions("own", "q_id")
        kind = placed.schema["q_id"].dataType.simpleString()
        return dealt.mapInArrow(pack, f"pack string, q_ids array<{kind}>, cutoffs binary, q binary, lists array<struct<list int, mask binary>>")

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows as a table in the shared folder."""
        path = scratch(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _files(self) -> tuple[str, dict[int, list[tuple[str, float, float]]]]:
        """The folder of the blocks, and each list's files in it, with the least and the greatest distance of their rings."""
        ends = self.blocks_at(self.spark, self.path).groupBy("list", F.col("_metadata.file_path").alias("file")).agg(F.min("near").alias("near"), F.max("far").alias("far"))
        folder, found = "", {}
        for r in ends.collect():  # a file for each list, and one more for each TASK_ROWS rows
            folder, at, name = r["file"].rsplit("/", 2)
            found.setdefault(r["list"], []).append((f"{at}/{name}", r["near"], r["far"]))
        return folder, found

    def scan(self, asked: DataFrame, k: int, exact: bool = False) -> DataFrame:
        """(q_id, id, cost): for each query the k best rows of each share of its lists, among those of the blocks that the rings leave. exact: every list is asked for, so the nearest one gives a cutoff."""
        asked = self._kept(asked, "asked")
        folder, files = self._files()
        packs, running = asked.count(), self.spark.sparkContext.defaultParallelism
        shares = min(max(1, len(files)), -(-2 * running // max(1, packs)))
        parts = packs * shares + running
        left = asked.select("pack", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "q_ids", "cutoffs", "q").repartition(parts, "pack", "share")
        right = asked.select(F.col("pack").alias("of"), F.inline("lists")).withColumn("of_share", F.pmod("list", F.lit(shares))).repartition(parts, "of", "of_share")
        dim, metric, centroids, radius = self.dim, self.metric, self.centroids, self.radius
        cosine, (first, first_step) = metric == "cosine", self._takes(1, False)
        id_type = self.apart().schema["id"].dataType
        id_kind = to_arrow_type(id_type)

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            """left: a pack. right: the lists that it asks for, or blocks themselves."""
            q_ids = left["q_ids"].combine_chunks().flatten()
            if not left.num_rows or not right.num_rows:
                return pa.table({"q_id": q_ids[:0], "id": pa.array([], id_kind), "cost": pa.array([], pa.float64())})
            q = _queries(left["q"][0].as_py(), len(q_ids), dim, cosine)
            limit, length = _slack(np.frombuffer(left["cutoffs"][0].as_py(), np.float64)), _length(q)
            of, ids, costs, held, kept = [np.zeros(0, np.int64)], [pa.array([], id_kind)], [np.zeros(0)], 0, 0

            def least() -> None:
                """Keep the k best of what each query has; what comes must be as good."""
                nonlocal of, ids, costs, held, kept
                i, c, named = np.concatenate(of), np.concatenate(costs), pa.concat_arrays(ids)
                place = np.empty(len(i), np.int64)  # ties go to the lesser id
                place[pc.sort_indices(named).to_numpy()] = np.arange(len(i))
                order = np.lexsort((place, c, i))
                i, c = i[order], c[order]
                starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
                rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
                last = rank == k - 1
                limit[i[last]] = np.minimum(limit[i[last]], _slack(c[last]))
                of, ids, costs = [i[rank < k]], [named.take(pa.array(order[rank < k]))], [c[rank < k]]
                held, kept = 0, len(of[0])

            def meet(block: pa.RecordBatch, members: np.ndarray, collect: bool = True) -> None:
                """A block and some of the queries: what is within their limits, or only what the limits become by it."""
                nonlocal held
                n, names = block.column("n")[0].as_py(), block.column("ids").flatten()
                x, step = _floats(block.column("body")[0].as_py(), n, dim), max(1, COSTS // n)
                if cosine:
                    x /= _length(x)[:, None]
                for some in (members[i : i + step] for i in range(0, len(members), step)):
                    cost = q[some] @ x.T
                    np.subtract(1.0 if cosine else 0.0, cost, out=cost)
                    most = limit[some]
                    if n >= k and (not collect or np.isinf(most).any()):
                        limit[some] = most = np.minimum(most, _slack(np.partition(cost, k - 1, 1)[:, k - 1]))
                    if not collect:
                        continue
                    i, j = np.divmod(np.flatnonzero(cost <= most[:, None]), n)  # much faster than nonzero() in two dimensions
                    if len(i):
                        of.append(some[i])
                        ids.append(names.take(pa.array(j)))
                        costs.append(np.round(cost[i, j], DECIMALS) + 0.0)  # no negative zeros
                        held += len(i)
                        if held > max(COSTS, kept):
                            least()

            def within(at: int, members: np.ndarray, near: float, far: float) -> np.ndarray:
                """The queries for which a ring of a list can hold a row."""
                away, bound = (x[:, 0] for x in _bounds(metric, centroids[at : at + 1], radius[at : at + 1], q[members]))
                most = limit[members]
                if cosine:
                    reach = np.sqrt(2 * np.maximum(0, most))
                    held = (far >= away - reach - SLACK) & (near <= away + reach + SLACK)
                else:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        held = far >= np.where(length[members] > 0, (away - most) / length[members], -np.inf) - SLACK
                return members[held & (bound <= most)]

            def read(at: int, members: np.ndarray, collect: bool = True) -> None:
                for name, near, far in files.get(at, []):
                    if len(within(at, members, near, far)):
                        for block in _stored(system, f"{inner}/{name}"):
                            meet(block, within(at, members, block.column("near")[0].as_py(), block.column("far")[0].as_py()), collect)

            members = lambda mask: np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=len(q)))
            if "body" in right.column_names:
                for block in right.to_batches(max_chunksize=1):
                    meet(block, members(block.column("mask")[0].as_py()))
            else:
                from pyarrow import fs

                system, inner = fs.FileSystem.from_uri(folder)
                if exact:
                    own = np.concatenate([first(q[i : i + first_step], limit[i : i + first_step])[1].argmax(1) for i in range(0, len(q), first_step)])
                    for at in np.unique(own).tolist():
                        read(at, np.flatnonzero(own == at), collect=False)
                lists = right["list"].to_numpy()
                for row in np.argsort(_bounds(metric, centroids[lists], radius[lists], q.mean(0, keepdims=True))[0][0], kind="stable").tolist():
                    read(int(lists[row]), members(right["mask"][row].as_py()))
            least()
            return pa.table({"q_id": q_ids.take(pa.array(of[0])), "id": ids[0], "cost": pa.array(costs[0])})

        kind = asked.schema["q_ids"].dataType.elementType.simpleString()
        return left.groupBy("pack", "share").cogroup(right.groupBy("of", "of_share")).applyInArrow(best, f"q_id {kind}, id {id_type.simpleString()}, cost double")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, query_key: str = "id", vector: str = "embedding") -> DataFrame:
        """(q_id, id, cost, rk): the k rows of least cost for each query, ties to the lesser id; a query without a place in the index has none, nor do rows that are apart.

        probes: None for an exact search, else how many lists are scanned for each query. Query keys must be distinct and not null. Costs are rounded to DECIMALS.
        """
        found = self.scan(self.asked(self._asking(queries, query_key, vector), probes or 0, cutoffs=not probes), k, exact=not probes)
        return found.withColumn("rk", F.row_number().over(Window.partitionBy("q_id").orderBy("cost", "id"))).where(F.col("rk") <= k)

    @staticmethod
    def _asking(queries: DataFrame, query_key: str, vector: str) -> DataFrame:
        """(q_id, v, cutoff): queries without a cutoff; 32-bit vectors stay so."""
        single = isinstance(queries.schema[vector].dataType.elementType, T.FloatType)
        v = F.col(vector) if single else F.col(vector).cast("array<double>")
        return queries.select(F.col(query_key).alias("q_id"), v.alias("v"), F.lit(float("inf")).alias("cutoff"))

    def reads(self, queries: DataFrame, probes: int, query_key: str = "id", vector: str = "embedding") -> DataFrame:
        """(q_id, lists, rows): how many lists and rows an approximate search reads for each query."""
        asking = self._asking(queries, query_key, vector)
        (take, step), dim, held, cosine = self._takes(probes, False), self.dim, self.rows, self.metric == "cosine"

        def run(batches):
            for batch in batches:
                for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                    x = _queries(b"".join(part.column(3).to_pylist()), part.num_rows, dim, cosine)
                    taken = take(x, part.column(2).to_numpy())[1]
                    some = taken.any(1)
                    columns = [part.column(0).filter(pa.array(some)), pa.array(taken.sum(1)[some]), pa.array((taken @ held)[some].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["q_id", "lists", "rows"])

        placed = self._placed(asking)
        return placed.mapInArrow(run, f"q_id {placed.schema['q_id'].dataType.simpleString()}, lists long, rows long")
