"""Exact top-k search by cosine distance."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.jsonfilter import contains
from ..session import scratch
from .vector_index import VectorIndex

#: Queries of a pack, about, rows that are searched without an index, and distances that a task holds at once.
PACKED, TOGETHER, DISTANCES = 2048, 50_000, 1 << 20


def match(chunks: DataFrame, query, k: int | None = None, where: Any = None, vector: str = "embedding", metadata: str | None = "metadata", key: str = "id", inner: bool = False) -> DataFrame:
    """The rows of chunks with `similarity` to the query vector, nearest first, ties by key.

    query: the numbers of a vector, or an expression. k: None for all rows. where: a JSON value that the metadata must contain; rows with null metadata
    never match; with metadata=None nothing is filtered. Rows without a vector come last, vectors of length zero just before them.
    inner: rank by inner product instead of cosine.
    """
    query = query if isinstance(query, Column) else vectors.literal(query)
    found = chunks if metadata is None else chunks.where(contains(F.col(metadata), {} if where is None else where))
    distance = -vectors.inner_product(F.col(vector), query) if inner else vectors.cosine_distance(F.col(vector), query)
    similarity = -F.col("distance") if inner else F.lit(1.0) - F.col("distance")
    found = found.withColumn("distance", distance).withColumn("similarity", similarity).orderBy(F.col("distance").asc_nulls_last(), key).drop("distance")
    return found if k is None else found.limit(k)


def match_documents(chunks: DataFrame, query_embedding, match_count: int | None = None, filter: Any = None) -> DataFrame:  # noqa: A002
    """(id, content, metadata, similarity) of the chunks nearest to a query vector whose metadata contains the filter."""
    return match(chunks, query_embedding, match_count, filter).select("id", "content", "metadata", "similarity")


def with_contents(found: DataFrame, contents: DataFrame, key: str = "id") -> DataFrame:
    """The few rows that a search has found, in their order, with the other columns of contents. The search runs now; its keys become a filter of the contents' scan, which skips the row groups without them."""
    rows = found.collect()  # a search's limit
    keys = [r[key] for r in rows]
    ranked = found.sparkSession.createDataFrame(rows, found.schema)
    return F.broadcast(ranked).join(contents.where(F.col(key).isin(keys)), key)


def nearest(chunks: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", query_key: str = "vec_id") -> DataFrame:
    """(q_id, key, distance, rk): the k rows of chunks nearest to each row of queries by cosine distance, ties by key; keys are distinct whole numbers.

    Distances count to twelve decimals, so that equal vectors tie. Rows at no distance (a null vector on either side, another dimension) come last, vectors of
    length zero before them. Up to TOGETHER rows meet packs of PACKED queries, about, in one task each. More rows are indexed, and only the blocks that can hold one of a query's k nearest
    are read to meet it.
    """
    wanted = queries.select(F.col(query_key).cast("long").alias("q_id"), _numbers(queries, vector).alias("v"))
    few = chunks.limit(TOGETHER + 1).count() <= TOGETHER
    found = _together(chunks, wanted, k, vector, key) if few else _indexed(chunks, wanted, k, vector, key)
    order = Window.partitionBy("q_id").orderBy("far", "distance", "id")
    distance = F.when(F.col("far") == 0, F.col("distance")).when(F.col("far") == 1, F.lit(float("nan")))
    return found.withColumn("rk", F.row_number().over(order).cast("long")).where(F.col("rk") <= k).select("q_id", F.col("id").alias(key), distance.alias("distance"), "rk")


def _numbers(rows: DataFrame, vector: str) -> Column:
    """Vectors of 32-bit numbers as they are, which makes what is stored half as long; others of 64 bits."""
    return F.col(vector) if rows.schema[vector].dataType.simpleString() == "array<float>" else vectors.doubles(F.col(vector))


def _together(chunks: DataFrame, wanted: DataFrame, k: int, vector: str, key: str) -> DataFrame:
    """(q_id, id, distance, far) of few rows: all of them go to each pack of queries."""
    packs = max(1, -(-wanted.count() // PACKED))
    rows = chunks.select(F.lit(None).cast("long").alias("q_id"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    asked = wanted.select("q_id", F.lit(None).cast("long").alias("id"), vectors.doubles(F.col("v")).alias("v"), F.pmod(F.xxhash64("q_id"), F.lit(packs)).cast("int").alias("pack"))
    return asked.unionByName(rows).groupBy("pack").applyInPandas(lambda group: _pack_search(group, k), "q_id long, id long, distance double, far int")


def _indexed(chunks: DataFrame, wanted: DataFrame, k: int, vector: str, key: str) -> DataFrame:
    """(q_id, id, distance, far) by an index for each dimension that rows and queries share; a query with fewer than k rows at a distance gets the first ones of the others."""
    spark = chunks.sparkSession
    length = F.aggregate(vectors.doubles(F.col("v")), F.lit(0.0), lambda a, x: a + x * x)
    kind = lambda df: df.withColumns({"dim": F.when(F.col("v").isNotNull(), F.size("v")), "flat": F.coalesce((length == 0) | F.isnan(length) | (length == F.lit(float("inf"))), F.lit(True))})
    rows = kind(chunks.select(F.col(key).cast("long").alias("id"), _numbers(chunks, vector).alias("v")))
    asked = kind(wanted)
    dims = rows.where("not flat").select("dim").distinct().join(asked.where("not flat").select("dim").distinct(), "dim").collect()  # the models' dimensions
    found = spark.createDataFrame([], "q_id long, id long, distance double, far int")
    for dim in sorted(r["dim"] for r in dims):
        index = VectorIndex.build(rows.where(F.col("dim") == dim), scratch(spark, "vectors"), "id", "v", dim=dim)
        path = scratch(spark, "found")  # read twice below, so that the search runs once
        (searched := index.search(asked.where(F.col("dim") == dim), k, None, "q_id", "v")).write.parquet(path)
        best = spark.read.schema(searched.schema).parquet(path)
        found = found.unionByName(best.select("q_id", "id", F.col("cost").alias("distance"), F.lit(0).alias("far")))
    short = asked.join(found.groupBy("q_id").agg(F.count(F.lit(1)).alias("n")), "q_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("q_id", "dim", "flat")
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("dim", "flat").orderBy("id"))).where(F.col("i") <= k)
    heads = [(r["id"], r["dim"], r["flat"]) for r in first.select("id", "dim", "flat").orderBy("id").collect()]  # 2 * k for each dimension

    def fill(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for q_id, dim, flat in zip(batch["q_id"], batch["dim"], batch["flat"]):
                dim = None if pd.isna(dim) else int(dim)
                same = lambda d: dim is not None and d == dim
                out += [(q_id, i, 0.0, 1) for i, d, f in heads if same(d) and (flat or f)][:k] + [(q_id, i, 0.0, 2) for i, d, _ in heads if not same(d)][:k]
            yield pd.DataFrame(out, columns=["q_id", "id", "distance", "far"])

    return found.unionByName(short.mapInPandas(fill, "q_id long, id long, distance double, far int"))


def _pack_search(group, k: int):
    """The k best rows of a part for each query of a pack."""
    import numpy as np
    import pandas as pd

    asked = group[group["q_id"].notna()]
    pack = list(zip(asked["q_id"].astype("int64"), asked["v"]))
    batch = group[group["q_id"].isna()]
    sizes = {}  # queries of one dimension are handled together; those without a vector are at no distance to anything
    for q_id, q in pack:
        sizes.setdefault(-1 if q is None else len(q), []).append((q_id, q))
    best: dict = {}

    def offer(q_ids, ids, distances):
        """Keep the k best; distances: a row for each id, a column for each query; None: at no distance."""
        for j, q_id in enumerate(q_ids):
            d = np.full(len(ids), np.nan) if distances is None else distances[:, j]
            none = np.full(len(ids), distances is None)
            have = best.get(q_id)
            i, d, none = (np.concatenate(x) for x in zip(have, (ids, d, none))) if have else (ids, d, none)
            if len(i) > 8 * k and not none.any() and not np.isnan(d).any():
                some = np.flatnonzero(d <= np.partition(d, k)[k])
                i, d, none = i[some], d[some], none[some]
            by = np.lexsort((i, np.nan_to_num(d, nan=np.inf), np.isnan(d), none))[:k]
            best[q_id] = (i[by], d[by], none[by])

    lengths = batch["v"].map(lambda v: -1 if v is None else len(v)).to_numpy()
    ids = batch["id"].to_numpy()
    for size in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == size)
        for q_size, some in sizes.items():
            q_ids = [q_id for q_id, _ in some]
            if size != q_size or size < 0:
                offer(q_ids, ids[mine], None)
                continue
            x, step = np.stack(batch["v"].to_numpy()[mine]), max(1, DISTANCES // len(mine))
            away = np.sqrt((x * x).sum(1))[:, None]
            for part in (some[i : i + step] for i in range(0, len(some), step)):
                q = np.array([v for _, v in part])
                length = away * np.sqrt((q * q).sum(1))[None, :]
                with np.errstate(invalid="ignore", divide="ignore"):
                    offer([q_id for q_id, _ in part], ids[mine], np.round(1.0 - np.where(length == 0, np.nan, (x @ q.T) / length), 12) + 0.0)
    out = [pd.DataFrame({"q_id": q_id, "id": i, "distance": np.nan_to_num(d), "far": np.where(none, 2, np.isnan(d).astype(int))}) for q_id, (i, d, none) in best.items()]
    return pd.concat(out) if out else pd.DataFrame({"q_id": [], "id": [], "distance": [], "far": []})
