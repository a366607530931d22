"""Vectors by content: what was embedded once isn't embedded again.

The store has a vector for each digest of a text, in a folder for each model, so that models don't mix. An ingestion joins its distinct texts' digests to the store, embeds the texts that are missing, appends these, and
takes all its vectors from the store: texts that repeat, in one load or over many, cost one embedding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import Embedder, document_vectors
from ..session import scratch

SCHEMA = "digest binary, embedding array<float>"


def _stored(rows: DataFrame, path: str) -> DataFrame:
    """The store's vectors, one for each digest: two loads at a time may both have added one."""
    spark = rows.sparkSession
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)  # makes a new store; adds no row to one that is there
    return spark.read.schema(SCHEMA).parquet(path).groupBy("digest").agg(F.min("embedding").alias("embedding"))


def embedded(rows: DataFrame, embedder: Embedder, root: str, model: str, text: str = "content", vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows with their texts' vectors, and how many texts were embedded for that; null texts have null vectors and are never embedded.

    model: a name for the embedder and its version. Rows that repeat stay as they are; an empty table embeds nothing. The result reads the store, which only grows.
    """
    if not model or "/" in model or "=" in model:
        raise ValueError(f"not a plain name: {model!r}")
    spark, path = rows.sparkSession, f"{root.rstrip('/')}/model={model}"
    digest = F.unhex(F.sha2(F.col(text), 256))
    wanted = rows.where(F.col(text).isNotNull()).select(digest.alias("digest"), F.col(text).alias("text"))
    missing = wanted.join(_stored(rows, path).select("digest"), "digest", "left_anti").groupBy("digest").agg(F.min("text").alias("text"))
    kept = scratch(spark, "missing")
    missing.write.parquet(kept)
    missing = spark.read.parquet(kept)
    if n := missing.count():
        missing.select("digest", document_vectors(embedder)(F.col("text")).alias("embedding")).write.mode("append").parquet(path)
    vectors = _stored(rows, path).select(F.col("digest").alias("of"), F.col("embedding").alias(vector))
    keyed = rows.withColumn("of_text", digest)
    return keyed.join(vectors, keyed["of_text"] == F.col("of"), "left").drop("of", "of_text"), n
