"""Incremental ingestion: files that have arrived since the last run are chunked, embedded and added once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import base_name
from ..operators.chunking import chunk_rows

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_files(spark: SparkSession, folder: str, table: str, checkpoint: str, parse: Callable[[bytes], list[str]], pattern: str = "*.[pP][dD][fF]", embed=None) -> StreamingQuery:
    """Process what is new in a folder and stop; a second run over the same files adds nothing.

    Each file is a row, so that a file's pages are joined in its own task, without a shuffle. The checkpoint holds the names of files that are done.
    """
    arrived = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)

    @F.pandas_udf("string")
    def whole(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: "".join(f"{p}\n" for p in parse(bytes(c))))

    texts = arrived.select(base_name(F.col("path")).alias("source"), whole("content").alias("text"))
    rows = chunk_rows(texts, embed=embed)
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def ingest_table(spark: SparkSession, folder: str, schema, table: str, checkpoint: str, source: str = "source", text: str = "text") -> StreamingQuery:
    """The same for texts that arrive as Parquet files."""
    arrived = spark.readStream.schema(schema).parquet(folder)
    return chunk_rows(arrived, source, text).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
