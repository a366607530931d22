"""Case-insensitive substring search over files that trigrams choose.

Rows are written in the order of the searched column, some to a file. A posting table has each three characters that stand somewhere in a file's lower-cased column, with the file's name, in the order of the
characters. A search reads the postings of its term's trigrams (pushed to the scan), takes the files that have all of them, and tests the rows of these alone. Wildcards in the term part it into pieces, and pieces of
fewer than three characters choose nothing: a term of such pieces reads every file.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of a gram.
GRAM = 3


def grams_of(term: str) -> list[str]:
    """The trigrams that every match of an ILIKE term has. Those with characters beyond ASCII choose nothing, as languages differ in how they lower them."""
    pieces = [p.lower() for p in re.split(r"[%_\\]", term)]
    return sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1) if p[i : i + GRAM].isascii()})


def build(rows: DataFrame, path: str, column: str, rows_per_file: int = 1_000_000) -> "SubstringIndex":
    """Write rows and the postings of a column at a new path. Null values are in no posting and never found, but stay in the table."""
    spark = rows.sparkSession
    files = max(1, -(-rows.count() // rows_per_file))
    rows.repartitionByRange(files, F.lower(column)).sortWithinPartitions(F.lower(column)).write.parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    text = F.lower(F.col(column))
    grams = F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substring(text, i, F.lit(GRAM)))))
    postings = stored.select(F.explode(grams).alias("gram"), F.col("_metadata.file_name").alias("file")).distinct()
    postings.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file").write.parquet(f"{path}/postings")
    return SubstringIndex(spark, path, column, rows.schema)


class SubstringIndex:
    """An index at a path, over rows of a schema."""

    def __init__(self, spark: SparkSession, path: str, column: str, schema: StructType):
        self.spark, self.path, self.column, self.schema = spark, path, column, schema

    def files(self, term: str) -> list[str] | None:
        """The files that can hold a match; None for all of them. They are named on the driver, as those of any scan."""
        grams = grams_of(term)
        if not grams:
            return None
        postings = self.spark.read.schema("gram string, file string").parquet(f"{self.path}/postings").where(F.col("gram").isin(grams))
        found = postings.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
        return sorted(r["file"] for r in found.select("file").collect())

    def search(self, term: str) -> DataFrame:
        """The rows whose column holds a term, whatever the case; % and _ in it are wildcards."""
        files = self.files(term)
        if files == []:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).parquet(*([f"{self.path}/rows"] if files is None else [f"{self.path}/rows/{f}" for f in files]))
        return found.where(F.col(self.column).ilike(f"%{term}%"))
