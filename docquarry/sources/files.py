"""Files as tables: listings, page texts, archives and delimited catalogues."""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..schemas import PAGES, PAGES_OR_ERRORS

#: Names that a file audit reports.
SUSPICIOUS = r"^(\.env|.*\.pem|id_rsa.*|.*\.key)$"
#: A line of a delimited catalogue in which no quotation stays open.
PLAIN_LINE = r'^(?:(?:"[^"]*+(?:""[^"]*+)*+"|(?!\s*+")[^|]*+)(?:\||\z))+\z'


def listing(spark: SparkSession, folder: str, pattern: str = "*", deep: bool = False) -> DataFrame:
    """(path, file_name, length) of the files of a folder; no content is read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(deep).lower())
    return reader.load(folder).select("path", base_name(F.col("path")).alias("file_name"), "length")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_name, content) of the PDF files directly in a folder, whatever the case of their suffix."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).select("path", base_name(F.col("path")).alias("file_name"), "content")


def audit(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of files below a folder whose names look like secrets, empty ones too; names only, never contents. The file system is asked on the driver, which keeps the findings only."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found, walk = [], at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    while walk.hasNext():
        path = walk.next().getPath()
        if re.match(SUSPICIOUS, path.getName()):
            found.append((path.toString(),))
    return spark.createDataFrame(found, "path string")


def read_pages(files: DataFrame, parse: Callable[[bytes], list[str]], source: str = "file_name") -> DataFrame:
    """(source, page_no, page_text, error): the pages of each file by a parser that gives a file's page texts; a file that the parser rejects is one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["source"], batch["content"]):
                try:
                    rows += [(name, i, text, None) for i, text in enumerate(parse(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*PAGES.names, "error"]).astype({"page_no": "Int32"})

    return files.select(F.col(source).alias("source"), "content").mapInPandas(run, PAGES_OR_ERRORS)


def page_texts(files: DataFrame, parse: Callable[[bytes], list[str]], source: str = "file_name") -> DataFrame:
    """(source, page_no, page_text): the pages of the files that the parser accepts; page_rejects() names the others."""
    return read_pages(files, parse, source).where(F.col("error").isNull()).drop("error")


def page_rejects(files: DataFrame, parse: Callable[[bytes], list[str]], source: str = "file_name") -> DataFrame:
    """(source, error) of the files that the parser rejects."""
    return read_pages(files, parse, source).where(F.col("error").isNotNull()).select("source", "error")


def blob(spark: SparkSession, folder: str, name: str) -> bytes:
    """The content of one file of a folder; raises FileNotFoundError if it isn't there."""
    return bytes(spark.read.format("binaryFile").load(resolve(spark, name, folder)).first()["content"])


def fetched(spark: SparkSession, path: str, fetch: Callable[[], bytes]) -> bool:
    """Put what fetch() gives into a file, unless the file is there; returns whether it was fetched. A part of a file is never left under its name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    system = target.getFileSystem(conf)
    if system.exists(target):
        return False
    out = system.create(part, True)
    try:
        out.write(bytearray(fetch()))
    finally:
        out.close()
    return system.rename(part, target)


def unzipped(archives: DataFrame, suffix: str = "") -> DataFrame:
    """(archive, name, size_bytes, content): the members of zip archives, a row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zipfile

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for info in z.infolist():
                        if not info.is_dir() and info.filename.endswith(suffix):
                            yield pd.DataFrame([(name, info.filename, info.file_size, z.read(info))], columns=["archive", "name", "size_bytes", "content"])

    return archives.select("path", "content").mapInPandas(run, "archive string, name string, size_bytes long, content binary")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(folder)


def _shapes(spark: SparkSession, path: str) -> dict[str, tuple[bool, str]]:
    """For each file of a delimited catalogue: whether its lines are its records, so that it can be split between tasks, and its first line.

    A line counts as a record if its fields are closed quotations or don't begin with a quote, and it has no other line end than the file's."""
    value = F.regexp_replace("value", r"\r\z", "")
    plain = value.rlike(PLAIN_LINE) & ~value.contains("\r") & ((value == "") | (F.trim(value) != ""))
    lines = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("id", F.monotonically_increasing_id())
    ends, n = F.count_if(F.col("value").endswith("\r")), F.count(F.lit(1))
    made = lines.groupBy("file_path").agg((F.min(plain) & ((ends == 0) | (ends == n))).alias("plain"), F.min_by(value, F.struct("file_block_start", "id")).alias("head"))
    return {r["file_path"]: (r["plain"], r["head"]) for r in made.collect()}  # a row for each file


def delimited(spark: SparkSession, path: str, exact: bool = False, place: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of a pipe-delimited catalogue with a header, all columns text, and the rows that are too short or otherwise odd.

    The built-in reader gives empty fields as empty texts and can't tell them from missing ones; exact=True reads with Python's csv module, whose
    missing trailing fields are null, from any file system that Spark reads.

    place: a further column of that name says where a row stands, as a struct (file, block, n) that grows from row to row of a file. A quoted field may hold line
    ends; a file with such a field, or one that may have it, is one task's, and with exact=True its bytes are held there. Other files are split between tasks and read line by line.
    """
    with_header = spark.read.option("sep", "|").option("quote", '"').option("escape", '"').option("multiLine", True).option("header", True)
    names = with_header.csv(path).columns
    shapes = _shapes(spark, path)
    whole = sorted(f for f, (plain, _) in shapes.items() if not plain)
    if exact:
        heads = {f: next(csv.reader([head], delimiter="|"), []) for f, (plain, head) in shapes.items() if plain}
        schema = ", ".join(f"`{c}` string" for c in [*names, "_odd"]) + ", _n long, _file string, _block long"
        types = pa.schema([*((c, pa.string()) for c in [*names, "_odd"]), ("_n", pa.int64()), ("_file", pa.string()), ("_block", pa.int64())])

        def record(head: list[str], fields: list[str]) -> tuple:
            r, more = dict(zip(head, fields)), fields[len(head) :]
            short = len(fields) < len(head)
            return *(r.get(c) for c in names), "|".join([*(r[c] for c in names if r.get(c) is not None), *more]) if short or more else None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)

        def by_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, n = None, 0
            for batch in batches:
                found = []
                files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
                for file, block, fields in zip(files, blocks, csv.reader(batch.column("value").to_pylist(), delimiter="|")):
                    if at != (file, block):
                        at, n = (file, block), 0
                        if block == 0:  # the header
                            continue
                    if fields:
                        found.append((*record(heads[file], fields), n, file, block))
                        n += 1
                if found:
                    yield table(found)

        def by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                    read = csv.reader(io.TextIOWrapper(io.BytesIO(content.as_py()), "utf-8", newline=""), delimiter="|")
                    head = next(read, [])
                    rows = (record(head, fields) for fields in read if fields)
                    for begin in itertools.count(0, 10_000):
                        found = [(*r, begin + i, file, 0) for i, r in enumerate(itertools.islice(rows, 10_000))]
                        if not found:
                            break
                        yield table(found)

        file = F.col("_metadata.file_path").alias("file")
        lines = spark.read.option("lineSep", "\n").text(path).select(file, F.col("_metadata.file_block_start").alias("block"), "value")
        rows = lines.where(~F.col("file").isin(whole)).mapInArrow(by_line, schema)
        if whole:
            rows = rows.unionByName(spark.read.format("binaryFile").load(path).select(file, "content").where(F.col("file").isin(whole)).mapInArrow(by_file, schema))
        placed = [F.struct(F.col("_file").alias("file"), F.col("_block").alias("block"), F.col("_n").alias("n")).alias(place)] if place else []
        return rows.select(*[F.col(f"`{c}`") for c in names], *placed), rows.drop("_n", "_file", "_block").where(F.col("_odd").isNotNull())
    schema = ", ".join(f"`{c}` string" for c in [*names, "_odd"])
    # the reader gives an odd row's text only while columns are read, too, so it is kept beside them
    # without pruning it sees all of a row, as it does by itself where rows may hold line ends
    rows = with_header.option("multiLine", bool(whole)).option("columnPruning", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_odd").schema(schema).csv(path)
    placed = [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias(place)] if place else []
    good = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names], *placed)
    return good, rows.where(F.col("_odd").isNotNull()).select(*[F.col(f"`{c}`") for c in names], "_odd")


def resolve(spark: SparkSession, name: str, *folders: str) -> str:
    """The path of a named file in the first of the folders that exists. Names with path separators are refused."""
    if not name or "/" in name or "\\" in name or name in (".", ".."):
        raise ValueError(f"not a plain file name: {name!r}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(conf).exists(path):
            file = jvm.org.apache.hadoop.fs.Path(folder, name)
            if file.getFileSystem(conf).exists(file):
                return file.toString()
            break
    raise FileNotFoundError(name)
