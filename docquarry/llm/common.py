"""What the operators of this subpackage share: the shared folder, materialised tables, block files, Arrow batches, what a worker holds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing ASCII letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch that Spark sends to a Python worker, at most: long texts make larger batches too large for small workers.
ROWS_AT_ONCE = 1000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own on a local master (tests), else an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="docquarry-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/docquarry/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, by the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path, by the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_tables(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            remove(t.sparkSession, folder)


def ascii_lower(col):
    """A-Z to a-z; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def doc_crc(col):
    """crc32 of an id written as decimal text; null: of the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on, Spark sends Python workers ROWS_AT_ONCE rows at a time at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_ONCE:
        spark.conf.set(key, str(ROWS_AT_ONCE))


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about most_bytes of the named text column at most, or a single row."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        begin = size = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        yield batch.slice(begin)


def blocks(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """The rows of the batches packed into tables of about most_bytes of the named text column, or a single row."""
    rows: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches, column, most_bytes):
        n = part.column(part.schema.get_field_index(column)).nbytes
        if rows and size + n > most_bytes:
            yield pa.Table.from_batches(rows)
            rows, size = [], 0
        rows.append(part)
        size += n
    if rows:
        yield pa.Table.from_batches(rows)


def shared_files(path: str):
    """The file system and the path in it of a folder below the shared one, for Python on driver and executors; the folder is made."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))
    system.create_dir(inner, recursive=True)
    return system, inner


class Store:
    """Block files in a folder below the shared one. A file appears whole, under the name that its task gives it; where a task is run again, its first file stays."""

    def __init__(self, root: str):
        self.root = root

    def write(self, table: pa.Table, name: str) -> pa.Table:
        """Write a table, unless a file of that name is there; returns what the file holds."""
        from pyarrow import fs

        system, inner = shared_files(self.root)
        if system.get_file_info(f"{inner}/{name}").type == fs.FileType.File:
            return self.read(name)
        part = f"{inner}/{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        system.move(part, f"{inner}/{name}")
        return table

    def write_new(self, table: pa.Table, name: str) -> str:
        """Write a table under a name of this attempt's own, and return that. Where the rows that a task returns carry the name, those of the attempt that counts lead to
        its own file, even if another attempt of the task had its rows in another order."""
        name = f"{name}-{uuid.uuid4().hex}"
        self.write(table, name)
        return name

    def read(self, name: str) -> pa.Table:
        system, inner = shared_files(self.root)
        with system.open_input_file(f"{inner}/{name}") as f:
            return pa.ipc.open_file(f).read_all()


def packed(body: bytes) -> bytes:
    """Bytes, compressed, with their length before them."""
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(body, asbytes=True)


def unpacked(body) -> pa.Buffer:
    """What packed() was given."""
    raw = memoryview(body)
    return pa.Codec("zstd").decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little")) if int.from_bytes(raw[:8], "little") else pa.py_buffer(b"")


_HELD: dict[tuple, object] = {}


def resident(kind: str, key, build: Callable):
    """What a worker keeps from task to task, such as a tokenizer with the words that it remembers: one such thing at a time, the last asked for."""
    if (kind, key) not in _HELD:
        _HELD.clear()
        tidy()
        _HELD[kind, key] = build()
    return _HELD[kind, key]


def tidy() -> None:
    """Give memory that a worker no longer uses back to the system; without a C library that can, nothing happens."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
