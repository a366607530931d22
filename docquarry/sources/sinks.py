"""Writing tables and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a Parquet table, as one job."""
    rows.write.mode("append").parquet(path)


def lookup_table(rows: DataFrame, path: str, *keys: str, partitions: int | None = None) -> DataFrame:
    """Write rows in the order of keys, so that a filter on the first key reads a few row groups only, with Bloom filters for the others; returns the table."""
    placed = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    writer = placed.sortWithinPartitions(*keys).write
    for key in keys[1:]:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def replace_version(rows: DataFrame, root: str, version: int) -> str:
    """Write a table's new version into its own folder, which must not exist yet; readers change over when they are told the path."""
    path = f"{root.rstrip('/')}/version={version}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def json_array(rows: DataFrame, order: Column | str) -> DataFrame:
    """One row with all rows as a JSON array in an order: for small target lists, as it is one value."""
    fields = F.struct(*rows.columns)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(order).alias("o"), fields.alias("f")))), lambda x: x["f"])
    return rows.agg(F.to_json(listed).alias("json"))


def files(rows: DataFrame, folder: str, name: str = "file_name", content: str = "content") -> DataFrame:
    """(file_name, length): write each row's bytes as a file of the folder, by the file system of the folder's address. A retried task overwrites its own files."""

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            out = []
            for n, c in zip(batch["n"], batch["c"]):
                if not n or "/" in n or n in (".", ".."):
                    raise ValueError(f"not a plain file name: {n!r}")
                with system.open_output_stream(f"{inner}/{n}") as f:
                    f.write(bytes(c))
                out.append((n, len(c)))
            yield pd.DataFrame(out, columns=["file_name", "length"])

    return rows.select(F.col(name).alias("n"), F.col(content).alias("c")).mapInPandas(run, "file_name string, length long")
