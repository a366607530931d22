"""A keyed table in buckets with a manifest for each version: an upsert rewrites the buckets that it touches, and is committed by one file that appears whole.

Rows are in the bucket of their key's hash, those without a key in the bucket of all their values. A manifest names the folder of every bucket; folders are never written again. A load that fails before its
manifest appears leaves the last version as it was, and of two loads at a time onto one version, the second one to commit fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import catalog
from ..schemas import DEVICES

#: Buckets of a new table.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another load has committed the version that this one was to make."""


class VersionedTable:
    """The device table at a root. buckets: for a new table; one that is there keeps its number."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, key: str = "primary_di", schema: StructType = DEVICES):
        self.spark, self.root, self.key, self.schema = spark, root.rstrip("/"), key, schema
        self.buckets = self.manifest()["buckets"] if self.version() else buckets

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The committed versions, in order."""
        path, system = self._files()
        folder = path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The last committed version; 0 for none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{buckets, folders} of a version (None: the last): the folder of each bucket that holds rows."""
        version = self.version() if version is None else version
        if not version:
            return {"buckets": self.buckets, "folders": {}}
        path, system = self._files()
        stream = system.open(path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        path, system = self._files()
        part, whole = path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), path(f"{self.root}/manifests/v{version:010d}.json")
        stream = system.create(part)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if system.exists(whole) or not system.rename(part, whole):  # a rename onto a file that is there fails
            system.delete(part, False)
            raise Conflict(f"version {version} is there")

    def bucket(self, rows: DataFrame) -> Column:
        """The bucket of a row, by its key; of one without, by its values."""
        values = [F.col(c).cast("string") for c in sorted(rows.columns) if c != self.key]
        return F.pmod(F.when(F.col(self.key).isNotNull(), F.xxhash64(F.col(self.key))).otherwise(F.xxhash64(*values)), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; None: the last."""
        return self._read(sorted(self.manifest(version)["folders"].values()))

    def upsert(self, load: DataFrame, order: str = "seq") -> int:
        """Merge a load, as catalog.upsert() does, into the buckets of its keys; returns the new version. An empty load makes none."""
        version = self.version()
        manifest = self.manifest(version)
        touched = sorted(r[0] for r in load.select(self.bucket(load)).distinct().collect())  # self.buckets at most
        if not touched:
            return version
        existing = self._read([manifest["folders"][str(b)] for b in touched if str(b) in manifest["folders"]])
        merged = catalog.upsert(existing, load, self.key, order)
        # rows without a key stay in the bucket that the load gave them, as no other row is merged with them
        place = f"data/{uuid.uuid4().hex}"
        merged.withColumn("bucket", self._stays(merged, touched)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{place}")
        path, system = self._files()
        made = {int(s.getPath().getName().split("=")[1]) for s in system.listStatus(path(f"{self.root}/{place}")) if "=" in s.getPath().getName()}
        folders = {b: f for b, f in manifest["folders"].items() if int(b) not in touched} | {str(b): f"{place}/bucket={b}" for b in made}
        self._commit(version + 1, {"buckets": self.buckets, "folders": folders})
        return version + 1

    def _stays(self, rows: DataFrame, touched: list[int]) -> Column:
        """The bucket of a merged row: its key's; without a key, one of the touched ones by its id."""
        some = F.array(*[F.lit(b) for b in touched])
        return F.when(F.col(self.key).isNotNull(), self.bucket(rows)).otherwise(F.element_at(some, (F.pmod(F.xxhash64("id"), F.lit(len(touched))) + 1).cast("int")))

    def remove_old(self, keep: int = 2) -> list[str]:
        """Delete the manifests of all but the last `keep` versions, and the folders that no version names any more; returns those. Loads that run meanwhile must be waited for."""
        versions, (path, system) = self.versions(), self._files()
        for v in versions[:-keep] if keep else versions:
            system.delete(path(f"{self.root}/manifests/v{v:010d}.json"), False)
        named = {f for v in self.versions() for f in self.manifest(v)["folders"].values()}
        gone = []
        for load in system.listStatus(path(f"{self.root}/data")) if system.exists(path(f"{self.root}/data")) else []:
            for b in system.listStatus(load.getPath()):
                name = f"data/{load.getPath().getName()}/{b.getPath().getName()}"
                if "=" in name and name not in named:
                    system.delete(b.getPath(), True)
                    gone.append(name)
        return sorted(gone)
