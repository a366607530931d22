"""A session with the settings that the engine relies on."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Where it is unset, a folder of this machine on a local master, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="docquarry-")
    return f"{root.rstrip('/')}/docquarry/{name}-{uuid.uuid4().hex}"


def session(name: str = "docquarry", **conf: str) -> SparkSession:
    """The running session or a new one: UTC, ANSI arithmetic, adaptive execution."""
    builder = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}.items():
        builder = builder.config(k, v)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
