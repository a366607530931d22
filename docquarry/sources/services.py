"""Search services as data sources: a partition for each request, retries in the task, filters on the request's key before anything is asked.

The engine opens no connections itself: a service is a function that is given to the source and runs in the tasks.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..session import scratch

log = logging.getLogger(__name__)
#: Filters of Python sources are pushed only where this is set.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _work_list(path: str) -> list[dict]:
    """The requests of a JSON-lines table, by the file system of its address."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))
    found = []
    for f in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda f: f.path):
        if f.base_name.startswith("part-"):
            found += [json.loads(line) for line in system.open_input_file(f.path).read().decode().splitlines()]
    return found


def source(name: str, ask: Callable[[dict], Iterable[tuple]], schema: str, key: str, retries: int = 2, pause: float = 0.0) -> type[DataSource]:
    """A data source over a table of requests (option `requests`): ask(request) gives the rows of one request, of this schema.

    A request that fails is asked again `retries` times, after a pause that doubles; if it fails to the end it has no rows, which is logged, and the others go on. A filter `key = value` or `key in (values)` leaves
    the other requests out. Requests without a value for the key are asked unless there is such a filter.
    """

    class Request(InputPartition):
        def __init__(self, request: dict):
            super().__init__(request)

    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.path, self.wanted = path, None

        def pushFilters(self, filters):  # noqa: N802  named by Spark
            for f in filters:
                if isinstance(f, (EqualTo, In)) and f.attribute == (key,):
                    values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.wanted = values if self.wanted is None else self.wanted & values
                else:
                    yield f

        def partitions(self):
            return [Request(r) for r in _work_list(self.path) if self.wanted is None or r.get(key) in self.wanted] or [Request({})]

        def read(self, partition):
            request = partition.value
            if not request:
                return
            for attempt in range(retries + 1):
                try:
                    rows = list(ask(request))
                except Exception as e:  # noqa: BLE001  one failing request doesn't stop the others
                    log.warning("attempt %s failed for %r: %s", attempt + 1, request, e)
                    time.sleep(pause * 2**attempt)
                    continue
                yield from rows
                return

    class Service(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options["requests"])

    return Service


def asked(requests: DataFrame, name: str, ask: Callable[[dict], Iterable[tuple]], schema: str, key: str, retries: int = 2, pause: float = 0.0) -> DataFrame:
    """The answers to a table of requests, each asked in a task of its own: the requests are written as JSON lines in the shared folder, which the source's planner reads. The table's columns are
    what ask() gets; null ones are missing."""
    spark = requests.sparkSession
    path = scratch(spark, "requests")
    requests.write.json(path)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(source(name, ask, schema, key, retries, pause))
    return spark.read.format(name).option("requests", path).load()
