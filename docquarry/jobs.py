"""Batch jobs, composed of the operators: load a catalogue file, draw up the work list of documents, take documents in, list a company's products."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import text as t
from .models import plain_pages
from .operators import catalog, feeds
from .schemas import DEVICE_COLUMNS, DEVICES
from .sources import answers, files, sinks

log = logging.getLogger(__name__)


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Rows that count themselves while they are written: the observation's `rows` is known once an action has run."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def load_catalog(spark: SparkSession, path: str, root: str, version: int, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Merge a delimited catalogue file into the device table and write the result as its next version; returns the table, the rejected rows, and the number of rows written.

    Of rows that repeat a key, the last one of the file wins; of several files, that of the last one by name."""
    rows, odd = files.delimited(spark, path, place="_place")
    load = catalog.project(rows, DEVICE_COLUMNS | {"_place": "seq"})
    table, seen = observed(catalog.upsert(spark.createDataFrame([], DEVICES) if existing is None else existing, load), "devices")
    written = sinks.replace_version(table, root, version)
    log.info("%s rows of devices", seen.get["rows"])
    return spark.read.schema(DEVICES).parquet(written), odd, seen.get["rows"]


def work_list(devices: DataFrame, company: str, stored: DataFrame) -> DataFrame:
    """(primary_di, file_name, template_no, q): the queries for a company's devices whose document isn't stored yet."""
    found = catalog.search(devices, company, limit=None)
    name = t.file_name(F.col("primary_di"), F.col("catalog_number"))
    missing = catalog.skip_existing(found, stored, name).withColumn("file_name", name)
    return feeds.templates(missing, "company_name", "brand_name", "catalog_number", "primary_di", "file_name")


def ingest_folder(engine: Engine, folder: str, path: str, parse: Callable[[bytes], list[str]] = plain_pages) -> tuple[DataFrame, DataFrame]:
    """Take the documents of a folder into an engine's chunk table; returns the table and the files that the parser rejects."""
    docs = files.documents(engine.spark, folder)
    return engine.ingest(files.page_texts(docs, parse), path), files.page_rejects(docs, parse)


def product_search(queries: DataFrame, ask: Callable[[dict], str], base_url: str = "") -> DataFrame:
    """(query, product_id, name, gtin, title, link): the wanted documents of the products that a service finds for queries (a column `query`), asked in tasks; a query that fails has none and doesn't stop the others."""
    return feeds.product_documents_json(answers.product_answers(queries, ask), base_url, "json", "query")
