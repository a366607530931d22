"""Answers of search services as tables, captured or asked in tasks; the engine itself opens no connections."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import HITS, PRODUCT_FEED
from . import services

log = logging.getLogger(__name__)


def raw_answers(spark: SparkSession, path: str) -> DataFrame:
    """(json): captured JSON answers, a file each."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def products(spark: SparkSession, path: str) -> DataFrame:
    """Rows (totalElements, content) of captured product answers."""
    return spark.read.schema(PRODUCT_FEED).json(path, multiLine=True)


def product_request(query: str, country: str = "US", page: int = 0, size: int = 5, audience: str = "HCP", current_date: str = "") -> dict:
    """Parameters and body of a product search."""
    return {"params": {"audience": audience, "page": page, "size": size}, "body": {"currentDate": current_date, "attributes": [{"name": "cross-field-search", "value": query}], "country": country}}


def product_requests(queries: DataFrame, query: str = "query", **settings) -> DataFrame:
    """(query, params, body) of a product search for each row: product_request() as an expression, for work lists of any length."""
    made = product_request("", **settings)
    value = F.struct(F.lit(made["body"]["attributes"][0]["name"]).alias("name"), F.col(query).alias("value"))
    body = F.struct(F.lit(made["body"]["currentDate"]).alias("currentDate"), F.array(value).alias("attributes"), F.lit(made["body"]["country"]).alias("country"))
    return queries.select(F.col(query).alias("query"), F.struct(*[F.lit(v).alias(k) for k, v in made["params"].items()]).alias("params"), body.alias("body"))


def hits(requests: DataFrame, provider: Callable[[str], Iterable[str]], most: int = 3, retries: int = 2) -> DataFrame:
    """(query_id, template_no, rank, href) of a search provider's first hits for requests (query_id, template_no, q), each asked in a task; a query that fails has none and doesn't stop the others."""

    def ask(request: dict):
        return [(request["query_id"], request["template_no"], rank, href) for rank, href in zip(range(1, most + 1), provider(request["q"]))]

    return services.asked(requests.select("query_id", "template_no", "q"), "docquarry_web_hits", ask, HITS.simpleString()[7:-1].replace(":", " "), "query_id", retries)


def product_answers(queries: DataFrame, search: Callable[[dict], str], retries: int = 2, **settings) -> DataFrame:
    """(query, json): a product service's answer to each query (a column `query`), asked in tasks; search gets {"params", "body"} and returns JSON. A query that fails has no answer."""

    def ask(request: dict):
        return [(request["query"], search({k: request[k] for k in ("params", "body")}))]

    return services.asked(product_requests(queries, **settings), "docquarry_products", ask, "query string, json string", "query", retries)


def device_answers(companies: DataFrame, search: Callable[[str], str], retries: int = 2) -> DataFrame:
    """(company, json): a device service's answer for each company (a column `company`), asked in tasks. A company for which it fails has none."""
    return services.asked(companies.select("company"), "docquarry_devices", lambda r: [(r["company"], search(r["company"]))], "company string, json string", "company", retries)


def or_empty(spark: SparkSession, load: Callable[[], DataFrame], schema) -> DataFrame:
    """A loaded table, or an empty one of the same schema if loading fails; the failure is logged."""
    try:
        found = load()
        found.limit(1).count()
        return found
    except Exception as e:  # noqa: BLE001
        log.warning("loading failed: %s", e)
        return spark.createDataFrame([], schema)
