"""Answers of search services: device lists, products with their documents, and web hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

#: Wanted documents.
LANGUAGE, KIND = "en", "instructions for use"
TEMPLATES = 3
HITS = 3


def devices(answers: DataFrame, raw: str = "json", limit: int = 20) -> DataFrame:
    """(catalog_number, brand, description) of the first `limit` devices of each JSON answer; of those, devices without catalogue number are dropped after that.

    A missing member gets its default, a null one stays null.
    """
    listed = F.slice(F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$['search-result'].device", "array<variant>"), F.array().cast("array<variant>")), 1, limit)
    rows = answers.select(F.posexplode(listed).alias("pos", "d"))

    def member(name: str, default: str) -> Column:
        found = F.try_variant_get("d", f"$.{name}", "variant")
        return F.when(found.isNull(), F.lit(default)).otherwise(F.try_variant_get("d", f"$.{name}", "string"))

    number = F.try_variant_get("d", "$.catalogNumber", "string")
    return rows.select("pos", number.alias("catalog_number"), member("brandName", "Unknown").alias("brand"), member("deviceDescription", "No description").alias("description")).where(t.filled(F.col("catalog_number"))).drop("pos")


def first_then(rows: DataFrame, order: str, limit: int, predicate: Column) -> DataFrame:
    """The first `limit` rows in an order, and of those the ones for which a predicate holds."""
    return rows.orderBy(order).limit(limit).where(predicate)


def wanted(language: Column, kind: Column, words: str = KIND) -> Column:
    """English by its code, which counts as given where it is missing, and of a kind whose name contains the words."""
    return (F.lower(F.coalesce(language, F.lit(LANGUAGE))) == LANGUAGE) & t.has(F.coalesce(kind, F.lit("Unknown")), words)


def product_documents(products: DataFrame, base_url: str = "", *columns: str) -> DataFrame:
    """(columns, product_id, name, gtin, title, link): each product with its wanted documents, or with null title if it has none.

    products: rows of the product answer's content. Links are made for documents with a file id only.
    """
    rows = products.select(
        *columns, F.col("id").alias("product_id"), F.coalesce("name", F.lit("Unknown Product")).alias("name"), F.coalesce("gtin", F.lit("N/A")).alias("gtin"),
        F.explode_outer(F.filter("documents", lambda d: wanted(d["language"]["isoCode"], d["documentType"]["name"]))).alias("d"),
    )
    # fixed values: the parts of a document's address
    link = F.concat(F.lit(base_url), F.lit("/products/"), t.shown(F.col("product_id")), F.lit("/documents/"), t.shown(F.col("d.id")), F.lit("/file?language=en&country=US&audience=HCP"))
    return rows.select(*columns, "product_id", "name", "gtin", F.col("d.title").alias("title"), F.when(t.filled(F.col("d.fileUuid")), link).alias("link"))


def product_documents_json(answers: DataFrame, base_url: str = "", raw: str = "json", *columns: str) -> DataFrame:
    """product_documents() of raw JSON answers, in which a null name or gtin can be told from a missing one: the missing one gets its default, a null one stays null."""
    content = F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$.content", "array<variant>"), F.array().cast("array<variant>"))
    rows = answers.select(*columns, F.explode(content).alias("p"))

    def member(v: Column, path: str, default: str | None = None) -> Column:
        found = F.try_variant_get(v, path, "string")
        return found if default is None else F.when(F.try_variant_get(v, path, "variant").isNull(), F.lit(default)).otherwise(found)

    listed = F.coalesce(F.try_variant_get("p", "$.documents", "array<variant>"), F.array().cast("array<variant>"))
    rows = rows.select(
        *columns, member(F.col("p"), "$.id").alias("product_id"), member(F.col("p"), "$.name", "Unknown Product").alias("name"), member(F.col("p"), "$.gtin", "N/A").alias("gtin"),
        F.explode_outer(F.filter(listed, lambda d: wanted(member(d, "$.language.isoCode"), member(d, "$.documentType.name")))).alias("d"),
    )
    # fixed values: the parts of a document's address
    link = F.concat(F.lit(base_url), F.lit("/products/"), t.shown(F.col("product_id")), F.lit("/documents/"), t.shown(member(F.col("d"), "$.id")), F.lit("/file?language=en&country=US&audience=HCP"))
    return rows.select(*columns, "product_id", "name", "gtin", member(F.col("d"), "$.title").alias("title"), F.when(t.filled(member(F.col("d"), "$.fileUuid")), link).alias("link"))


def nested(rows: DataFrame, keep: Column, items: str = "items", *columns: str) -> DataFrame:
    """The elements of an array of structs for which an expression over `item` holds, a row each, their fields as columns."""
    exploded = rows.select(*columns, F.explode_outer(items).alias("item")).where(keep)
    return exploded.select(*columns, "item.*")


def total(answers: DataFrame) -> DataFrame:
    """(total): the number of matches that product answers report, 0 where they don't."""
    return answers.select(F.coalesce("totalElements", F.lit(0)).alias("total"))


def queries_for(company: Column, brand: Column, number: Column) -> Column:
    """The web queries for a device from the most specific on: an array of (template_no, q)."""
    company, brand = t.first_part(company), t.strip(t.or_empty(brand))
    # fixed values: the wording of the templates
    made = [
        F.concat(company, F.lit(" "), t.shown(number), F.lit(' "Instructions for use" filetype:pdf')),
        F.concat(company, F.lit(" "), brand, F.lit(" "), t.shown(number), F.lit(" IFU filetype:pdf")),
        F.concat(company, F.lit(" "), t.shown(number), F.lit(" manual filetype:pdf")),
    ]
    return F.array(*[F.struct(F.lit(i).alias("template_no"), q.alias("q")) for i, q in enumerate(made, 1)])


def templates(rows: DataFrame, company: str, brand: str, number: str, *columns: str) -> DataFrame:
    """(columns, template_no, q): each device's queries, a row each."""
    return rows.select(*columns, F.inline(queries_for(F.col(company), F.col(brand), F.col(number))))


def acceptable(url: Column, part: str = "pdf") -> Column:
    return t.has(t.or_empty(url), part)


def first_hits(hits: DataFrame, *keys: str, order: str = "rank", most: int = HITS) -> DataFrame:
    """The first `most` hits of each key in an order, numbered from 1 as `n`."""
    numbered = hits.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))
    return numbered.where(F.col("n") <= most)


def is_document(content_type: Column, url: Column, part: str = "pdf") -> Column:
    """Whether an answer's content type or its URL speak of a document: a flag for the log, as answers without it are kept, too."""
    return acceptable(content_type, f"application/{part}") | F.lower(t.or_empty(url)).endswith(f".{part}")


def first_url(hits: DataFrame, *keys: str, order=("template_no", "rank"), url: str = "href", part: str = "pdf", most: int | None = HITS) -> DataFrame:
    """(keys, url): for each key the first acceptable URL by template and rank, of the first `most` hits of each template. A template without hits counts for nothing."""
    rows = hits
    if most is not None and len(order) > 1:
        rows = first_hits(rows, *keys, *order[:-1], order=order[-1], most=most).drop("n")
    return rows.where(acceptable(F.col(url), part)).groupBy(*keys).agg(F.min_by(url, F.struct(*order)).alias(url))
