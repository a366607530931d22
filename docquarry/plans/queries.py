"""The query set over the test tables, which stand in for the domain's.

documents: extracted texts; embeddings: their vectors; part: the device catalogue; labels: work that is done; conversations: ordered pages and
nested lists; pages: candidate URLs; events: a keyed feed with JSON metadata.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vectors
from ..functions.jsonfilter import contains
from ..operators import answer, catalog, chunking, feeds, locate, matching
from ..session import scratch
from . import oracles

#: The vector that searches start from, and the most rows of the single-vector searches.
QUERY_ID, TOP = 0, 5
PAGE = 500


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vector(embeddings: DataFrame) -> list[float]:
    """One row's vector."""
    return list(embeddings.where(F.col("vec_id") == QUERY_ID).select("embedding").first()[0])


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their vectors and JSON metadata."""
    docs, rows = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    metadata = F.to_json(F.struct("source", "lang"))
    return rows.join(docs.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), metadata.alias("metadata"), "lang", "source"), "vec_id").withColumnRenamed("vec_id", "id")


def nearest_documents(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    """The rows nearest to the query vector, with their texts: ids are ranked first, and the texts' scan gets those that are found as a filter."""
    docs, rows = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    about = docs.select(F.col("doc_id").alias("id"), F.to_json(F.struct("source", "lang")).alias("metadata"), "lang", "source")
    found = matching.match(rows.withColumnRenamed("vec_id", "id").join(about, "id"), query_vector(rows), TOP, where)
    return matching.with_contents(found, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


def match_documents_topk(spark, sf_dir):
    return nearest_documents(spark, sf_dir).select("id", "content", F.round("similarity", 6).alias("similarity"))


def match_documents_filtered(spark, sf_dir):
    return nearest_documents(spark, sf_dir, {"lang": "en", "source": "src1"}).select("id", "lang", F.round("similarity", 6).alias("similarity"))


def match_documents_nolimit(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return matching.match(rows, query_vector(read(spark, sf_dir, "embeddings")), None, metadata=None).select("id", F.round("similarity", 6).alias("similarity"))


def inner_product_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return matching.match(rows, query_vector(read(spark, sf_dir, "embeddings")), TOP, metadata=None, inner=True).select("id", F.round("similarity", 6).alias("similarity"))


def knn_batch(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return matching.nearest(rows, rows, TOP).select("q_id", "vec_id", "rk")


def json_containment(spark, sf_dir):
    return read(spark, sf_dir, "events").where(contains(F.col("props"), {"k": 69})).select("event_id", "props")


def chunk_documents(spark, sf_dir):
    return chunking.chunks(read(spark, sf_dir, "documents").select("doc_id", "text"))


def chunk_counts(spark, sf_dir):
    return chunking.counts(chunking.chunks(read(spark, sf_dir, "documents").select("source", "text")))


def chunk_metadata(spark, sf_dir):
    rows = chunking.chunks(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "chunk_index", chunking.metadata(F.col("source"), F.col("chunk_index")).alias("metadata"))


def chunk_ids(spark, sf_dir):
    """Natural ids are distinct: chunks and distinct ids by source."""
    rows = chunking.chunk_rows(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"))


def page_concat(spark, sf_dir):
    return chunking.whole_texts(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "full_text")


def catalog_project(spark, sf_dir):
    names = {"p_partkey": "primary_di", "p_brand": "brand_name", "p_name": "description", "p_type": "catalog_number"}
    return catalog.project(read(spark, sf_dir, "part"), names)


def catalog_search(spark, sf_dir):
    return catalog.search(read(spark, sf_dir, "part"), "WIDGET", "p_name", "p_type", "p_partkey", 5, ("p_partkey", "p_name", "p_brand", "p_type"))


def catalog_upsert(spark, sf_dir):
    return catalog.latest(read(spark, sf_dir, "events"), "user_id", F.col("event_id")).select("user_id", "event_id", "event_type", "value")


def load_batches(spark, sf_dir):
    return catalog.batches(read(spark, sf_dir, "events"), "event_id").orderBy("batch_no")


def _top_ranked(spark, sf_dir):
    q = query_vector(read(spark, sf_dir, "embeddings"))
    found = nearest_documents(spark, sf_dir).withColumn("distance", vectors.cosine_distance(F.col("embedding"), vectors.literal(q)))
    return answer.ranked(found, F.col("distance").asc_nulls_last(), "id")


def rag_context(spark, sf_dir):
    return answer.context(_top_ranked(spark, sf_dir))


def empty_result_fallback(spark, sf_dir):
    return answer.or_nothing_found(read(spark, sf_dir, "documents").where("lang = 'xx'"))


def search_term(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", t.search_term(F.col("text")).alias("term"))


def _pages(spark, sf_dir):
    cut = chunking.chunks(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", PAGE, 0, "page", "page_text")
    return cut.select("doc_id", (F.col("page") + 1).alias("page_no"), "page_text")


def locate_first_page(spark, sf_dir):
    """Every chunk of every document, on the pages of its document."""
    cut = chunking.chunks(read(spark, sf_dir, "documents").select("doc_id", "text"))
    passages = cut.withColumn("id", F.struct("doc_id", "chunk_index"))
    found = locate.first_page(passages, _pages(spark, sf_dir), "doc_id")
    return found.select("id.doc_id", "id.chunk_index", "found_page", "ui_page")


def locate_all_pages(spark, sf_dir):
    passages = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return locate.all_pages(passages, _pages(spark, sf_dir), "doc_id").select("doc_id", "page_no")


def skip_existing(spark, sf_dir):
    done = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_name"))
    return catalog.skip_existing(read(spark, sf_dir, "documents"), done, F.col("doc_id")).select("doc_id")


def safe_file_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", t.file_name(F.col("page_id"), F.col("url")).alias("file_name"))


def display_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", t.title(F.col("url"), ".html").alias("display_name"))


def query_templates(spark, sf_dir):
    rows = read(spark, sf_dir, "part")
    made = feeds.templates(rows, "p_brand", "p_name", "p_type", "p_partkey")
    return made.select("p_partkey", F.col("template_no").cast("long").alias("template_no"), "q")


def first_url(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), "page_id", "url")
    return feeds.first_url(rows, "host", order=("page_id",), url="url", part=".html", most=None)


def hits_per_host(spark, sf_dir):
    """The first three pages of each host."""
    rows = read(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), "page_id")
    return feeds.first_hits(rows, "host", order="page_id").withColumnRenamed("n", "rank")


def limit_then_filter(spark, sf_dir):
    return feeds.first_then(read(spark, sf_dir, "part"), "p_partkey", 20, F.col("p_type") != "ECONOMY").select("p_partkey", "p_name")


def nested_documents(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("items"))
    language = F.when(F.col("item.role") == "user", F.lit("EN")).when(F.col("item.role").isNotNull(), F.col("item.role"))
    kept = feeds.nested(turns, feeds.wanted(language, F.col("item.text"), "the"), "items", "conv_id")
    return kept.select("conv_id", "turn", "role")


def paging(spark, sf_dir):
    return catalog.page(read(spark, sf_dir, "part"), "p_partkey", 2, 5).select("p_partkey", "p_name")


def suffix_filter(spark, sf_dir):
    return read(spark, sf_dir, "pages").where(F.lower("url").endswith(".html")).select("page_id", "url")


def progress_position(spark, sf_dir):
    return catalog.progress(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


def base64_text(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.base64(F.encode("p_name", "utf-8")).alias("b64"))


def outcomes(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("done")), "doc_id", "left")
    return catalog.outcomes(rows)


def stream_ingest(spark, sf_dir):
    """The chunks of all documents, taken in as a stream that stops when it has seen everything."""
    from ..streaming.ingest import ingest_table

    root = scratch(spark, "stream")
    schema = read(spark, sf_dir, "documents").select("text", "source").schema
    path = f"{sf_dir}/documents.parque[t]"  # a pattern, as streams read folders and patterns only
    ingest_table(spark, path, schema, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{root}/table")
    return rows.select(F.get_json_object("metadata", "$.source").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"))


ALL = [
    match_documents_topk, match_documents_filtered, match_documents_nolimit, inner_product_topk, knn_batch, json_containment, chunk_documents, chunk_counts, chunk_metadata, chunk_ids,
    page_concat, catalog_project, catalog_search, catalog_upsert, load_batches, rag_context, empty_result_fallback, search_term, locate_first_page, locate_all_pages, skip_existing, safe_file_name,
    display_name, query_templates, first_url, hits_per_host, limit_then_filter, nested_documents, paging, suffix_filter, progress_position, base64_text, outcomes, stream_ingest,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import surface

    return {f.__name__: f for f in [*ALL, *surface.ALL]}


def oracle_sql() -> dict[str, str]:
    from . import surface

    return oracles.SQL | surface.SQL
