"""From ranked matches to a cited answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTHING_FOUND = "No relevant IFU sections found."
#: Instructions around the context. Fixed wording.
PROMPT = (
    "You are a precise medical device assistant helping healthcare professionals.\n"
    "Answer the user's question based strictly on the provided IFU document excerpts below.\n"
    "If the answer is not explicitly contained in the excerpts, state that clearly. Do not guess.\n"
    "Use inline citations like [1] to refer to the source excerpts.\n\n"
    "Context:\n{context}\n\nUser Query: {query}\n\nAnswer:"
)


def ranked(matches: DataFrame, *order: Column | str, rank: str = "rank") -> DataFrame:
    """With a rank from 1. Meant for matches, of which there are k."""
    return matches.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def source_of(metadata: Column) -> Column:
    """The source named in JSON metadata: Unknown where the member is missing, None where it is null."""
    parsed = F.try_parse_json(metadata)
    found = F.try_variant_get(parsed, "$.source", "variant")
    text = F.when(F.is_variant_null(found), F.lit("None")).otherwise(F.try_variant_get(parsed, "$.source", "string"))
    return F.coalesce(text, F.lit("Unknown"))


def block(rank: Column, source: Column, content: Column) -> Column:
    """A numbered excerpt."""
    return F.concat(F.lit("Source ["), rank.cast("string"), F.lit("] (File: "), F.coalesce(source, F.lit("Unknown")), F.lit("):\n"), F.coalesce(content, F.lit("None")))


def context(matches: DataFrame, rank: str = "rank", source: Column | None = None, content: str = "content") -> DataFrame:
    """One row: all excerpts in the order of their ranks, a blank line between; null where there are none."""
    source = source_of(F.col("metadata")) if source is None else source
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block(F.col(rank), source, F.col(content)).alias("b"))))
    joined = F.array_join(F.transform(rows, lambda x: x["b"]), "\n\n")
    return matches.agg(F.when(F.count(F.lit(1)) > 0, joined).alias("context"))


def or_nothing_found(rows: DataFrame, found: str = "found") -> DataFrame:
    """One row: the given answer, or the fixed one where rows is empty. Reads one row at most."""
    return rows.limit(1).agg(F.when(F.count(F.lit(1)) == 0, F.lit(NOTHING_FOUND)).otherwise(F.lit(found)).alias("answer"))


def prompt(query: str, text: str) -> str:
    return PROMPT.replace("{context}", text).replace("{query}", query) if "{query}" not in text else "".join([PROMPT.split("{context}")[0], text, PROMPT.split("{context}")[1].replace("{query}", query)])


def response(answer: Column, matches: DataFrame, rank: str = "rank") -> DataFrame:
    """One row with the JSON of an answer and its ranked matches."""
    results = F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.struct("id", "content", "metadata", "similarity").alias("m")))), lambda x: x["m"])
    return matches.agg(F.to_json(F.struct(answer.alias("answer"), results.alias("results"))).alias("response"))
