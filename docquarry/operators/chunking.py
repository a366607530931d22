"""From pages to overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_id

SIZE, OVERLAP = 1024, 128


def chunks(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, index: str = "chunk_index", content: str = "content") -> DataFrame:
    """A row for each window of `size` characters, one every size - overlap, numbered from 0; none for null and empty texts.

    The last window is kept even if the one before holds all of it.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and less than the size")
    step = size - overlap
    # a text is divided once into pieces of a step each, and a window put together from the pieces that it reaches into
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    window = lambda _, i: F.substring(F.array_join(F.slice("__pieces", i + 1, F.lit(-(-size // step))), ""), 1, size)
    others = [c for c in docs.columns if c not in (text, index, content)]
    cut = docs.select(*others, pieces.alias("__pieces")).select(*others, F.posexplode(F.transform("__pieces", window)).alias(index, content))
    return cut.select(*others, F.col(index).cast("long").alias(index), content)


def whole_texts(pages: DataFrame, key: str = "source", order: str = "page_no", text: str = "page_text", out: str = "text") -> DataFrame:
    """Each document's pages in order, a line end after every page."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: F.concat(r["t"], F.lit("\n"))), "").alias(out))


def metadata(source: Column, index: Column) -> Column:
    """{"source": ..., "chunk_index": ...} as JSON text; a null source stays in it as null."""
    return F.to_json(F.struct(source.alias("source"), index.alias("chunk_index")), {"ignoreNullFields": "false"})


def chunk_rows(docs: DataFrame, source: str = "source", text: str = "text", embed=None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Rows for the chunk table: id, content, metadata and, by an embedding function over columns, the vector.

    Ids follow from source and number, so a second run makes the same rows.
    """
    cut = chunks(docs.select(F.col(source).alias("source"), F.col(text).alias("text")), "text", size, overlap)
    vector = embed(F.col("content")) if embed else F.lit(None).cast("array<float>")
    return cut.select(natural_id(F.col("source"), F.col("chunk_index")).alias("id"), "content", metadata(F.col("source"), F.col("chunk_index")).alias("metadata"), vector.alias("embedding"))


def counts(rows: DataFrame, key: str = "source") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))
