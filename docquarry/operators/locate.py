"""Finding passages on the pages of their documents.

Three behaviours: "first" takes the passage's first 40 characters and the first page with them (null if none); "viewer" is the
same, but shows page 1 if none; "all" takes 50 characters and every page. An empty term finds nothing. Case doesn't matter.

The distinct terms of a document form one automaton (Aho-Corasick), and each of its pages is read once for all of them, however
many passages ask. Where terms are few, pages stay where they are read; else pages and terms meet in one join by document, of which
adaptive execution can split a document of very many pages; a document of very many terms has them in several shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import search_term
from ..session import scratch

FIRST, ALL = 40, 50
#: Terms of up to so many bytes are broadcast.
BROADCAST_BYTES = 16 << 20
#: Distinct terms of one document that an automaton holds, about: a page is read once for so many.
TERMS = 1000
SPANS = "array<struct<begin:int,end:int>>"


def asked_terms(passages: DataFrame, key: str, passage: str, term: Column | None, length: int, id_col: str) -> DataFrame:
    """(id, key, term) of all passages as a table in the shared folder; term is in lower case."""
    term = search_term(F.col(passage), length) if term is None else term
    path = scratch(passages.sparkSession, "passages")
    rows = passages.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.lower(term).alias("term"))
    rows.write.parquet(path)
    return passages.sparkSession.read.schema(rows.schema).parquet(path)


def scanned(batches: Iterator[pa.RecordBatch], with_spans: bool) -> Iterator[pa.RecordBatch]:
    """(key, page_no, term, spans) for each page and each term on it, from pages with (share, terms); the automaton of a (key, share) stays as long as rows of it follow."""
    import ahocorasick

    place = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    group = automaton = None
    for batch in batches:
        rows, found_terms, places = [], [], []
        groups = zip(batch.column("key").to_pylist(), batch.column("share").to_pylist(), strict=True)
        terms, bodies = batch.column("terms"), batch.column("body")
        for i, name in enumerate(groups):
            if name != group:
                group, automaton = name, ahocorasick.Automaton()
                for term in terms[i].as_py():
                    automaton.add_word(term, term)
                automaton.make_automaton()
            found: dict[str, list[tuple[int, int]]] = {}
            for last, term in automaton.iter(bodies[i].as_py()):
                begin, seen = last + 1 - len(term), found.setdefault(term, [])
                if not seen or with_spans and begin >= seen[-1][1]:
                    seen.append((begin, last + 1))
            rows += [i] * len(found)
            found_terms += found
            places += found.values()
        at = pa.array(rows, pa.int64())
        spans = pa.array([[{"begin": b, "end": e} for b, e in p] if with_spans else [] for p in places], place)
        yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("page_no").take(at), pa.array(found_terms, pa.string()), spans], ["key", "page_no", "term", "spans"])


def terms_on_pages(asked: DataFrame, pages: DataFrame, key: str = "source", with_spans: bool = True) -> DataFrame:
    """(key, page_no, term, spans): a row for each page and each term that is asked of its document and stands there.

    asked has (key, term), terms in lower case, with any repeats; null keys, null and empty terms find nothing, nor does a null page. Pages that repeat a number are pages like others.
    spans are the (begin, end) character offsets in the page's lower-case text, from left to right without overlaps; empty, unless with_spans.
    """
    terms = asked.where("term <> '' AND key IS NOT NULL").select("key", "term")
    size = terms.agg(F.sum(F.octet_length("term") + F.octet_length(F.col("key").cast("string")))).first()[0] or 0
    few = size <= BROADCAST_BYTES
    if few:  # all terms together are small, and so are those of a document
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / TERMS).cast("int")), lambda i: F.slice("all", i * TERMS + 1, F.lit(TERMS)))
        packs = terms.groupBy("key").agg(F.collect_set("term").alias("all")).select("key", F.posexplode(parts).alias("share", "terms"))
    else:
        terms = terms.distinct()
        shares = terms.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TERMS).alias("shares"))
        share = F.pmod(F.xxhash64("term"), F.col("shares")).cast("int").alias("share")
        packs = terms.join(shares, "key").groupBy("key", share).agg(F.collect_list("term").alias("terms"))
    rows = pages.where("page_text IS NOT NULL").select(F.col(key).alias("key"), F.col("page_no").cast("long").alias("page_no"), F.lower("page_text").alias("body"))
    met = rows.join(F.broadcast(packs) if few else packs, "key").select("key", "share", "page_no", "body", "terms")
    offsets = T.ArrayType(T.StructType().add("begin", "integer").add("end", "integer"))
    out = T.StructType().add("key", asked.schema["key"].dataType).add("page_no", "long").add("term", "string").add("spans", offsets)
    return met.mapInArrow(lambda batches: scanned(batches, with_spans), out)


def first_page(passages: DataFrame, pages: DataFrame, key: str = "source", passage: str = "content", id_col: str = "id", term: Column | None = None) -> DataFrame:
    """(id, found_page, ui_page) of each passage: the first page with the term or null, and the page to show."""
    asked = asked_terms(passages, key, passage, term, FIRST, id_col)
    found = terms_on_pages(asked, pages, key, with_spans=False).groupBy("key", "term").agg(F.min("page_no").alias("found_page"))
    return asked.join(found, ["key", "term"], "left").select(F.col("id").alias(id_col), "found_page", F.coalesce("found_page", F.lit(1).cast("long")).alias("ui_page"))


def all_pages(passages: DataFrame, pages: DataFrame, key: str = "source", passage: str = "content", id_col: str = "id") -> DataFrame:
    """(id, key, page_no, spans): every page with the term, and its places there."""
    asked = asked_terms(passages, key, passage, None, ALL, id_col)
    return asked.join(terms_on_pages(asked, pages, key), ["key", "term"]).select(F.col("id").alias(id_col), F.col("key").alias(key), "page_no", "spans")


def highlighted(passages: DataFrame, pages: DataFrame, key: str = "source", passage: str = "content", id_col: str = "id") -> DataFrame:
    """(id, found_page, spans) of the first page with the term; null and no spans if there is none."""
    asked = asked_terms(passages, key, passage, None, FIRST, id_col)
    first = terms_on_pages(asked, pages, key).groupBy("key", "term").agg(F.min_by(F.struct("page_no", "spans"), "page_no").alias("f"))
    none = F.array().cast(SPANS)
    return asked.join(first, ["key", "term"], "left").select(F.col("id").alias(id_col), F.col("f.page_no").alias("found_page"), F.coalesce("f.spans", none).alias("spans"))


def with_documents(results: DataFrame, files: DataFrame, source: Column, name: str = "file_name") -> DataFrame:
    """Results with the file of the document that each is from; null columns where there is none."""
    return results.withColumn("__source", source).join(files, F.col("__source") == files[name], "left").drop("__source")


def any_found(found: DataFrame) -> DataFrame:
    """One row: whether there is any page."""
    return found.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))
