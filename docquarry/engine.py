"""The service surface: health, search, locate, ingest."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import Embedder, HashingEmbedder, Synthesizer, VerbatimSynthesizer, document_vectors
from .operators import answer, chunking, locate, matching
from .schemas import CHUNKS, PAGES
from .sources import sinks

log = logging.getLogger(__name__)
#: Results of the interactive search.
SHOWN = 5
#: The answer where synthesis fails. Fixed wording.
DEGRADED = "Could not generate synthesis. Raw context retrieved.\n\nError: {}"


@dataclass(frozen=True)
class Settings:
    """Where an engine's tables are; read from the session's configuration. Nothing secret is needed."""

    chunks: str | None = None
    pages: str | None = None

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        return cls(*(spark.conf.get(f"spark.docquarry.{f}", None) or None for f in cls.__dataclass_fields__))

    def missing(self) -> list[str]:
        return [f"spark.docquarry.{f}" for f in self.__dataclass_fields__ if getattr(self, f) is None]

    def require(self) -> Settings:
        """These settings; raises ValueError naming those that a batch job misses."""
        if self.missing():
            raise ValueError(f"not configured: {', '.join(self.missing())}")
        return self


@dataclass
class Engine:
    """An engine over a chunk table and a page table; either may be missing, which health() tells."""

    spark: SparkSession
    chunks: DataFrame | None = None
    pages: DataFrame | None = None
    embedder: Embedder = field(default_factory=HashingEmbedder)
    synthesizer: Synthesizer = field(default_factory=VerbatimSynthesizer)

    @classmethod
    def configured(cls, spark: SparkSession, settings: Settings | None = None, **models) -> Engine:
        """An engine over the configured tables; one that isn't configured is missing, and the service runs without it."""
        settings = settings or Settings.of(spark)
        tables = [None if path is None else spark.read.schema(schema).parquet(path) for path, schema in ((settings.chunks, CHUNKS), (settings.pages, PAGES))]
        return cls(spark, *tables, **models)

    def health(self) -> dict[str, Any]:
        """{status, db_connected}: whether there is a chunk table that can be read just now."""
        connected = self.chunks is not None
        try:
            connected and self.chunks.limit(1).collect()
        except Exception as e:  # noqa: BLE001
            log.warning("the chunk table can't be read: %s", e)
            connected = False
        return {"status": "ok", "db_connected": connected}

    def _need(self, table: DataFrame | None, name: str) -> DataFrame:
        if table is None:
            raise RuntimeError(f"the engine has no {name} table")
        return table

    def search(self, query: str, limit: int | None = SHOWN, where: Any = None) -> dict[str, Any]:
        """{answer, results}: the chunks nearest to a query and an answer from them. If synthesis fails, the results stay and the answer says so."""
        chunks = self._need(self.chunks, "chunk")
        vector = self.embedder.embed([query], "query")[0]
        found = matching.match(chunks.drop("content"), vector, limit, where).select("id", "metadata", "similarity")  # texts don't go through the ranking
        rows = [r.asDict() for r in found.collect()]  # `limit` rows
        keys = list({r["id"] for r in rows})
        contents = chunks.select("id", "metadata", "content") if limit is None else chunks.where(F.col("id").isin(keys)).select("id", "metadata", "content")
        texts: dict[tuple, list] = {}
        for r in contents.collect() if rows else []:
            texts.setdefault((r["id"], r["metadata"]), []).append(r["content"])
        rows = [{"id": r["id"], "content": texts[r["id"], r["metadata"]].pop(), **r} for r in rows]
        if not rows:
            return {"answer": answer.NOTHING_FOUND, "results": []}
        matches = self.spark.createDataFrame([(i, r["content"], r["metadata"]) for i, r in enumerate(rows, 1)], "rank int, content string, metadata string")
        text = answer.context(matches).first()["context"]
        try:
            said = self.synthesizer.answer(answer.prompt(query, text), [r["content"] or "" for r in rows])
        except Exception as e:  # noqa: BLE001  results are worth more than an answer
            said = DEGRADED.format(e)
        return {"answer": said, "results": rows}

    def locate(self, source: str, text: str) -> dict[str, Any]:
        """{found_page, spans} of a passage in a document; raises FileNotFoundError for a document without pages."""
        pages = self._need(self.pages, "page").where(F.col("source") == source)
        if pages.isEmpty():
            raise FileNotFoundError(source)
        passage = self.spark.createDataFrame([("x", source, text)], "id string, source string, content string")
        row = locate.highlighted(passage, pages).first()
        return {"found_page": row["found_page"], "spans": [s.asDict() for s in row["spans"]]}

    def ask(self, query: str) -> dict[str, Any]:
        """The interactive search: an empty query is refused; the first result's passage is located, and if that fails the results stay, with page 1 shown."""
        if not query.strip():
            raise ValueError("the query is empty")
        found = self.search(query, SHOWN)
        found["shown"] = None
        if found["results"]:
            first = self.spark.createDataFrame([(found["results"][0]["metadata"],)], "metadata string").select(answer.source_of(F.col("metadata")).alias("s")).first()["s"]
            try:
                place = self.locate(first, found["results"][0]["content"] or "")
                found["shown"] = {"source": first, "page": place["found_page"] or 1, "spans": place["spans"]}
            except Exception as e:  # noqa: BLE001
                log.warning("no page for %s: %s", first, e)
                found["shown"] = {"source": first, "page": 1, "spans": []}
        return found

    def search_batch(self, requests: DataFrame, limit: int = SHOWN) -> DataFrame:
        """(query_id, rk, id, similarity) for requests (query_id, query), all in one search; ids of chunks must be whole numbers, or their text."""
        chunks = self._need(self.chunks, "chunk")
        asked = requests.select("query_id", document_vectors(self.embedder, "query")(F.col("query")).alias("embedding"))
        found = matching.nearest(chunks.select(F.col("id").cast("long").alias("id"), "embedding"), asked, limit, key="id", query_key="query_id")
        return found.select(F.col("q_id").alias("query_id"), "rk", "id", (F.lit(1.0) - F.col("distance")).alias("similarity"))

    def highlight(self, source: str, text: str, content: bytes, render: Callable[[bytes, int, list[dict]], bytes]) -> dict[str, Any]:
        """{content, headers}: a document's bytes with a passage marked by an injected renderer, and the page in X-Found-Page; unmarked, and without the header, where the passage isn't found."""
        place = self.locate(source, text)
        if place["found_page"] is None:
            return {"content": content, "headers": {}}
        return {"content": render(content, place["found_page"], place["spans"]), "headers": {"X-Found-Page": str(place["found_page"])}}

    def ingest(self, pages: DataFrame, path: str) -> DataFrame:
        """Chunk, embed and append the texts of pages to the chunk table at a path; returns the table."""
        rows = chunking.chunk_rows(chunking.whole_texts(pages), embed=document_vectors(self.embedder))
        sinks.append(rows, path)
        self.chunks, self.pages = self.spark.read.schema(rows.schema).parquet(path), pages
        return self.chunks
