"""The search as SQL: json_contains(document, wanted) and match_documents(query_embedding, match_count, filter) of a session.

match_documents is a SQL table function over a table or view of chunks (id, content, metadata, embedding); a call becomes part of the query that calls it, so that the optimizer sees
the chunks' scan, and a constant number of rows becomes a limit before the window. `filter` is JSON that the metadata must contain: '{}', the default, is decided without a look at it, and other filters by
json_contains, for which an Arrow batch of metadata goes to Python.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: A name, or several with points between.
NAME = re.compile(r"\w+(\.\w+)*")

_PRODUCT = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * y), CAST(0 AS DOUBLE), (s, x) -> s + x)"


def holds(value, wanted) -> bool:
    """Whether a parsed JSON value contains another, by the rules of functions.jsonfilter below the top."""
    if isinstance(wanted, dict):
        return isinstance(value, dict) and all(k in value and holds(value[k], w) for k, w in wanted.items())
    if isinstance(wanted, list):
        return isinstance(value, list) and all(any(holds(v, w) for v in value) for w in wanted)
    if isinstance(wanted, bool) or isinstance(value, bool):
        return wanted is value
    if isinstance(wanted, (int, float)):
        return isinstance(value, (int, float)) and value == wanted
    return type(value) is type(wanted) and value == wanted


def _refused(name: str):
    raise ValueError(name)


def contains_text(document: str | None, wanted: str | None) -> bool | None:
    """Whether a JSON text contains another; null where either is null or the document isn't JSON. Raises ValueError for a filter that isn't JSON."""
    if document is None or wanted is None:
        return None
    try:
        value = json.loads(document, parse_constant=_refused)
    except ValueError:
        return None
    asked = json.loads(wanted)
    if asked == {}:
        return True
    return holds(value, asked) or (isinstance(value, list) and not isinstance(asked, (dict, list)) and any(holds(v, asked) for v in value))


def register(spark: SparkSession, chunks: str, id_type: str = "STRING", name: str = "match_documents") -> None:
    """Make json_contains and the named table function over a table or view of chunks part of the session; made again, they are replaced.

    SELECT * FROM match_documents(array(0.1, ...), 5, '{"lang": "en"}'): id, content, metadata, similarity of the nearest chunks by cosine, ties by id. match_count: null, the default, for all.
    Chunks with null metadata never match; those without a vector come last, those of length zero just before them.
    """
    for n in (chunks, name):
        if not NAME.fullmatch(n):
            raise ValueError(f"not a name: {n!r}")

    @F.arrow_udf("boolean")
    def json_contains(document: pa.Array, wanted: pa.Array) -> pa.Array:
        return pa.array([contains_text(d, w) for d, w in zip(document.to_pylist(), wanted.to_pylist())], pa.bool_())

    spark.udf.register("json_contains", json_contains)
    product, own, asked = _PRODUCT.format("c.embedding", "query_embedding"), _PRODUCT.format("c.embedding", "c.embedding"), _PRODUCT.format("query_embedding", "query_embedding")
    length = f"(sqrt({own}) * sqrt({asked}))"
    # vectors of another dimension are at no distance
    distance = f"CASE WHEN size(c.embedding) = size(query_embedding) THEN CASE WHEN {length} = 0 THEN double('NaN') ELSE CAST(1 AS DOUBLE) - {product} / {length} END END"
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(query_embedding ARRAY<DOUBLE>, match_count INT DEFAULT NULL, filter STRING DEFAULT '{{}}')
RETURNS TABLE(id {id_type}, content STRING, metadata STRING, similarity DOUBLE)
RETURN SELECT id, content, metadata, CAST(1 AS DOUBLE) - distance FROM (
  SELECT id, content, metadata, distance, row_number() OVER (ORDER BY distance ASC NULLS LAST, id) AS place FROM (
    SELECT c.id, c.content, c.metadata, {distance} AS distance FROM {chunks} c
    WHERE CASE WHEN filter = '{{}}' THEN try_parse_json(c.metadata) IS NOT NULL ELSE json_contains(c.metadata, filter) END))
WHERE match_count IS NULL OR place <= match_count ORDER BY distance ASC NULLS LAST, id""")
