"""JSON containment: a driver-side value becomes an expression over a JSON text column.

The rules are those of SQL JSON containment: an object holds another if it holds each of its members; an array holds
another if each element of the other is held by some element; at the top, an array also holds a scalar among its
elements; numbers compare by value, strings, booleans and nulls exactly. A null column value gives null, so such rows
never pass a filter, not even the empty one.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _holds(v: Column, *, wanted: Any) -> Column:
    """Whether a variant holds a value; false where it doesn't, never null."""
    kind = F.coalesce(_kind(v), F.lit("absent"))
    if isinstance(wanted, dict):
        found = kind.startswith("OBJECT")
        for key, value in wanted.items():
            path = "$[" + json.dumps(key, ensure_ascii=False) + "]" if not key.isidentifier() else f"$.{key}"
            found = found & _holds(F.try_variant_get(v, path, "variant"), wanted=value)
        return found
    if isinstance(wanted, list):
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        found = kind.startswith("ARRAY")
        for value in wanted:
            found = found & F.exists(items, _holder(value))
        return found
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & F.coalesce(F.try_variant_get(v, "$", "boolean") == F.lit(wanted), F.lit(False))
    if isinstance(wanted, (int, float)):
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        exact = F.try_variant_get(v, "$", "double") == F.lit(float(wanted))
        if isinstance(wanted, int):
            exact = exact & F.coalesce(F.try_variant_get(v, "$", "decimal(38,0)") == F.lit(wanted).cast("decimal(38,0)"), F.lit(False))
        return numeric & F.coalesce(exact, F.lit(False))
    return (kind == "STRING") & F.coalesce(F.try_variant_get(v, "$", "string") == F.lit(wanted), F.lit(False))


def _holder(wanted: Any):
    return lambda x: _holds(x, wanted=wanted)


def contains(column: Column, wanted: Any = None) -> Column:
    """Whether the JSON in a text column contains a value (a dict, list or scalar); null where the column is null or not JSON."""
    parsed = F.try_parse_json(column)
    if wanted is None or wanted == {}:
        return F.when(parsed.isNotNull(), F.lit(True))
    found = _holds(parsed, wanted=wanted)
    if not isinstance(wanted, (dict, list)):
        items = F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.array().cast("array<variant>"))
        found = found | F.exists(items, _holder(wanted))
    return F.when(parsed.isNotNull(), found)
