"""Chunk tables whose JSON metadata is shredded at chosen paths, so that a containment filter reaches the scan.

For each path a text column holds what stands there, tagged by its kind: a string, number, boolean or null with its value, anything nested by its kind alone, and null where the path leads nowhere. A filter that asks for
a value at the path becomes an equation with that column, which the scan gets as a pushed filter and row groups are skipped by; as the table is in the order of the first path, most are. The equations are necessary, not
sufficient (numbers are compared as doubles, nested values by kind): the whole containment test follows on the rows that are left, so that results are those of the unindexed filter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonfilter import contains

#: A path: keys from the top, or one text with points between.
Path = str | Sequence[str]


def keys_of(path: Path) -> tuple[str, ...]:
    return tuple(path.split(".")) if isinstance(path, str) else tuple(path)


def columns_of(paths: Sequence[Path]) -> dict[tuple[str, ...], str]:
    """The column of each path; raises ValueError where two paths would share one."""
    names = {keys_of(p): "meta_" + re.sub(r"\W", "_", "_".join(keys_of(p))) for p in paths}
    if len(set(names.values())) < len(names):
        raise ValueError("two paths have one column name")
    return names


def _number(c: Column) -> Column:
    return F.concat(F.lit("n:"), (c.cast("double") + F.lit(0.0)).cast("string"))  # minus zero is zero


def shredded(metadata: Column, path: Path) -> Column:
    """What stands at a path of JSON text, tagged; null where the path leads nowhere or the text isn't JSON."""
    at = F.try_variant_get(F.try_parse_json(metadata), "$" + "".join(f"[{json.dumps(k, ensure_ascii=False)}]" for k in keys_of(path)), "variant")
    kind = F.schema_of_variant(at)
    text = F.when(kind == "STRING", F.concat(F.lit("s:"), F.try_variant_get(at, "$", "string")))
    text = text.when(kind == "BOOLEAN", F.concat(F.lit("b:"), F.try_variant_get(at, "$", "boolean").cast("string"))).when(kind == "VOID", F.lit("z"))
    text = text.when(kind.startswith("OBJECT"), F.lit("o")).when(kind.startswith("ARRAY"), F.lit("a"))
    return F.when(at.isNotNull() | (kind == "VOID"), text.otherwise(F.coalesce(_number(F.try_variant_get(at, "$", "double")), F.lit("?"))))


def tag_of(wanted: Any) -> Column:
    """The tag of a value that a filter asks for."""
    if wanted is None:
        return F.lit("z")
    if isinstance(wanted, bool):
        return F.lit(f"b:{str(wanted).lower()}")
    if isinstance(wanted, (int, float)):
        return _number(F.lit(float(wanted)))
    return F.lit("o") if isinstance(wanted, dict) else F.lit("a") if isinstance(wanted, list) else F.lit(f"s:{wanted}")


def write(rows: DataFrame, path: str, paths: Sequence[Path], metadata: str = "metadata") -> DataFrame:
    """Write rows with a column for each path, in the order of the first, and read them back. Rows with null metadata, or metadata that isn't JSON, stay, with nothing at any path."""
    names = columns_of(paths)
    made = rows.withColumns({name: shredded(F.col(metadata), keys) for keys, name in names.items()})
    if names:
        made = made.repartitionByRange(*names.values()).sortWithinPartitions(*names.values())
    made.write.parquet(path)
    return rows.sparkSession.read.schema(made.schema).parquet(path)


def containing(table: DataFrame, wanted: Any, paths: Sequence[Path], metadata: str = "metadata") -> DataFrame:
    """The rows of a table that write() has made whose metadata contains a value, by the rules of jsonfilter.contains."""
    found = table
    for keys, name in columns_of(paths).items():
        value, there = wanted, isinstance(wanted, dict)
        for k in keys:
            there = there and isinstance(value, dict) and k in value
            value = value[k] if there else None
        if there:
            found = found.where((F.col(name) == tag_of(value)) if not isinstance(value, (int, float)) or isinstance(value, bool) else F.col(name).isin(tag_of(value), F.lit("?")))
    return found.where(contains(F.col(metadata), wanted)).drop(*columns_of(paths).values())
