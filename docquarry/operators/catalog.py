"""The device catalogue: projection, upsert, search, and the work list of documents still to be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..schemas import DEVICE_COLUMNS, DEVICES


def project(raw: DataFrame, names: dict[str, str] = DEVICE_COLUMNS) -> DataFrame:
    """The kept columns under their new names; a column that the file lacks is null."""
    return raw.select(*[(F.col(f"`{a}`") if a in raw.columns else F.lit(None).cast("string")).alias(b) for a, b in names.items()])


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """For each key the row that comes last; rows with a null key are all kept."""
    keyed = rows.where(F.col(key).isNotNull()).withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("__rn = 1").drop("__rn")
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "primary_di", order: str = "seq") -> DataFrame:
    """The device table after a load: of rows with one key the last incoming one gives the values that it supplies, id and creation time stay those of the first insert.

    order: the column of incoming that says which row is last (rows with the same key and order count as one, whose other columns then decide). Rows with a null
    key are always new; their ids follow from their values and order, so that a task that is run again makes the same rows. One pass over both tables and one shuffle by key, instead of batches; no batch is lost for a repeated key.
    """
    supplied = [c for c in incoming.columns if c in DEVICES.names and c not in ("id", "created_at")]
    new = incoming.withColumn("__seq", F.struct(F.col(order), *[c for c in supplied if c != key]))
    nulls = new.where(F.col(key).isNull())
    new = latest(new.where(F.col(key).isNotNull()), key, F.col("__seq"))
    joined = existing.where(F.col(key).isNotNull()).alias("e").join(new.alias("n"), F.col(f"e.{key}") == F.col(f"n.{key}"), "full")
    is_new = F.col(f"n.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == "id":
            return F.coalesce(F.col("e.id"), t.natural_id(F.col(f"n.{key}")))
        if c == "created_at":
            return F.when(F.col(f"e.{key}").isNotNull(), F.col("e.created_at")).otherwise(F.current_timestamp())
        return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")) if c in supplied else F.col(f"e.{c}")

    merged = joined.select(*[value(c).alias(c) for c in DEVICES.names])
    added = nulls.select(*[t.natural_id(F.lit("row"), F.col(order), *[F.col(x) for x in supplied]).alias(c) if c == "id" else F.current_timestamp().alias(c) if c == "created_at" else (F.col(c) if c in supplied else F.lit(None).cast("string")).alias(c) for c in DEVICES.names])
    return merged.unionByName(existing.where(F.col(key).isNull()).select(*DEVICES.names)).unionByName(added)


def batches(rows: DataFrame, order: str, size: int = 1000) -> DataFrame:
    """(batch_no, n, total_inserted): how a load divides into batches of consecutive rows, with a running total.

    Row numbers come from the counts of range partitions, so that no task sees all rows.
    """
    total = rows.count()
    parts = max(1, -(-total // 100_000))
    placed = rows.select(order).repartitionByRange(parts, order).withColumn("__p", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    before = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("c")).withColumn("__b", F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.withColumn("__w", within).join(F.broadcast(before), "__p")
    per = numbered.groupBy(F.expr(f"(__b + __w - 1) div {size}").alias("batch_no")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("total_inserted", F.least(F.lit(total).cast("long"), (F.col("batch_no") + 1) * size))


def search(devices: DataFrame, company: str, company_col: str = "company_name", number_col: str = "catalog_number", order: str = "primary_di", limit: int | None = 5, columns=("primary_di", "company_name", "brand_name", "catalog_number")) -> DataFrame:
    """Devices whose company contains a text, whatever its case, and that have a catalogue number, in the order of a key. % and _ in the text are wildcards."""
    found = devices.where(F.col(company_col).ilike(f"%{company}%") & (F.col(number_col) != "")).select(*columns).orderBy(order)
    return found if limit is None else found.limit(limit)


def skip_existing(devices: DataFrame, files: DataFrame, name: Column, file_col: str = "file_name") -> DataFrame:
    """The devices whose document isn't among the files."""
    return devices.withColumn("__name", name).join(files.select(F.col(file_col).alias("__name")), "__name", "left_anti").drop("__name")


def page(rows: DataFrame, order: str, number: int = 0, size: int = 5) -> DataFrame:
    """One page of a sorted listing."""
    return rows.orderBy(order).offset(number * size).limit(size)


def progress(rows: DataFrame, order: str) -> DataFrame:
    """With idx (1, 2, ... in the order of a unique column) and total. Positions come from the counts of range partitions."""
    parts = max(1, -(-rows.count() // 100_000))
    placed = rows.repartitionByRange(parts, order).withColumn("__p", F.spark_partition_id())
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.orderBy("__p")
    before = sizes.withColumn("__b", F.coalesce(F.sum("c").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("c").over(Window.partitionBy()))
    within = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    return placed.withColumn("__w", within).join(F.broadcast(before), "__p").withColumn("idx", (F.col("__b") + F.col("__w")).cast("long")).drop("__p", "__w", "__b", "c")


def outcomes(rows: DataFrame, done: str = "done") -> DataFrame:
    """(successes, total) of a run; a null outcome counts as a failure."""
    return rows.agg(F.count_if(F.col(done)).alias("successes"), F.count(F.lit(1)).alias("total"))
