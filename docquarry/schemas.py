"""Table and feed schemas. Nothing is inferred from data."""

from pyspark.sql import types as T

S, L = T.StringType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


#: Chunks of documents with their vectors; metadata is JSON text, {"source": ..., "chunk_index": ...}.
CHUNKS = _struct(id=S, content=S, metadata=S, embedding=T.ArrayType(T.FloatType()))
MATCHES = _struct(id=S, content=S, metadata=S, similarity=T.DoubleType())
DEVICES = _struct(id=S, primary_di=S, brand_name=S, company_name=S, model_number=S, catalog_number=S, description=S, created_at=T.TimestampType())
PAGES = _struct(source=S, page_no=T.IntegerType(), page_text=S)
PAGES_OR_ERRORS = _struct(source=S, page_no=T.IntegerType(), page_text=S, error=S)
HITS = _struct(query_id=S, template_no=T.IntegerType(), rank=T.IntegerType(), href=S)

#: Columns of the delimited catalogue file that are kept, and their names in the device table.
DEVICE_COLUMNS = {
    "PrimaryDI": "primary_di",
    "brandName": "brand_name",
    "companyName": "company_name",
    "versionModelNumber": "model_number",
    "catalogNumber": "catalog_number",
    "deviceDescription": "description",
}

#: Answer of the device search service.
DEVICE_FEED = _struct(**{"search-result": _struct(device=T.ArrayType(_struct(catalogNumber=S, brandName=S, deviceDescription=S)))})
#: Answer of the product search service.
PRODUCT_FEED = _struct(
    totalElements=L,
    content=T.ArrayType(_struct(id=S, name=S, gtin=S, documents=T.ArrayType(_struct(id=S, title=S, fileUuid=S, documentType=_struct(name=S), language=_struct(isoCode=S))))),
)


def create_tables(spark, location: str | None = None) -> None:
    """Drop and create the tables chunks and devices as Parquet tables of the session's catalogue, below location if it is given."""
    for name, schema in (("chunks", CHUNKS), ("devices", DEVICES)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        options = {"path": f"{location.rstrip('/')}/{name}"} if location else {}
        spark.catalog.createTable(name, source="parquet", schema=schema, **options)


def refresh(spark, name: str) -> None:
    """Make other readers of the session see a table's new files."""
    spark.catalog.refreshTable(name)


def readable(df, predicate=None):
    """Row-level read access: rows for which the predicate holds; without one, all rows may be read."""
    return df if predicate is None else df.where(predicate)
