"""WARC archives with a two-level capture index.

Writing: each payload of MIN_PAYLOAD bytes or more that several pages share is stored once, as the response of the page with the least
id; the others become revisit records that refer to it. One pass leaves the payloads in block files of the shared folder; only digests and places are
shuffled, to find the roles, and tasks then write the records of whole blocks. Every record is a gzip member of its own. A task writes its
archives to the shared folder under names of its own and returns the places of its records, so what a lost task has
left behind is never referred to.

Index: an entry for each record, sorted by the URL's key (host labels in reverse order, then port, path and query), in
compressed blocks of ENTRIES entries; and a sparse directory with the first key and place of each block, a sorted table. A lookup binary-searches the directory,
reads and unpacks one block or more, binary-searches it, and reads only the record's own range of an archive. Many lookups are done in the order of their keys,
a range of them in each task, which reads the part of the directory and the blocks that its range falls into.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, blocks, materialise, remove, shared_files, shared_path, small_batches, tidy

MIN_PAYLOAD = 100
#: Entries of an index block, and bytes of an archive after which the next is begun.
ENTRIES, ARCHIVE_BYTES = 2000, 256 << 20
#: Bytes of payloads in a block, and of records that one task writes or reads, about.
BLOCK, TASK_BYTES = 8 << 20, 16 << 20
#: Gaps between records up to so many bytes are read along rather than skipped.
READ_ALONG = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PLACES = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """The reversed-host key of a URL: http://www.Example.com:8080/a?b becomes com,example,www:8080)/a?b; fragments are left out."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    port = "" if port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{port}"
    return ",".join(reversed(host.split("."))) + f"{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def one_line(text: str | None) -> str:
    """A header's value: control characters percent-encoded."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in text or "")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}').urn}>", f"WARC-Target-URI: {one_line(url)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page is None else page}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}').urn}>", f"X-Refers-To-Page: {refers_to}"]
    return ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of a record; raises ValueError for what isn't one, or is cut off."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    body, end = rest[: (n := int(fields["content-length"]))], rest[n:]
    if len(body) != n or end != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return fields, body.partition(b"\r\n\r\n")[2]


def stored(pages: DataFrame, store: Store, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """page_id, digest and size of each page's payload, and the block and row where page and payload are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, rows in enumerate(blocks(batches, "payload", BLOCK)):
            block = f"{part}-{number}"
            rows = store.write(rows, block)
            raw = rows.column("payload").to_pylist()
            columns = [rows.column("page_id"), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([len(x) for x in raw], pa.int64()), pa.array([block] * len(raw)), pa.array(range(len(raw)), pa.int32())]
            yield from pa.table(columns, names=["page_id", "digest", "size", "block", "row"]).to_batches()
        tidy()

    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    return materialise(rows.mapInArrow(run, "page_id long, digest string, size long, block string, row int"), "warc-pages")


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each row of pages into archives below root; returns (key, page_id, file, offset, length).

    Null payloads are empty, null URLs an empty target. Rows that repeat an id are records of their own; a page with a null
    id is a response, to which nothing refers. Ids are whole numbers. An empty table writes nothing. Other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    store = Store(shared_path(spark, "pages"))
    rows = stored(pages, store, id_col, url_col, payload_col)
    shared = rows.where(F.col("size") >= MIN_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    roles = rows.join(shared, "digest", "left").select("block", "row", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))
    tasks = int(max(8, -(-(rows.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = shared_files(root)
        name, out, at, block, pages = "", None, 0, None, None
        try:
            for batch in batches:
                places = []
                for of, row, digest, refers in zip(*[c.to_pylist() for c in batch.columns]):
                    if of != block:
                        block, pages = of, store.read(of)
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{inner}/{name}", compression=None)
                    page, url, payload = (pages.column(c)[row].as_py() for c in ("page_id", "url", "payload"))
                    raw = gzip.compress(record(page, url, payload, digest, refers), 6, mtime=0)
                    out.write(raw)
                    places.append((url_key(url), page, name, at, len(raw)))
                    at += len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*places)) or [()] * 5, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])], ["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()
        tidy()

    places = materialise(roles.repartition(tasks, "block").sortWithinPartitions("block", "row").mapInArrow(run, PLACES), "warc-places")
    remove(spark, store.root)
    return places


def build_index(places: DataFrame, root: str, partitions: int) -> DataFrame:
    """Write the index below root, sorted by key; returns its directory (first, last, file, offset, length, entries), a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = shared_files(root)
        out, name, at, waiting, found = None, f"{uuid.uuid4().hex}.cdx", 0, [], []

        def flush() -> None:
            nonlocal out, at
            if out is None:
                out = system.open_output_stream(f"{inner}/{name}", compression=None)
            raw = zlib.compress("\n".join(json.dumps(x) for x in waiting).encode(), 6)
            out.write(raw)
            found.append((waiting[0][0], waiting[-1][0], name, at, len(raw), len(waiting)))
            at += len(raw)
            waiting.clear()

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                waiting.append(row)
                if len(waiting) == ENTRIES:
                    flush()
        if waiting:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), [pa.string()] * 3 + [pa.int64()] * 3)], ["first", "last", "file", "offset", "length", "entries"])

    ordered = places.repartitionByRange(partitions, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    return materialise(ordered.mapInArrow(run, "first string, last string, file string, offset long, length long, entries long"), "warc-directory")


def read_range(system, path: str, offset: int, length: int) -> bytes:
    with system.open_input_file(path) as f:
        return f.read_at(length, offset)


def entries(system, inner: str, file: str, offset: int, length: int) -> list[list]:
    """The entries (key, page_id, file, offset, length) of an index block."""
    return [json.loads(x) for x in zlib.decompress(read_range(system, f"{inner}/{file}", offset, length)).decode().split("\n")]


class Archive:
    """Lookups by URL: the directory is held sorted, everything else is read on demand."""

    def __init__(self, directory: list[tuple], root: str):
        self.blocks = sorted(tuple(x)[:5] for x in directory)
        self.lasts = [b[1] for b in sorted(self.blocks, key=lambda b: (b[1], b[0]))]
        self.system, self.inner = shared_files(root)

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Fields and payload of all records of a URL's key; a revisit's payload is empty."""
        key, out = url_key(url), []
        for first, last, file, offset, length in self.blocks[bisect.bisect_left(self.lasts, key) :]:
            if first > key:
                break
            found = entries(self.system, self.inner, file, offset, length)
            for _, _, name, at, n in found[bisect.bisect_left(found, key, key=lambda x: x[0]) : bisect.bisect_right(found, key, key=lambda x: x[0])]:
                out.append(parsed(gzip.decompress(read_range(self.system, f"{self.inner}/{name}", at, n))))
        return out


def url_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(key): the distinct keys of the URLs of pages; null URLs have an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], ["key"])

    return pages.select(F.col(url_col).alias("url")).mapInArrow(run, "key string").distinct()


def find(spark: SparkSession, directory: DataFrame, root: str, keys: DataFrame, partitions: int) -> DataFrame:
    """(file, offset, length) of all records of the given keys, by binary search in the directory and in the index blocks. Keys are taken in order, a range in each task."""
    folders = sorted({f.rpartition("/")[0] for f in directory.inputFiles()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        system, inner = shared_files(root)
        tables = [ds.dataset(shared_files(f)[1], filesystem=shared_files(f)[0], format="parquet") for f in folders]
        held: tuple = (None, [])
        for batch in batches:
            wanted = batch.column(0).to_pylist()  # in order
            if not wanted:
                continue
            near = [t.to_table(filter=(pc.field("first") <= wanted[-1]) & (pc.field("last") >= wanted[0])) for t in tables]
            part = sorted((r["last"], r["first"], r["file"], r["offset"], r["length"]) for t in near for r in t.to_pylist())
            found = []
            for key in wanted:
                for last, first, file, offset, length in part[bisect.bisect_left(part, key, key=lambda x: x[0]) :]:
                    if first > key:
                        break
                    if held[0] != (file, offset):
                        held = ((file, offset), entries(system, inner, file, offset, length))
                    rows = held[1]
                    found += [x[2:] for x in rows[bisect.bisect_left(rows, key, key=lambda x: x[0]) : bisect.bisect_right(rows, key, key=lambda x: x[0])]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [()] * 3, [pa.string(), pa.int64(), pa.int64()])], ["file", "offset", "length"])

    ordered = keys.repartitionByRange(partitions, "key").sortWithinPartitions("key")
    return materialise(ordered.mapInArrow(run, "file string, offset long, length long"), "warc-found")


def read(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest and refers_to of the records at (file, offset, length).

    Payloads of responses are read back and their digests made anew; a digest that differs from the record's raises an error.
    """
    tasks = int(max(8, -(-(found.agg(F.sum("length")).first()[0] or 0) // (TASK_BYTES // 4))))  # records are compressed

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = shared_files(root)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        name, f, rows, size = None, None, [], 0
        begin = end = 0
        held = b""
        for batch in batches:
            for file, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f, begin, end = file, system.open_input_file(f"{inner}/{file}"), 0, 0
                if not begin <= offset <= offset + length <= end:
                    begin, held = offset, f.read_at(max(length, READ_ALONG), offset)
                    end = begin + len(held)
                fields, payload = parsed(gzip.decompress(held[offset - begin : offset - begin + length]))
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of page {fields['x-page-id']} differs from its digest")
                page = int(fields["x-page-id"]) if fields["x-page-id"] else None
                refers = int(fields["x-refers-to-page"]) if kind == "revisit" else None
                rows.append((page, fields["warc-target-uri"], kind, payload if kind == "response" else None, len(payload) if kind == "response" else int(fields["x-payload-length"]), digest, refers))
                size += len(payload)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
        if f is not None:
            f.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    spread = found.withColumn("part", F.expr("offset div 1048576"))  # ranges of a file go to several tasks
    ordered = spread.repartition(tasks, "file", "part").sortWithinPartitions("file", "offset").drop("part")
    return ordered.mapInArrow(records, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")
