"""Token counts behind a digest cache.

The cache is a table (digest, n_tokens) in a folder for each version, a digest of the tokenizer's file and library
version; a digest is that of the normalised content (null becomes empty; the tokenizer's own normaliser does the rest, so equal
digests mean equal counts). One pass over the texts makes digests and leaves the texts, each once a block, in block files of the shared folder. Only
digests and places are shuffled: they are reduced to distinct ones and joined to the cache, and of each miss the text at one place is
read back and encoded. The new counts are appended, and the documents joined to them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, blocks, drop_tables, exists, materialise, remove, resident, shared_path, small_batches, tidy

CACHE_SCHEMA = "digest binary, n_tokens long"
#: Units that a worker remembers in each of two generations.
REMEMBERED = 150_000
LONGEST_REMEMBERED = 64
#: Bytes of text in a block.
BLOCK = 4 << 20
#: A space between two such characters always begins a pre-token of the byte-level pattern, whatever stands further off.
BETWEEN_WORDS = re.compile(r"(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")


class Counter:
    """Counts tokens of whole texts as the tokenizers library does, without added begin or end tokens."""

    def __init__(self, definition: bytes):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = json.loads(definition).get("pre_tokenizer") or {}
        spec = json.loads(definition)
        plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("normalized") or t.get("single_word") or " " in t["content"]) for t in spec.get("added_tokens", []))
        #: Whether texts may be cut into units at BETWEEN_WORDS: true for a byte-level pattern without a normaliser.
        self.cuts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and plain
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        """The numbers of tokens of texts."""
        if not self.cuts:
            return self.lengths(texts)
        young, old = self.young, self.old
        missing: dict[str, int] = {}
        cut = []
        for text in texts:
            first, *rest = BETWEEN_WORDS.split(text)
            cut.append(units := [first, *map(" ".__add__, rest)])
            for u in units:
                if u not in young:
                    if u in old:
                        young[u] = old[u]
                    else:
                        missing[u] = 0
        new = list(missing)
        long: dict[str, int] = {}
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for u, n in zip(part, self.lengths(part)):
                (young if len(u) <= LONGEST_REMEMBERED else long)[u] = n
        if long:
            totals = [sum([young[u] if u in young else long[u] for u in units]) for units in cut]
        else:
            totals = [sum(map(young.__getitem__, units)) for units in cut]
        if len(young) >= REMEMBERED:
            self.young, self.old = {}, young
        return totals


def counter_for(definition: bytes) -> Counter:
    """The counter of a tokenizer, built once in each worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return resident("tokens", definition, lambda: Counter(definition))


def version_of(definition: bytes) -> str:
    """Digest of a tokenizer's file and its library's version."""
    import tokenizers

    return hashlib.sha256(definition + b"\0" + tokenizers.__version__.encode()).hexdigest()


def placed(docs: DataFrame, store: Store, id_col: str, text_col: str) -> DataFrame:
    """id, n_bytes, digest, block and row (where the text is stored; null for what the block already has) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, rows in enumerate(blocks(batches, "text", BLOCK)):
            sizes, digests, seen, at = [], [], {}, []
            for text in rows.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                digests.append(digest := hashlib.sha256(raw).digest())
                sizes.append(len(raw))
                at.append(None if digest in seen else len(seen))
                seen.setdefault(digest, text or "")
            block = store.write_new(pa.table({"text": pa.array(seen.values(), pa.string())}), f"{part}-{number}")
            columns = [rows.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([block] * len(at)), pa.array(at, pa.int32())]
            yield from pa.table(columns, names=["id", "n_bytes", "digest", "block", "row"]).to_batches()
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialise(asked.mapInArrow(run, f"id {kind}, n_bytes long, digest binary, block string, row int"), "digests")


def count_tokens(docs: DataFrame, definition: bytes, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8) and n_tokens of every row of docs; counts that the cache lacks are added to it.

    Null texts count as empty (no bytes, no tokens). Null and repeated ids are kept: there is a row for each row of docs.
    Other columns of docs are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = f"{cache_path}/version={version_of(definition)}"
    store = Store(shared_path(spark, "texts"))
    keyed = placed(docs, store, id_col, text_col)

    def known() -> DataFrame:  # a batch that was appended twice, by two runs at a time, counts once
        found = spark.read.schema(CACHE_SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE_SCHEMA)
        return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = keyed.where("row is not null").groupBy("digest").agg(F.min(F.struct("block", "row")).alias("place")).select("digest", "place.*")
    if exists(spark, path):
        misses = misses.join(known(), "digest", "left_anti")
    misses = materialise(misses, "misses")
    given = spark.sparkContext.broadcast(definition)

    def encode(group: pa.Table) -> pa.Table:
        texts = store.read(group.column("block")[0].as_py()).column("text").take(group.column("row")).to_pylist()
        if any(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() != d.as_py() for t, d in zip(texts, group.column("digest"))):
            raise ValueError("a stored text isn't the one of its digest")
        counts = counter_for(given.value).count(texts)
        tidy()
        return pa.table({"digest": group.column("digest"), "n_tokens": pa.array(counts, pa.int64())})

    tasks = max(8, -(-misses.select("block").distinct().count() // 2))
    misses.repartition(tasks, "block").groupBy("block").applyInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(path)
    remove(spark, store.root)
    drop_tables(misses)
    return keyed.join(known(), "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
