"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, context_tree, decontamination, language_id, merkle, near_duplicates, oracles, resharding, sentencepiece_codec, suffix_dedup, token_counts, topk, toxicity, warc
from .common import ascii_lower, doc_crc, shared_path, table

#: Old and new shards of the resharding.
OLD_SHARDS, NEW_SHARDS = 6, 8
#: Documents of more tokens are marked.
TOKEN_LIMIT = 512


def tokenizer_file(name: str) -> bytes:
    """The bytes of a public tokenizer's file."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents. The cache is a new one for each call, so that a call never profits from an earlier one."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), shared_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.digests(sentencepiece_codec.roundtrip(docs, tokenizer_file("piece_bpe_32k.model")))


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from six old shards, by source and so of unequal sizes, into eight of near equal bytes, moving the fewest bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(OLD_SHARDS))
    rows, _ = resharding.reshard(docs, old, NEW_SHARDS, OLD_SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of each fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    found = topk.search(vectors, vectors.where("vec_id % 50 = 0"))
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of all documents without the 50-byte strings of earlier ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digests(suffix_dedup.remove_repeats(docs))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose ids aren't in the held-out fold, a seventh."""
    held_out = doc_crc(F.col("doc_id")) % 7 == 2
    scored = context_tree.score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.withColumn("held_out", ~F.col("training")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside windows of ten words of any benchmark item."""
    index = decontamination.build_index(table(spark, sf_dir, "documents"), shared_path(spark, "index"))
    matches = decontamination.phrase_matches(index, table(spark, sf_dir, "benchmark"))
    return decontamination.hits(index, matches).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and indexed; then every page's URL is looked up in the index, and what it finds is read back."""
    root, tasks, pages = shared_path(spark, "archives"), max(8, spark.sparkContext.defaultParallelism), table(spark, sf_dir, "pages")
    directory = warc.build_index(warc.write(pages, root), root, tasks)
    found = warc.find(spark, directory, root, warc.url_keys(pages), tasks)
    return warc.read(spark, root, found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """The model learnt from the labels of documents outside the held-out fold."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), doc_crc(F.col("doc_id")) % 5 != 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; a fifth of the ids is held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (doc_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by language, and the root that each document's proof leads to after a third of them was changed."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.when(doc_crc(F.col("doc_id")) % 3 == 0, merkle.leaf(*fields[:-1], ascii_lower(F.col("text"))))
    leaves = docs.select("doc_id", F.col("lang").alias("group"), merkle.leaf(*fields).alias("digest"), changed.alias("changed"))
    made = merkle.manifest(leaves, [F.col("doc_id").asc_nulls_first()]).withColumn("claimed", F.coalesce("changed", "digest"))
    shown = [merkle.as_text(F.col(c)).alias(n) for c, n in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))]
    proof = F.sha2(merkle.as_text(F.col("siblings")), 256).alias("proof_sha256")
    return merkle.folded(made, "claimed", "led_to").select("doc_id", *shown, proof, merkle.as_text(F.col("led_to")).alias("folded_root"), (F.col("led_to") == F.col("root")).alias("verified"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to four words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), F.col("lang")).withColumnRenamed("group", "lang")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by a model of those whose ids aren't in the held-out fold, a third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = doc_crc(F.col("doc_id")) % 3 == 1
    model = language_id.fit(docs.where(~held_out).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_off", "ambiguous")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_counts, op2_sentencepiece, op3_resharding, op4_topk, op5_suffix_dedup, op6_warc, op7_context_tree, op8_decontamination, op9_toxicity, op10_near_duplicates, op11_merkle_manifest, op12_collocations, op13_language_id]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express over whole tables."""
    return dict(oracles.SQL)
