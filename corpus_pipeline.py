"""A pipeline over a corpus: each stage works on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with all their columns, whatever those are called; the last
returns their tokens. Null and empty texts, repeated rows and rows with a null id pass through every stage but where the stage's own
docstring says so; an empty table stays empty. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import decontamination, near_duplicates, sentencepiece_codec, suffix_dedup, toxicity
from docquarry.llm import queries as corpora
from docquarry.llm.common import materialise, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model learnt from the labels doesn't call toxic: rows whose score is below 0.5.

    Null and empty texts have the score of a sentence without words. Repeated rows have equal scores, and go or stay together; so do ties at 0.5, which go."""
    scored = toxicity.score(docs, corpora.toxicity_model(spark, docs, sf_dir), score_col="docquarry_score")
    return scored.where("docquarry_score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates.

    Texts without words, null ones too, and rows with a null id are in no group and stay. Rows that repeat an id stay or go together: they go if any of them is
    near a document with a lesser id."""
    dropped = near_duplicates.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("docquarry_id")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("docquarry_id"), "left_anti").select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier one has; n_chars counts what is left.

    Characters of which a byte goes, go whole. Null texts become empty; rows with a null id keep their text, and nothing is removed because of them. Of rows that
    repeat an id, none is earlier than another."""
    clash = {c: f"docquarry_{c}" for c in ("spans", "kept") if c in docs.columns}
    done = suffix_dedup.remove_repeats(docs.withColumnsRenamed(clash), as_text=True)
    done = done.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).drop("spans", "kept")
    return done.withColumnsRenamed({b: a for a, b in clash.items()}).select(*docs.columns)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no ten words of a benchmark item stand, nor a whole item of fewer words.

    Texts without words, null ones too, stay; rows that repeat id and text stay or go together, and rows with a null id are judged like others."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text of every whole text, a row for each row of docs. Null texts count as empty."""
    coded = sentencepiece_codec.roundtrip(docs.select("doc_id", "text"), corpora.tokenizer_file("piece_bpe_32k.model"))
    return sentencepiece_codec.digests(coded)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("suffix-dedup", remove_repeated_passages),
    ("decontamination", reject_contaminated),
    ("sentencepiece", encode),
]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
