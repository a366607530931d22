"""Benchmark decontamination by a positional inverted index, with DataFrame operations alone.

The index is a stored table of postings (term, next, id, key, at), a row for each word of each document with the word after it, in files by document as they are
read: building it shuffles nothing, and every later set of test items is looked up in it without a look at the texts. A posting with an empty term closes each
document and gives its number of words.

Each window of an item is a run of word pairs. It is looked up by its rarest pair, by the counts of all postings: a posting, shifted by the pair's offset, says where
the window would begin. The list of these places is intersected with the postings of those other pairs that together hold all words, at their own offsets; a
place at which each of them has its posting is a match. Pairs keep the lists short: they grow with what items and documents share, not with how common words are.

Only what follows from the items is broadcast, after a check of their size; places and postings of the asked pairs meet in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, exists, materialise, shared_path

#: Everything below U+0080 that is no digit or lower-case letter separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many bytes of test texts, what follows from them is broadcast; beyond, it meets postings in a shuffle.
BROADCAST_TEXT_BYTES = 2 << 20


def words_of(text: Column) -> Column:
    """The words of a text, ASCII letters in lower case; null: none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows_of(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(item, phrase): each width consecutive words of an item, or all of them where there are fewer; none for an item without words."""
    words = items.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    return words.select("item", "words", F.explode(starts).alias("start")).select("item", F.slice("words", F.col("start"), F.lit(width)).alias("phrase")).distinct()


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the postings (term, next, id, key, at) of documents to a new path, unless it is there, and read them; key: a hash of the text, which tells documents with equal ids apart.

    at counts words from 0. Null texts have no words: only the closing posting with an empty term. Null ids are ids like others; rows that repeat id and text
    are one document. Other columns are ignored, whatever their names. An empty table gives an index without postings."""
    spark = docs.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), words_of(F.col(text_col)).alias("words"))
        closed = words.select("id", "key", F.concat("words", F.array(F.lit(""))).alias("term")).withColumn("next", F.slice("term", F.lit(2), F.size("term")))
        rows = closed.select("id", "key", F.posexplode(F.arrays_zip("term", "next")).alias("at", "word")).select("word.term", "word.next", "id", "key", "at")
        # terms repeat: a larger dictionary keeps them as numbers, and delta encoding makes next to nothing of places in order
        rows.write.option("compression", "zstd").option("parquet.dictionary.page.size", 16 << 20).option("parquet.writer.version", "PARQUET_2_0").parquet(path)
    kind = docs.schema[id_col].dataType.simpleString()
    return spark.read.schema(f"term string, next string, id {kind}, key long, at int").parquet(path)


def small(items: DataFrame, text_col: str) -> bool:
    """Whether the texts of the items are few enough bytes for their terms to be broadcast."""
    return (items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) <= BROADCAST_TEXT_BYTES


def near(items: DataFrame, broadcast: bool) -> DataFrame:
    """A table that follows from the items, marked for a broadcast if they are small."""
    return F.broadcast(items) if broadcast else items


def ranked(parts: DataFrame, index: DataFrame, keys: list[str], broadcast: bool) -> DataFrame:
    """(w, by): for each w of the parts (w, size, offset, keys), its (n, offset, keys) from the rarest on, by the counts of all postings. Those with a part that occurs nowhere are left out: they can't be found."""
    wanted = parts.select(*keys).distinct()
    counts = index.select(*keys).join(near(wanted, broadcast), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    by = parts.join(counts, keys).groupBy("w", "size").agg(F.array_sort(F.collect_list(F.struct("n", "offset", *keys))).alias("by"))
    return materialise(by.where(F.size("by") == F.col("size")).select("w", "by"), "ranked")


def led(index: DataFrame, windows: DataFrame, keys: list[str], broadcast: bool) -> DataFrame:
    """(w, id, key, begin): where windows (w, offset, keys) would begin, by the postings of their keys."""
    postings = index.where("term <> ''").select("id", "key", "at", *keys)
    return postings.join(near(windows.select("w", "offset", *keys), broadcast), keys).where("at >= offset").select("w", "id", "key", (F.col("at") - F.col("offset")).alias("begin"))


def phrase_matches(index: DataFrame, items: DataFrame, width: int = 10, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, key, item, begin, end: the places of all documents of an index where a window of an item stands, as word positions from begin (0 is the first) to before end.

    A window is width consecutive words of an item, or all of them where there are fewer; items without words have none. Items with null or repeated ids are
    items like others. Empty tables give no matches. Other columns of items are ignored.
    """
    broadcast = small(items, item_text_col)
    windows = windows_of(items, item_col, item_text_col, width)
    phrases = materialise(windows.select("phrase").distinct().withColumn("w", F.monotonically_increasing_id()), "phrases")
    pair = ["term", "next"]
    pairs = phrases.select("w", (F.size("phrase") - 1).alias("size"), F.col("phrase").alias("term"), F.slice("phrase", F.lit(2), F.size("phrase")).alias("next"))
    pairs = pairs.select("w", "size", F.posexplode(F.arrays_zip(*pair)).alias("offset", "pair")).select("w", "size", "offset", "pair.*").where("next is not null")
    by = ranked(pairs, index, pair, broadcast).withColumn("lead", F.col("by")[0])
    # every second pair and the last one hold all words of a window
    others = F.filter("by", lambda x: ((x["offset"] % 2 == 0) | (x["offset"] == F.size("by") - 1)) & (x["offset"] != F.col("lead.offset")))
    by = by.select("w", "lead.term", "lead.next", "lead.offset", others.alias("others"))
    found = materialise(led(index, by, pair, broadcast).distinct().join(near(by.select("w", "others"), broadcast), "w"), "found")
    asked = found.select("w", "id", "key", "begin", F.size("others").alias("size"), F.inline("others")).withColumn("at", F.col("begin") + F.col("offset"))
    postings = index.join(near(by.select(F.inline("others")).select(*pair).distinct(), broadcast), pair, "left_semi")
    a, i = asked.alias("a"), postings.alias("i")
    same = [F.col(f"a.{c}") == F.col(f"i.{c}") for c in (*pair, "at", "key")] + [F.col("a.id").eqNullSafe(F.col("i.id"))]
    held = a.join(i, same, "left_semi").groupBy("w", "id", "key", "begin", "size").agg(F.countDistinct("at").alias("held")).where("held = size")
    found = held.select("w", "id", "key", "begin").unionByName(found.where(F.size("others") == 0).select("w", "id", "key", "begin"))
    alone = phrases.where(F.size("phrase") == 1).select("w", F.col("phrase")[0].alias("term"), F.lit(0).alias("offset"))
    if not alone.isEmpty():
        found = found.unionByName(led(index, alone, ["term"], broadcast).distinct())
    named = windows.join(phrases, "phrase").select("w", "item", F.size("phrase").alias("size")).distinct()
    return found.join(near(named, broadcast), "w").select("id", "key", "item", "begin", (F.col("begin") + F.col("size")).alias("end"))


def proximity_matches(index: DataFrame, items: DataFrame, span: int, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, key, item, at: the positions of an item's rarest term in a document from which all its other terms are less than span words away.

    Nulls, repeated rows and empty tables as for phrase_matches; an item without words matches nothing.
    """
    broadcast = small(items, item_text_col)
    words = items.select(F.col(item_col).alias("item"), F.array_sort(F.array_distinct(words_of(F.col(item_text_col)))).alias("phrase")).where(F.size("phrase") > 0).distinct()
    phrases = materialise(words.select("phrase").distinct().withColumn("w", F.monotonically_increasing_id()), "phrases")
    terms = phrases.select("w", F.size("phrase").alias("size"), F.posexplode("phrase").alias("offset", "term"))
    by = ranked(terms, index, ["term"], broadcast)
    first = by.select("w", F.col("by")[0]["term"].alias("term"), F.slice("by", 2, F.greatest(F.size("by") - 1, F.lit(1))).alias("rest"))
    found = index.where("term <> ''").join(near(first, broadcast), "term").select("w", "id", "key", "at", "rest")
    found = materialise(found, "found")
    asked = found.select("w", "id", "key", "at", F.size("rest").alias("size"), F.inline("rest")).select("w", "id", "key", F.col("at").alias("place"), "size", "term")
    i, p = index.join(near(first.select(F.inline("rest")).select("term").distinct(), broadcast), "term", "left_semi").alias("i"), asked.alias("p")
    met = (F.col("i.term") == F.col("p.term")) & (F.col("i.key") == F.col("p.key")) & F.col("i.id").eqNullSafe(F.col("p.id")) & (F.abs(F.col("i.at") - F.col("p.place")) < span)
    held = i.join(p, met).select("p.*").groupBy("w", "id", "key", "place", "size").agg(F.countDistinct("term").alias("held")).where("held = size")
    alone = found.where(F.size("rest") == 0).select("w", "id", "key", "at")
    named = words.join(phrases, "phrase").select("w", "item")
    return held.select("w", "id", "key", F.col("place").alias("at")).unionByName(alone).join(named, "w").select("id", "key", "item", "at").distinct()


def hits(index: DataFrame, matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each document of an index: id, key, n_words, n_hit (words inside any match), items (those that match, in the order of strings).

    There is a row for each id and text, null ids among them; texts without words have no hits. An empty index gives no rows, and without matches no word is hit."""
    spans = F.array_sort(F.collect_set(F.struct("begin", "end")))
    found = matches.groupBy("id", "key").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))
    covered = F.aggregate("spans", start, lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["begin"], a["reach"]))).alias("hit"), F.greatest(a["reach"], x["end"]).alias("reach")))
    found = found.select(F.col("id").alias("of"), F.col("key").alias("of_key"), covered["hit"].cast("long").alias("n_hit"), "items")
    every = index.where("term = ''").select("id", "key", F.col("at").cast("long").alias("n_words")).distinct()
    joined = every.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    return joined.select(F.col("id").alias(id_col), "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", index_path: str | None = None, **names: str) -> DataFrame:
    """The rows of docs in which no window of an item stands, whatever their other columns are called; the index is made at index_path, or a new path, unless it is there.

    Texts without words, null ones too, stay; rows that repeat id and text stay or go together, and null ids are ids like others. Without items everything stays; an empty table stays empty.
    The names docquarry_id and docquarry_key are reserved."""
    index = build_index(docs, index_path or shared_path(docs.sparkSession, "index"), id_col, text_col)
    bad = phrase_matches(index, items, width, **names).select(F.col("id").alias("docquarry_id"), F.col("key").alias("docquarry_key")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("docquarry_id")) & (F.xxhash64(text_col) == F.col("docquarry_key")), "left_anti")
