"""Phrases of words that stand together more often than their parts explain.

All n-grams of one to LONGEST words inside pieces of texts become rows (group, words, phrase, a), counted by group and phrase. A phrase of count FEWEST or more is a candidate. Cut after
any of its words it has two parts, whose counts are joined to it; the lowest of the cuts' scores is its score. Candidates of which a one-word extension is nearly
as frequent go by an anti-join, and each group's best are ranked.

A block of text counts its n-grams before Spark adds up the blocks' rows. No row is made for an n-gram that can't become a candidate: no phrase is more frequent than
a phrase within it, so words are counted first, then pairs of frequent words, then what consists of frequent pairs. What is frequent reaches the tasks as a bit map of 2 ** SIEVE bits,
at every size of the input; where two phrases share a bit, a row too many is made, and its count shows that. Counts are those of the phrases' bytes; inside a
block, n-grams are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, materialise, shared_root, slices, small_batches

#: Words of the longest phrase, the least count of a candidate, and what is shown of a group.
LONGEST, FEWEST, SHOWN = 4, 30, 2000
#: A candidate goes if an extension has this share of its count, in hundredths.
NEARLY = 80
#: Scores are floor(SCALE * a / (l + r)).
SCALE = 2_000_000
#: Bits of a bit map, as a power of two (16 MB), and those of one of its rows.
SIEVE, SIEVE_ROW = 27, 15
#: Bytes of text that are cut into words at once, and n-grams that a block gathers before it counts them.
AT_ONCE, GATHERED = 2 << 20, 1_500_000
#: Bytes that end a piece, and bytes between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9] = 32
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: blank, 2: end
_KIND[list(BLANKS)], _KIND[list(ENDS)] = 1, 2
#: Odd multipliers of the two hashes of a word.
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _segments(text: bytes) -> list[bytes]:
    """A text in parts of about AT_ONCE bytes, cut where pieces end."""
    found = []
    while len(text) > AT_ONCE:
        at = max(text.rfind(e, 0, AT_ONCE) for e in (ENDS[i : i + 1] for i in range(len(ENDS))))
        if at < 0:
            at = min((k for e in (ENDS[i : i + 1] for i in range(len(ENDS))) if (k := text.find(e, AT_ONCE)) >= 0), default=len(text))
        found.append(text[:at])
        text = text[at + 1 :]
    return [*found, text] if text or not found else found


class Words:
    """The words of some texts: where they are in `body` (lower-cased, one blank between the words of a piece), their pieces, groups and hashes."""

    def __init__(self, texts: list[bytes], groups: list[int], seeds: np.ndarray):
        raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = _KIND[raw]
        keep = np.ones(len(raw), bool)
        keep[1:] = (kind[1:] != 1) | (kind[:-1] != 1)
        ends = np.cumsum([len(t) + 1 for t in texts])
        text_ends = np.cumsum(keep, dtype=np.int64)[ends - 1]
        raw, kind = raw[keep], kind[keep]
        word = kind == 0
        edge = np.diff(word.astype(np.int8), prepend=0)
        self.body, self.begin, self.end = raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the last byte is an end
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.begin)
        self.group = np.asarray(groups, np.int32)[np.searchsorted(text_ends, self.begin, side="right")]
        length = self.end - self.begin
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        own = raw[word].astype(np.uint64) + np.uint64(1)
        self.hashes = []
        for k, odd in enumerate(_ODD):
            powers = np.full(int(length.max(initial=0)) + 1, odd)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            sums = np.add.reduceat(own * powers[inside], np.cumsum(length) - length) if len(length) else np.zeros(0, np.uint64)
            self.hashes.append(_mixed(sums + length.astype(np.uint64)) ^ seeds[self.group, k])

    def grams(self, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each word, whether n words of its piece begin with it; and the two hashes of those n words, for all but the last n - 1 words."""
        many = max(0, len(self.begin) - n + 1)
        found = []
        for h in self.hashes:
            g = h[:many]
            for k in range(1, n):
                g = _mixed(g + np.uint64(k)) + h[k : many + k]
            found.append(_mixed(g))
        return self.piece[:many] == self.piece[n - 1 : many + n - 1], found

    def frequent(self, n: int, sieve: np.ndarray) -> np.ndarray:
        """For each word but the last n - 1, whether the n words from it on may be frequent."""
        whole, (h, _) = self.grams(n)
        at = (h >> np.uint64(64 - SIEVE)).astype(np.int64)
        return whole & ((sieve[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _seeds(groups: list[str]) -> np.ndarray:
    """Two numbers for each group."""
    return np.array([np.frombuffer(hashlib.blake2b(g.encode(), digest_size=16).digest(), np.uint64) for g in groups], np.uint64).reshape(-1, 2)


def _strings(body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Parts of a body as strings."""
    length = end - begin
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    data = body[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - begin, length)]
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(data))


class _Block:
    """The n-grams of one number of words that a block of text gathers, counted by their hashes."""

    def __init__(self, n: int):
        self.n, self.size = n, 0
        self.parts: list[tuple] = []

    def add(self, words: Words, which: np.ndarray, hashes: list[np.ndarray]) -> None:
        at = np.flatnonzero(which)
        if len(at):
            self.parts.append((words.body, words.begin[at], words.end[at + self.n - 1], words.group[at], hashes[0][at], hashes[1][at]))
            self.size += len(at)

    def rows(self, groups: list[str]):
        """Record batches (group, words, phrase, a); the block is empty then."""
        if not self.size:
            return
        part = np.repeat(np.arange(len(self.parts)), [len(p[1]) for p in self.parts])
        begin, end, group, g, h = (np.concatenate([p[k] for p in self.parts]) for k in range(1, 6))
        order = np.argsort(g, kind="stable")
        g, h = g[order], h[order]
        new = np.concatenate([[True], g[1:] != g[:-1]])
        if (h[1:] != h[:-1])[~new[1:]].any():  # two phrases share the first hash
            order = order[np.lexsort((h, g))]
            g, h = (np.concatenate([p[k] for p in self.parts])[order] for k in (4, 5))
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])
        first = np.flatnonzero(new)
        counts = np.diff(np.concatenate([first, [len(g)]]))
        one, names = order[first], pa.array(groups, pa.string())
        for k, p in enumerate(self.parts):
            mine = part[one] == k
            who = one[mine]
            for i in range(0, len(who), 100_000):
                some = who[i : i + 100_000]
                columns = [names.take(pa.array(group[some])), pa.array(np.full(len(some), self.n, np.int32)), _strings(p[0], begin[some], end[some]), pa.array(counts[mine][i : i + 100_000])]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "words", "phrase", "a"])
        self.parts, self.size = [], 0


def _texts(batches, column: str):
    """(texts, group of each, names of groups) of about AT_ONCE bytes each."""
    texts, groups, names, size = [], [], {}, 0
    for batch in slices(batches, column, AT_ONCE):
        for text, group in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
            for part in _segments(text or b""):
                texts.append(part)
                groups.append(names.setdefault(group, len(names)))
                size += len(part)
                if size >= AT_ONCE:
                    yield texts, groups, list(names)
                    texts, groups, size = [], [], 0
    if texts:
        yield texts, groups, list(names)


def counted(texts: DataFrame, lengths: tuple[int, ...], fewest: int, sieve=None, sieved: int = 0) -> DataFrame:
    """(group, words, phrase, a) of the n-grams of these lengths with a count of `fewest` or more in a group, from rows (text, group).

    sieve: a broadcast bit map of phrases of `sieved` words; n-grams that hold others are passed over. With single words, a row of 0 words has each group's number of words.
    """

    def run(batches):
        blocks, total, names = [_Block(n) for n in lengths], np.zeros(0, np.int64), []
        bits = np.frombuffer(sieve.value, np.uint8) if sieve else None
        for parts, groups, names in _texts(batches, "text"):
            words = Words(parts, groups, _seeds(names))
            total = np.concatenate([total, np.zeros(len(names) - len(total), np.int64)]) + np.bincount(words.group, minlength=len(names))
            passed = words.frequent(sieved, bits) if sieve else None
            for block in blocks:
                whole, hashes = words.grams(block.n)
                for k in range(block.n - sieved + 1 if sieve else 0):
                    whole &= passed[k : k + len(whole)]
                block.add(words, whole, hashes)
                if block.size >= GATHERED:
                    yield from block.rows(names)
        for block in blocks:
            yield from block.rows(names)
        if 1 in lengths and names:
            columns = [pa.array(names, pa.string()), pa.array([0] * len(names), pa.int32()), pa.array([""] * len(names), pa.string()), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "words", "phrase", "a"])

    small_batches(texts.sparkSession)
    rows = texts.select("text", "group").mapInArrow(run, "group string, words int, phrase string, a long")
    return rows.groupBy("group", "words", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= fewest) | (F.col("words") == 0))


def sieve_of(phrases: DataFrame, words: int):
    """A broadcast bit map of rows (group, phrase) of so many words: 2 ** SIEVE bits, whatever the rows."""

    def run(batches):
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            names = groups.dictionary.to_pylist()
            found = Words(batch.column(1).cast(pa.binary()).to_pylist(), groups.indices.to_pylist(), _seeds(names))
            whole, (h, _) = found.grams(words)
            yield pa.RecordBatch.from_arrays([pa.array((h[whole] >> np.uint64(64 - SIEVE)).astype(np.int64))], names=["bit"])

    bits = phrases.select("group", "phrase").mapInArrow(run, "bit long")
    rows = bits.groupBy(F.shiftright("bit", SIEVE_ROW).alias("row")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND((1 << SIEVE_ROW) - 1)).alias("bits"))
    size = 1 << (SIEVE_ROW - 3)
    whole = bytearray(1 << (SIEVE - 3))
    for r in rows.toLocalIterator():  # 16 MB at most, whatever the rows
        whole[r["row"] * size : (r["row"] + 1) * size] = r["bits"]
    return phrases.sparkSession.sparkContext.broadcast(bytes(whole))


def ngrams(texts: DataFrame, longest: int = LONGEST, fewest: int = FEWEST) -> list[DataFrame]:
    """Tables (group, words, phrase, a) of all n-grams of up to `longest` words with a count of `fewest` or more, from rows (text, group): words (with the totals), pairs, longer ones."""
    tables = [materialise(counted(texts, (1,), fewest), "ngrams")]
    for sieved, lengths in ((1, (2,)), (2, tuple(range(3, longest + 1)))):
        if lengths and lengths[0] <= longest:
            sieve = sieve_of(tables[-1].where(F.col("words") == sieved), sieved)
            tables.append(materialise(counted(texts, lengths, fewest, sieve, sieved), "ngrams"))
            sieve.destroy()
    return tables


def _wide(c) -> Column:
    """A count as a decimal: sums and products of counts pass 64 bits."""
    return (F.col(c) if isinstance(c, str) else F.lit(c)).cast("decimal(18,0)")


def scored(counts: DataFrame) -> DataFrame:
    """(group, phrase, words, a, l, r, score) of the candidates in (group, words, phrase, a), by their lowest cut, ties to the shortest first part."""
    cuts = counts.where("words >= 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    part = lambda name, count: counts.where("words > 0").select("group", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(part("head", "l"), ["group", "head"]).join(part("rest", "r"), ["group", "rest"])
    score = F.call_function("div", _wide("a") * _wide(SCALE), _wide("l") + _wide("r"))
    best = cuts.groupBy("group", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("group", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def unextended(candidates: DataFrame, nearly: int = NEARLY) -> DataFrame:
    """The candidates (group, phrase, words, a) without those of which a longer candidate that holds them has `nearly` hundredths of the count.

    Extensions by one word decide: of two words more, the phrase between has no lesser count, and is a candidate too.
    """
    inner = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)"))
    held = candidates.where("words >= 3").select("group", F.explode(inner).alias("phrase"), "a").groupBy("group", "phrase").agg(F.max("a").alias("longer"))
    held = held.select(F.col("group").alias("group_"), F.col("phrase").alias("phrase_"), "longer")
    same = (F.col("group") == F.col("group_")) & (F.col("phrase") == F.col("phrase_"))
    return candidates.join(held, same & (_wide("longer") * _wide(100) >= _wide("a") * _wide(nearly)), "left_anti")


def collocations(docs: DataFrame, group: Column, longest: int = LONGEST, fewest: int = FEWEST, shown: int = SHOWN) -> DataFrame:
    """(group, rank, phrase, a, l, r, n, score): each group's `shown` best phrases by score, then count, then the phrase's bytes.

    docs has a column `text`; its others aren't read but by the expression `group`, whose null is "und". Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends and into words at
    blanks and tabs; n is the group's number of words. Null and empty texts have no words; repeated rows count each time; an empty table gives no rows.
    """
    shared_root(docs.sparkSession)
    texts = docs.select("text", F.coalesce(group.cast("string"), F.lit("und")).alias("group"))
    tables = ngrams(texts, longest, fewest)
    counts = tables[0]
    for t in tables[1:]:
        counts = counts.unionByName(t)
    best = materialise(scored(counts), "candidates")
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = unextended(best).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)
    totals = counts.where("words = 0").select("group", F.col("a").alias("n"))
    found = materialise(ranked.join(totals, "group").select("group", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    drop_tables(best, *tables)
    return found
