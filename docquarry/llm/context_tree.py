"""Language-model scores by context-tree weighting, beside a word-unigram base.

Texts are bytes with A-Z in lower case, and an end. A symbol is nine binary decisions: whether the text ends, else the eight bits of a byte. Each
decision has a context tree over the DEPTH bytes before it, the nearest first. A node estimates by Krichevsky-Trofimov, and weighs its own
estimate against its children's: P_w = P_e / 2 + prod(P_w of children) / 2. The weights of all depths on the path are mixed into the probability
of a decision. A child that has seen nothing leaves the decision to its parent. All bytes are symbols, and every context of the training texts counts by itself.

Texts are packed into blocks where they are read. A block sends its distinct n-grams (context and symbol), with their training counts, to a reducer by the two
nearest bytes of the context, so that whole subtrees meet there. What a reducer finds of its subtrees' weights is summed by nearest byte: 256 nodes
and the root, of 512 decisions each, are all that the driver and every task see of other subtrees. The reducers then answer each block's n-grams with
their log-probabilities, and the block sums them along its texts. What is counted, moved and answered grows with the distinct n-grams of the blocks.

Base: log10((c + 1) / (N + 1 * (V + 1))) for each word and the end; words are counted by their bytes, in the same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, blocks, materialise, packed, shared_path, small_batches, tidy, unpacked

#: Bytes of context; of them, those that choose a reducer. A key has the context's bytes from the top, the nearest first, and the symbol's byte below.
DEPTH, TOP = 6, 2
SHIFT = np.uint64(64 - 8 * DEPTH)  # below the context, 16 bits
#: The end's byte in a key, and the byte that stands before each text; no UTF-8 text has them. As a symbol, the end is the number after all bytes.
END_BYTE, PAD, END = 0xFE, 0xFF, 256
LEVELS, DECISIONS, DECISION = 9, 512, np.uint64(0x1FF)
#: Bytes of text in a block, and for each reducer.
BLOCK, PARTITION = 8 << 20, 16 << 20
LN2, LNPI = float(np.log(2.0)), float(np.log(np.pi))


def lowered(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case; nulls are empty."""
    return pc.ascii_lower(pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, ""))


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key of every symbol of texts, ends included, and the text that each is of; the last text comes first, and the last symbol of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    pad, end = bytes([PAD]) * DEPTH, bytes([END_BYTE])
    line = np.frombuffer(b"".join([pad + t + end for t in texts]) + bytes(8), np.uint8)[::-1].copy()[8:]
    line = np.append(line, np.zeros(9, np.uint8))
    n = len(line) - 9
    key = np.ndarray(n, ">u8", line, 1, (1,)).astype(np.uint64)  # the eight bytes before each one, the nearest first
    key &= ~np.uint64(0xFFFF)
    key |= line[:n]
    begins = n - np.cumsum(sizes + DEPTH + 1)
    real = np.ones(n, bool)
    real[(begins[:, None] + (sizes + 1)[:, None] + np.arange(DEPTH)).ravel()] = False
    return key[real], np.repeat(np.arange(len(texts), dtype=np.int32)[::-1], sizes[::-1] + 1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, word) of each word of lower-case texts, as numbers, and the distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    text, word = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy()), coded.indices.to_numpy()
    real = pc.binary_length(coded.dictionary).to_numpy() > 0  # spaces at either end make empty ones
    number = np.cumsum(real) - 1
    keep = real[word] if len(word) else np.zeros(0, bool)
    return text[keep], number[word[keep]], coded.dictionary.filter(pa.array(real))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their summed counts."""
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function, for positive numbers."""
    y, low = x + 8.0, np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


SMALL = 4096
HALVES, WHOLES = lgamma(np.arange(SMALL) + 0.5), lgamma(np.arange(SMALL) + 1.0)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    n0, n1 = n0.astype(np.int64), n1.astype(np.int64)
    large = n0 + n1 >= SMALL
    a, b = np.where(large, 0, n0), np.where(large, 0, n1)
    out = HALVES[a] + HALVES[b] - WHOLES[a + b] - LNPI
    if large.any():
        a, b = n0[large].astype(np.float64), n1[large].astype(np.float64)
        out[large] = lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - LNPI
    return out


class Nodes(NamedTuple):
    """The nodes of one depth and level, in order. key: context and decision; zeros, ones; weighted: log P_w; stop: the share of the node's own estimate;
    parent: the place of each node's parent among those one depth above, none at depth TOP."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    stop: np.ndarray
    parent: np.ndarray


def parted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts and symbols of keys."""
    symbol = keys & np.uint64(0xFF)
    return keys >> SHIFT, np.where(symbol == END_BYTE, np.uint64(END), symbol)


def decision(symbol: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The number (below DECISIONS) of a symbol's decision at a level, and how it goes."""
    return np.uint64(1 << level) | (symbol >> np.uint64(LEVELS - level)), (symbol >> np.uint64(LEVELS - 1 - level)) & np.uint64(1)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P_w of nodes with children whose log P_w sum to below, and the share of the nodes' own estimates."""
    own = log_kt(zeros, ones)
    weighted = np.logaddexp(own, below) - LN2
    return weighted, np.exp(np.minimum(own - LN2 - weighted, 0.0))


def subtrees(keys: np.ndarray, counts: np.ndarray) -> list[list[Nodes]]:
    """The nodes of all depths from TOP to DEPTH, by depth and level, from distinct keys in order and their counts (above zero)."""
    found: list[list[Nodes]] = []
    context, symbol = parted(keys)
    merged, counts = summed((context << np.uint64(9)) | symbol, counts)
    for depth in range(DEPTH, TOP - 1, -1):
        if depth < DEPTH:
            merged, counts = summed(((context >> np.uint64(8)) << np.uint64(9)) | symbol, counts)
        context, symbol = merged >> np.uint64(9), merged & DECISION
        levels = []
        for level in range(LEVELS):
            inner = np.flatnonzero(symbol < END) if level else slice(None)
            number, bit = decision(symbol[inner], level)
            key = (context[inner] << np.uint64(9)) | number
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
            n = np.add.reduceat(counts[inner], first) if len(first) else np.empty(0, np.int64)
            ones = np.add.reduceat(counts[inner] * bit.astype(np.int64), first) if len(first) else n
            key = key[first]
            if found:
                child = found[-1][level]
                parent = np.searchsorted(key, ((child.key >> np.uint64(17)) << np.uint64(9)) | (child.key & DECISION))
                found[-1][level] = child._replace(parent=parent)
                weighted, stop = weigh(n - ones, ones, np.bincount(parent, child.weighted, len(key)))
            else:
                weighted, stop = log_kt(n - ones, ones), np.ones(len(key))
            levels.append(Nodes(key, n - ones, ones, weighted, stop, first[:0]))
        found.append(levels)
    return found[::-1]


class Crown(NamedTuple):
    """What lies above the subtrees, dense: for each depth below TOP, rows of contexts and columns of decisions. seen; chance: of a one, where nothing longer is
    known. below: of depth TOP - 1, what a child adds its own estimate to, and by which share."""

    seen: list[np.ndarray]
    chance: list[np.ndarray]
    below: tuple[np.ndarray, np.ndarray]


def crown_of(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Crown:
    """The crown from the 256 contexts of one byte: counts and sums of log P_w of the children, by decision."""
    own, stop, seen, chance = [], [], [], []
    for _ in range(TOP):
        weighted, share = weigh(zeros, ones, below)
        n = zeros + ones
        own.insert(0, (ones + 0.5) / (n + 1.0))
        stop.insert(0, share)
        seen.insert(0, n > 0)
        zeros, ones, below = zeros.sum(0, keepdims=True), ones.sum(0, keepdims=True), np.where(n > 0, weighted, 0.0).sum(0, keepdims=True)
    fixed, passed = np.zeros((1, DECISIONS)), np.ones((1, DECISIONS))
    for x, share in zip(own, stop):
        chance.append(fixed + passed * x)
        fixed, passed = fixed + passed * share * x, np.broadcast_to(passed * (1.0 - share), x.shape)
    return Crown(seen, chance, (fixed, passed))


def log10_of(trees: list[list[Nodes]], crown: Crown, keys: np.ndarray) -> np.ndarray:
    """log10 of the probability of each key's symbol in its context."""
    context, symbol = parted(keys)
    total = np.zeros(len(keys))
    for level in range(LEVELS):
        # from the crown down: the chance of a one at each node, where nothing longer is known
        chances, fixed, passed = [], None, None
        for nodes in (levels[level] for levels in trees):
            if fixed is None:
                row, column = (nodes.key >> np.uint64(17)).astype(np.int64), (nodes.key & DECISION).astype(np.int64)
                fixed, passed = crown.below[0][row, column], crown.below[1][row, column]
            else:
                fixed, passed = fixed[nodes.parent], passed[nodes.parent]
            own = (nodes.ones + 0.5) / (nodes.zeros + nodes.ones + 1.0)
            chances.append(fixed + passed * own)
            fixed, passed = fixed + passed * nodes.stop * own, passed * (1.0 - nodes.stop)
        left = np.flatnonzero(symbol < END) if level else np.arange(len(keys))
        number, bit = decision(symbol[left], level)
        for depth in range(DEPTH, -1, -1):
            above = context[left] >> np.uint64(8 * (DEPTH - depth))
            if depth >= TOP:
                nodes = trees[depth - TOP][level]
                key = (above << np.uint64(9)) | number
                at = np.minimum(np.searchsorted(nodes.key, key), max(0, len(nodes.key) - 1))
                seen = nodes.key[at] == key if len(nodes.key) else np.zeros(len(key), bool)
                chance = chances[depth - TOP][at[seen]]
            else:
                row, column = above.astype(np.int64), number.astype(np.int64)
                seen = crown.seen[depth][row, column]
                chance = crown.chance[depth][row[seen], column[seen]]
            total[left[seen]] += np.log10(np.where(bit[seen] > 0, chance, 1.0 - chance))
            left, number, bit = left[~seen], number[~seen], bit[~seen]
        total[left] += np.log10(0.5)  # nothing is known at all
    return total


def columns(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones, and so on, which packs better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def uncolumns(raw: memoryview, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).reshape(-1).view(kind)


def grams_packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys in order, and counts."""
    return packed(columns(np.diff(keys, prepend=np.uint64(0))) + columns(counts.astype(np.uint32)))


def grams_unpacked(body) -> tuple[np.ndarray, np.ndarray]:
    raw = memoryview(unpacked(body))
    n = len(raw) // 12
    return np.cumsum(uncolumns(raw, n, np.uint64), dtype=np.uint64), uncolumns(raw[8 * n :], n, np.uint32).astype(np.int64)


#: Kinds of rows. GRAM and WORD: what a block asks (or, with the same bucket, is answered); PART: sums for a node of the crown; TOTAL: tokens and distinct words.
GRAM, WORD, PART, TOTAL = range(4)
SENT = "bucket int, kind int, block string, body binary"
COUNTED = "block string, kind int, bucket int, body binary, node int, zeros long, ones long, below double"


def by_word(words: pa.Array, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of words by bucket, and (bucket, begin, end) of each run."""
    if not len(words):
        return np.empty(0, np.int64), []
    size = pc.binary_length(words).to_numpy()
    begin = np.cumsum(size) - size
    value = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
    body = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8)
    return runs_of(((np.add.reduceat(value[body], begin) >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64))


def runs_of(to: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by bucket, and (bucket, begin, end) of each run."""
    by = np.argsort(to, kind="stable")
    first = np.flatnonzero(np.diff(to[by], prepend=-1))
    return by, list(zip(to[by][first].tolist(), first.tolist(), [*first[1:].tolist(), len(to)]))


def bucket_of_gram(buckets: int) -> np.ndarray:
    """The bucket of each pair of nearest bytes: in a fixed random order, so that the pairs of one byte, of which some are frequent, spread, and up to 65,536 buckets all get as many pairs."""
    return (np.random.default_rng(7).permutation(1 << (8 * TOP)) % buckets).astype(np.int32)


def distinct_ngrams(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how many of each are of training texts; keys is used up."""
    low, one = np.uint64(0xFFFF), np.uint64(1)
    symbol = keys & low
    symbol <<= one
    keys &= ~low
    keys |= symbol
    del symbol
    keys |= training
    keys.sort()  # a place for the mark is left below the symbol
    learnt = (keys & one).astype(bool)
    keys >>= one
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    counts = np.add.reduceat(learnt, first, dtype=np.int64) if len(first) else first
    own = keys[first] << one
    return (own & ~low) | ((own & low) >> one), counts


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of keys by bucket, and (bucket, begin, end) of each run."""
    return runs_of(bucket_of_gram(buckets)[(keys >> np.uint64(64 - 8 * TOP)).astype(np.int64)])


def answers_of(group: pa.Table, kind: int) -> dict[int, pa.Buffer]:
    return {b: unpacked(x.as_buffer()) for k, b, x in zip(group.column("kind").to_pylist(), group.column("bucket").to_pylist(), group.column("body")) if k == kind}


def rows_of(block: list[str], kind: list[int], bucket: list[int], body: list[bytes]) -> pa.Table:
    """Answers to blocks, as COUNTED rows."""
    n = len(block)
    given = [pa.array(block, pa.string()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary())]
    return pa.table([*given, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())], names=["block", "kind", "bucket", "body", "node", "zeros", "ones", "below"])


def parts_of(trees: list[list[Nodes]]) -> pa.Table:
    """What subtrees add to the crown, as COUNTED rows."""
    node, zeros, ones, below = [], [], [], []
    for nodes in trees[0]:
        key, at = np.unique(((nodes.key >> np.uint64(17)) << np.uint64(9)) | (nodes.key & DECISION), return_inverse=True)
        node.append(key.astype(np.int32))
        for out, x in ((zeros, nodes.zeros), (ones, nodes.ones), (below, nodes.weighted)):
            out.append(np.bincount(at.ravel(), x, len(key)))
    node, zeros, ones, below = (np.concatenate(x) for x in (node, zeros, ones, below))
    n = len(node)
    return pa.table([pa.nulls(n, pa.string()), pa.array(np.full(n, PART, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(node, pa.int32()), pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64)), pa.array(below.astype(np.float64))], names=["block", "kind", "bucket", "body", "node", "zeros", "ones", "below"])


def gathered(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All distinct keys of blocks, and their summed counts."""
    while len(parts) > 1:  # in pairs, so that repeated keys go early
        parts = [summed(*(np.concatenate(x) for x in zip(*parts[i : i + 2]))) for i in range(0, len(parts), 2)]
    return parts[0]


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, training (whether the row was learnt from), n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of docs.

    training is an expression over the columns of docs. Null texts count as empty: they have only their end. Null and repeated ids are kept, a row each. Without
    any training text nothing is known, and the model gives each decision one half. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    learnt = F.coalesce(training, F.lit(False))
    total = docs.agg(F.sum(F.octet_length(text_col)), F.sum(learnt.cast("long"))).first()
    ends, buckets, tasks = total[1] or 0, int(max(8, -(-(total[0] or 0) // PARTITION))), int(max(8, -(-(total[0] or 0) // (2 * BLOCK))))
    store = Store(shared_path(spark, "blocks"))
    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col).alias("id"), learnt.alias("training"), F.col(text_col).alias("text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, block in enumerate(blocks(batches, "text", BLOCK)):
            name = f"{part}-{number}"
            block = store.write(block, name)
            low, learns = lowered(block.column("text")), np.array(block.column("training").to_pylist(), bool)
            keys, of = ngrams(low.cast(pa.binary()).to_pylist())
            of = learns[of]
            keys, counts = distinct_ngrams(keys, of)
            by, runs = dealt(keys, buckets)
            keys, counts = keys[by], counts[by]
            rows = [(b, GRAM, grams_packed(keys[x:y], counts[x:y])) for b, x, y in runs]
            of, word, words = words_of(low)
            counts = np.bincount(word[learns[of]], minlength=len(words))
            by, runs = by_word(words, buckets)
            words = words.cast(pa.binary()).take(pa.array(by)).to_pylist()
            rows += [(b, WORD, packed(np.array([y - x, *counts[by[x:y]]], np.int64).tobytes() + b"\n".join(words[x:y]))) for b, x, y in runs]
            to, kinds, bodies = zip(*rows)
            yield from pa.table({"bucket": pa.array(to, pa.int32()), "kind": pa.array(kinds, pa.int32()), "block": [name] * len(rows), "body": pa.array(bodies, pa.binary())}).to_batches()
        tidy()

    def count(group: pa.Table) -> pa.Table:
        bucket, block = group.column("bucket")[0].as_py(), group.column("block").to_pylist()
        if group.column("kind")[0].as_py() == GRAM:
            keys, counts = gathered([grams_unpacked(x.as_buffer()) for x in group.column("body")])
            seen = counts > 0
            found = parts_of(subtrees(keys[seen], counts[seen]))
            store.write(group, f"bucket-{bucket}")
            tidy()
            return pa.concat_tables([rows_of([""], [GRAM], [bucket], [b""]), found])
        sums: dict[bytes, int] = {}
        asks = []
        for x in group.column("body"):
            raw = bytes(unpacked(x.as_buffer()))
            n = int.from_bytes(raw[:8], "little")
            words = raw[8 * (n + 1) :].split(b"\n")
            for w, c in zip(words, np.frombuffer(raw, np.int64, n, 8).tolist()):
                sums[w] = sums.get(w, 0) + c
            asks.append(words)
        tokens = packed(np.array([sum(sums.values()), sum(c > 0 for c in sums.values())], np.int64).tobytes())
        return rows_of([*block, ""], [WORD] * len(block) + [TOTAL], [bucket] * (len(block) + 1), [*(packed(np.array([sums[w] for w in words], np.int64).tobytes()) for words in asks), tokens])

    sent = asked.mapInArrow(ask, SENT).repartition(buckets, "bucket")
    counted = materialise(sent.groupBy("bucket", "kind").applyInArrow(count, COUNTED), "counted")
    nodes = counted.where(F.col("kind") == PART).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow()  # 256 * DECISIONS rows at most
    sums = np.zeros((3, 256 * DECISIONS))
    for row, c in zip(sums, ("zeros", "ones", "below")):
        row[nodes.column("node").to_numpy()] = nodes.column(c).to_numpy()
    given = spark.sparkContext.broadcast(crown_of(*sums.reshape(3, 256, DECISIONS)))
    totals = counted.where(F.col("kind") == TOTAL).select("body").toArrow().column(0)
    totals = np.array([np.frombuffer(unpacked(x.as_buffer()), np.int64) for x in totals], np.int64).reshape(-1, 2).sum(0)
    tokens, distinct = int(totals[0]) + ends, int(totals[1]) + (ends > 0)
    denominator = float(tokens + (distinct + 1))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                asked = store.read(f"bucket-{bucket}")
                asks = [grams_unpacked(x.as_buffer()) for x in asked.column("body")]
                keys, counts = gathered(asks)
                seen = counts > 0
                logs = log10_of(subtrees(keys[seen], counts[seen]), given.value, keys)
                bodies = [packed(columns(logs[np.searchsorted(keys, k)])) for k, _ in asks]
                yield from rows_of(asked.column("block").to_pylist(), [GRAM] * len(bodies), [bucket] * len(bodies), bodies).select(["block", "kind", "bucket", "body"]).to_batches()
            tidy()

    def sum_up(group: pa.Table) -> pa.Table:
        block = store.read(group.column("block")[0].as_py())
        low = lowered(block.column("text"))
        texts = len(low)
        keys, of = ngrams(low.cast(pa.binary()).to_pylist())
        coded = pa.array(keys).dictionary_encode()
        own, place = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        order = np.argsort(own)
        by, runs = dealt(own[order], buckets)
        answers, logs = answers_of(group, GRAM), np.empty(len(own), np.float64)
        logs[order[by]] = np.concatenate([uncolumns(memoryview(answers[b]), len(answers[b]) // 8, np.float64) for b, _, _ in runs])
        scores = np.bincount(of, logs[place], texts)
        del keys, own, place, of, coded, logs
        of, word, words = words_of(low)
        by, runs = by_word(words, buckets)
        answers, counts = answers_of(group, WORD), np.zeros(len(words), np.int64)
        if runs:
            counts[by] = np.concatenate([np.frombuffer(answers[b], np.int64) for b, _, _ in runs])
        value = np.log10((counts + 1) / denominator)
        n_tokens = np.bincount(of, minlength=texts) + 1
        n_known = np.bincount(of, counts[word] > 0, texts).astype(np.int64) + (ends > 0)
        base = np.bincount(of, value[word], texts) + float(np.log10((ends + 1) / denominator))
        size = pc.binary_length(low).to_numpy()
        bits = pa.array(-scores / np.log10(2.0) / np.maximum(size, 1), mask=size == 0)
        tidy()
        columns = [block.column("id"), block.column("training"), *(pa.array(x) for x in (n_tokens, n_known, np.full(texts, tokens), base, scores)), bits]
        return pa.table(columns, names=["id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    reducers = counted.where(F.col("kind") == GRAM).select("bucket").repartition(buckets, "bucket")
    answers = reducers.mapInArrow(answer, "block string, kind int, bucket int, body binary").unionByName(counted.where(F.col("kind") == WORD).select("block", "kind", "bucket", "body"))
    schema = f"id {kind}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return answers.repartition(tasks, "block").groupBy("block").applyInArrow(sum_up, schema).withColumnRenamed("id", id_col)
