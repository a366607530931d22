"""Near-duplicate detection by one-permutation hashing with optimal densification, banded buckets and star-shaped candidate edges.

Every document becomes the set of its distinct five-word shingles, as 64-bit hashes. Documents with equal sets (by a 128-bit name) form a class, and
only one document of each class goes on. A class is signed by a single pass over its hashes: the upper bits choose a bin,
each bin keeps its least hash, and an empty bin takes over the value of a non-empty one that a fixed random sequence of its own
finds (optimal densification). BANDS bands of ROWS bins each give bucket keys: classes at the least similarity share
no bucket with probability (1 - 0.75^4)^48 < 2e-8.

In a bucket, all others are tied to one centre only, so that candidates grow with the rows of the buckets, not with their
squares. Candidates are confirmed on full sets, which are made again from the texts of candidates alone: the first pass leaves texts in block files, and
only (block, row) places move. So that the star shape loses no link, the classes of buckets that are then in more than
one component are dealt into chunks by the largest such bucket that they or their neighbours are in, apart by whether they are in its component, if one has half of them.
Chunks that share a bucket, but are not of a single component, are compared as wholes: a class is sent once for each chunk that its own is compared with, however
many buckets and pairs they share, and only links come out. Centres with many edges are split, and chunks are bounded by the bytes of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, Store, blocks, drop_tables, materialise, remove, resident, shared_path, shared_root, small_batches, tidy

SHINGLE = 5
BIN_BITS, ROWS, BANDS = 8, 4, 48
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
#: Bytes of text in a block, bytes of the sets of a chunk, about, and edges of a centre that one task gets.
BLOCK, CHUNK_BYTES, EDGES = 4 << 20, 4 << 20, 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of words, remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def word_hashes() -> Words:
    return resident("words", SHINGLE, Words)


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's distinct shingles in ascending order; one for fewer words than a shingle has, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes()(words)
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


@cache
def probes() -> np.ndarray:
    """For each bin, the bins that it looks at in turn when it is empty: fixed random sequences."""
    return np.random.default_rng(20240229).integers(0, 1 << BIN_BITS, (64, 1 << BIN_BITS), dtype=np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified bins of a non-empty ascending set of hashes."""
    n = 1 << BIN_BITS
    at = np.searchsorted(hashes, np.arange(n, dtype=np.uint64) << np.uint64(64 - BIN_BITS))
    ends = np.append(at[1:], len(hashes))
    full = ends > at
    values = hashes[np.minimum(at, len(hashes) - 1)]
    if full.all():
        return values
    empty = np.flatnonzero(~full)
    source = np.arange(n)
    for row in probes():
        found = row[empty]
        good = full[found]
        source[empty[good]] = found[good]
        empty = empty[~good]
        if not len(empty):
            break
    k = 0
    while len(empty):  # few bins are full: go on with probes made by mixing
        found = (mix(empty.astype(np.uint64) + np.uint64(1000003 * (k := k + 1))) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        good = full[found]
        source[empty[good]] = found[good]
        empty = empty[~good]
    return values[source]


def bands(hashes: np.ndarray) -> np.ndarray:
    """The bucket keys of a set: a hash of each band's number and bins."""
    sig = signature(hashes)[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, i])
    return key.view(np.int64)


def name_of(hashes: np.ndarray) -> bytes:
    """A 128-bit name for a set: equal sets have equal names."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def sets_of(docs: DataFrame, store: Store, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the set), name (of the set), place (a number for the row), block and row (where its text is stored) and bands (bucket keys), from one pass over the texts.

    Within a block, later documents of a class leave text and bands out; rows without an id, which are linked with nothing, have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        for block, rows in enumerate(blocks(batches, "text", BLOCK)):
            sizes, names, keys, seen, kept, at = [], [], [], set(), [], []
            for known, text in zip(rows.column(0).is_valid().to_pylist(), rows.column(1).to_pylist()):
                s = shingles(text)
                sizes.append(len(s))
                names.append(name := name_of(s))
                first = known and len(s) > 0 and name not in seen
                keys.append(bands(s) if first else None)
                at.append(len(kept) if first else None)
                if first:
                    seen.add(name)
                    kept.append(text)
            file = store.write_new(pa.table({"text": pa.array(kept, pa.string())}), f"{part}-{block}") if kept else ""
            n = len(sizes)
            places = pa.array(np.arange(place, place + n) + (part << 36))
            place += n
            columns = [rows.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), places, pa.array([file] * n), pa.array(at, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield from pa.table(columns, names=["id", "n", "name", "place", "block", "row", "bands"]).to_batches()
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, name binary, place long, block string, row int, bands array<long>")


def full_sets(wanted: DataFrame, store: Store) -> DataFrame:
    """(class, set): the hashes of the documents at the given (class, block, row) places, as bytes."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.column("row").to_numpy()
        texts = store.read(group.column("block")[0].as_py()).column("text").take(pa.array(rows)).to_pylist()
        return pa.table({"class": group.column("class"), "set": pa.array([shingles(x).tobytes() for x in texts], pa.binary())})

    wanted = wanted.select("class", "block", "row")
    tasks = max(8, -(-wanted.select("block").distinct().count() // 2))
    return wanted.repartition(tasks, "block").groupBy("block").applyInArrow(run, "class long, set binary")


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) with 100 * intersection >= percent * union of full sets. An a with many edges is split: its set goes to a task for each EDGES of them, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    parts = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / EDGES).cast("int").alias("parts"))
    left = sets.withColumnsRenamed({"class": "a", "set": "x"}).join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    split = edges.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    right = sets.withColumnsRenamed({"class": "b", "set": "y"})
    return split.join(right, "b").join(left, ["a", "part"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that is reachable, for every id in edges (a, b), by alternating large and small stars.

    Every round ties each node to the least node around it and cuts the lineage; the number of rounds grows with the logarithm of the longest path."""

    def sided(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def tally(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    shared_root(edges.sparkSession)  # checkpoints go there
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    last = tally(edges)
    while last[0]:
        both = sided(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: for each node, its smaller neighbours and itself are tied to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        small = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = small.checkpoint()
        now = tally(edges)
        if now == last:
            break
        last = now
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.union(members.select("component", "component").distinct())


def star_links(buckets: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The confirmed links (a, b) between the least class of each bucket and the others."""
    centre = buckets.groupBy("bucket").agg(F.min(F.struct("class", "n")).alias("c"))
    star = buckets.join(centre, "bucket").where(f"class <> c.class and 100 * least(n, c.n) >= {percent} * greatest(n, c.n)")
    return materialise(confirm(star.select(F.col("c.class").alias("a"), F.col("class").alias("b")).distinct(), full, percent), "star-links")


def mixed_buckets(buckets: DataFrame, member: DataFrame) -> DataFrame:
    """(bucket, class, n, component, rows) of the buckets whose classes are in more than one component of member; rows: how many a bucket has."""
    named = buckets.join(member.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows")).where("low < high")
    return materialise(named.join(mixed.select("bucket", "rows"), "bucket"), "open")


def compare(group: pa.Table, percent: int) -> pa.Table:
    """The links (a, b) between the classes of two chunks, or of one, that are in different components. Columns: side, class, n, component, set."""
    side, n, component = (group.column(c).to_numpy() for c in ("side", "n", "component"))
    names, raw = group.column("class").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]
    x = np.flatnonzero(side == 0)
    y = np.flatnonzero(side == 1) if (side == 1).any() else x
    y = y[np.argsort(n[y], kind="stable")]  # by size, so that those of a fitting size lie side by side
    vocabulary, flat = np.unique(np.concatenate([raw[i] for i in y.tolist()]), return_inverse=True)
    flat = flat.ravel()
    begin = np.concatenate(([0], np.cumsum(n[y])))
    mark = np.zeros(len(vocabulary), np.int32)
    found = ([], [])
    for i in x.tolist():
        low, high = np.searchsorted(n[y], -(-percent * n[i] // 100)), np.searchsorted(n[y], 100 * n[i] // percent, "right")
        able = component[y[low:high]] != component[i]
        if not able.any():
            continue
        at = np.searchsorted(vocabulary, raw[i])
        at = at[at < len(vocabulary)]
        at = at[vocabulary[at] == raw[i][: len(at)]]
        if not len(at):
            continue
        mark[at] = 1
        both = np.add.reduceat(mark[flat[begin[low] : begin[high]]], begin[low:high] - begin[low])
        mark[at] = 0
        for j in y[low:high][able & (100 * both >= percent * (n[y[low:high]] + n[i] - both))].tolist():
            if y is not x or names[j] != names[i]:
                found[0].append(min(names[i], names[j]))
                found[1].append(max(names[i], names[j]))
    return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})


def chunk_links(named: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The links between classes that share a bucket and are in different components, from the rows of mixed_buckets()."""
    own = named.groupBy("class").agg(F.max(F.struct("rows", "bucket")).alias("own"))
    top = named.join(own, "class").groupBy("bucket").agg(F.max("own").alias("top"))  # the largest bucket that a neighbour is in
    home = named.join(top, "bucket").groupBy("class").agg(F.max("top").alias("home"), F.first("n").alias("n"), F.first("component").alias("component"))
    sizes = home.groupBy("home", "component").agg(F.sum("n").alias("hashes"), F.count(F.lit(1)).alias("members"))
    sizes = sizes.groupBy("home").agg(F.max(F.struct("members", "component")).alias("m"), F.sum("hashes").alias("hashes"), F.sum("members").alias("members"))
    main = sizes.select("home", F.when(2 * F.col("m.members") >= F.col("members"), F.col("m.component")).alias("main"), "hashes")
    part = F.pmod(F.xxhash64("class"), F.ceil(F.col("hashes") * 8 / CHUNK_BYTES))
    home = home.join(main, "home").select("class", "n", "component", F.xxhash64("home.bucket", F.col("component").eqNullSafe(F.col("main")), part).alias("chunk"))
    home = materialise(home, "chunks")
    bounds = home.groupBy("chunk").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    placed = named.select("bucket", "class").join(home.select("class", "chunk"), "class").select("bucket", "chunk").distinct().join(bounds, "chunk")
    differ = "x.chunk <= y.chunk and (x.low <> y.low or x.low <> x.high or y.low <> y.high)"
    pairs = placed.alias("x").join(placed.alias("y"), "bucket").where(differ).select(F.col("x.chunk").alias("x"), F.col("y.chunk").alias("y")).distinct()
    pairs = materialise(pairs, "chunk-pairs")
    rows = home.join(full, "class")
    left = rows.join(pairs, rows["chunk"] == pairs["x"]).withColumn("side", F.lit(0))
    right = rows.join(pairs.where("x <> y"), rows["chunk"] == F.col("y")).withColumn("side", F.lit(1))
    sent = left.unionByName(right).select("x", "y", "side", "class", "n", "component", "set")
    return sent.groupBy("x", "y").applyInArrow(lambda group: compare(group, percent), "a long, b long")


def linked(buckets: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(id, component) of all classes with a confirmed link, from the (bucket, class, n) rows of buckets and the full sets."""
    links = star_links(buckets, full, percent)
    member = components(links)
    named = mixed_buckets(buckets, member)
    if named.isEmpty():
        return member
    more = materialise(chunk_links(named, full, percent), "chunk-links")
    return member if more.isEmpty() else components(links.union(more))


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the least id that links reach, the document's own included) and kept (whether it is that document).

    Two documents are linked if 100 * intersection >= percent * union of their sets of distinct five-word shingles (percent: 75 at least);
    equal non-empty sets always are. Null and empty texts, and texts without words, have an empty set and are linked with nothing, and so
    are documents with a null id, whose component is null and which are kept. Ids are integers. Rows that repeat an id are kept as rows, each with
    the set of its own text. An empty table gives an empty result; other columns are ignored.
    """
    if percent < 75:
        raise ValueError("the bands are laid out for 75 percent and more")
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError("ids that are no integers have no order here")
    spark = docs.sparkSession
    small_batches(spark)
    store = Store(shared_path(spark, "texts"))
    sets = materialise(sets_of(docs, store, id_col, text_col), "sets")
    first = F.min(F.when(F.col("bands").isNotNull(), F.struct("place", "n", "block", "row", "bands"))).alias("first")
    classes = sets.where("n > 0 and id is not null").groupBy("name").agg(first, F.min("id").alias("least")).select("name", "least", "first.*").withColumnRenamed("place", "class")
    classes = materialise(classes, "classes")
    rows = classes.select("class", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("bucket")
    buckets = materialise(rows.join(shared, "bucket").select("bucket", "class", "n"), "buckets")
    wanted = materialise(classes.join(buckets.select("class").distinct(), "class", "left_semi").select("class", "block", "row"), "wanted")
    full = materialise(full_sets(wanted, store), "full-sets")
    member = linked(buckets, full, percent).select(F.col("id").alias("class"), F.col("component").alias("node"))
    remove(spark, store.root)
    least = classes.select("name", "least", "class").join(member, "class", "left").withColumn("node", F.coalesce("node", "class"))
    nodes = least.groupBy("node").agg(F.min("least").alias("component"))
    least = materialise(least.join(nodes, "node").select("name", "component"), "components")
    drop_tables(classes, buckets, full)
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return sets.select("id", "n", "name").join(least, "name", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept")
    )
