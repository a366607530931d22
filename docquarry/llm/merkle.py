"""A Merkle manifest of a data set: a digest for each row, a tree over the rows of each group, a tree over the groups, and proofs.

Rows become leaves. In each group the leaves stand in an order without gaps; every ARITY consecutive nodes of a level, of the last ones as many as there are,
become the digest of their digests, until one node is left, the group's root. The groups' roots, in order, become the manifest's root in the same way.

A task takes one aligned block of ARITY ** HEIGHT consecutive leaves. It walks the block's tree recursively in postorder: the walk of a subtree returns
its digest, and while it unwinds, each child's siblings are appended to the leaves that the child contains. Blocks are aligned to the tree, so a
block's root is a node of it, and the roots of all blocks are the leaves of the next walk, which is distributed in the same way. A proof is a leaf's siblings in its block,
then those of its block's root, and so on. Texts are read once and never shuffled; what is shuffled is some 100 bytes a row.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, materialise

#: Nodes that become one, and the height of the subtree that a task walks: blocks of 4,096 leaves.
ARITY, HEIGHT = 8, 4
#: Groups up to this number are broadcast to their rows, each some hundred bytes.
FEW_GROUPS = 50_000


def framed(value: Column) -> Column:
    """A value's own encoding: `-` for null, else the number of its UTF-8 bytes, a colon and the value. No two lists of values have one concatenation."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row's values, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(framed, values)), 256))


def as_text(digest: Column) -> Column:
    """A digest, or several, as lower-case hex text."""
    return F.lower(F.hex(digest))


def joined(digests) -> bytes:
    """The digest of digests: of their hex texts, one after another."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def widths(n: int) -> list[int]:
    """Nodes at each height of a tree over n leaves, down to one."""
    found = [n]
    while found[-1] > 1:
        found.append(-(-found[-1] // ARITY))
    return found


def walk(leaves: list[bytes], first: int, n: int, height: int = HEIGHT) -> tuple[bytes, list[bytes]]:
    """The root of a block, and each leaf's siblings, one after another. The block's leaves are those from `first` on, of n; it is aligned, and whole or the last one."""
    width, end = widths(n), first + len(leaves)
    paths = [bytearray() for _ in leaves]

    def subtree(level: int, index: int) -> bytes:
        if level == 0:
            return leaves[index - first]
        children = range(index * ARITY, min((index + 1) * ARITY, width[level - 1]))
        digests = [subtree(level - 1, c) for c in children]
        span = ARITY ** (level - 1)
        for c in children:
            others = b"".join(d for k, d in zip(children, digests) if k != c)
            for i in range(max(c * span, first), min((c + 1) * span, end)):
                paths[i - first] += others
        return joined(digests)

    top = min(height, len(width) - 1)
    return subtree(top, first // ARITY**top), [bytes(p) for p in paths]


def fold(digest: bytes, siblings: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that a leaf's digest and its siblings lead to; places: the leaf's place and the number of leaves in its own tree, then those of that tree's root in the next."""
    at = 0
    for place, n in places:
        for width in widths(n)[:-1]:
            own, run = place % ARITY, min(ARITY, width - place // ARITY * ARITY)
            others = [siblings[at + 32 * i : at + 32 * i + 32] for i in range(run - 1)]
            digest, at, place = joined([*others[:own], digest, *others[own:]]), at + 32 * (run - 1), place // ARITY
    return digest


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows (with a column `group`) with their place in their group and the group's number of rows: one range shuffle, counts of each partition, no single task."""
    keys = [F.col("group").asc_nulls_first(), *order]
    counted = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = materialise(dealt.withColumns({"part": F.shiftright(counted, 33), "at": counted.bitwiseAND((1 << 33) - 1)}), "merkle-order")
    by_part = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("group", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    starts = starts.withColumns({"before": F.coalesce(F.sum("here").over(by_part), F.lit(0)), "n": F.sum("here").over(Window.partitionBy("group"))})
    starts = starts.select(F.col("group").alias("group_"), F.col("part").alias("part_"), (F.col("before") - F.col("first")).alias("shift"), "n")
    found = dealt.join(starts, (F.col("part") == F.col("part_")) & F.col("group").eqNullSafe(F.col("group_")))
    return found.withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "group_", "part_", "shift")


def _walked(rows: DataFrame) -> DataFrame:
    """Rows (group, place, n, digest, and others) with `siblings` inside their block and the block's root `top`."""
    schema, height = rows.withColumns({"siblings": F.lit(b""), "top": F.lit(b"")}).schema, HEIGHT

    def run(table: pa.Table) -> pa.Table:
        table = table.drop_columns("block").sort_by("place")
        first, n = table["place"][0].as_py(), table["n"][0].as_py()
        top, paths = walk(table["digest"].to_pylist(), first, n, height)
        for name, values in (("siblings", paths), ("top", [top] * len(paths))):
            table = table.append_column(name, pa.array(values, pa.binary()))
        return table

    blocked = rows.withColumn("block", F.floor(F.col("place") / ARITY**height))
    return blocked.groupBy("group", "block").applyInArrow(run, schema)


def tree(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows (group, digest, and others) with `place` and `n` in their group, all their `siblings` from the leaf up, and their group's root `top`.

    order: of the rows of a group; rows that tie in it must be equal in digest, or their order is left open. Groups and digests are none of them changed; an empty table has no trees.
    """
    span, rounds = ARITY**HEIGHT, [materialise(_walked(_placed(rows, order)), "merkle-blocks")]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > span:  # one round for each HEIGHT levels of the tallest tree
        above = rounds[-1].where((F.col("place") % span == 0) & (F.col("n") > span))
        above = above.select("group", (F.col("place") / span).cast("long").alias("place"), F.ceil(F.col("n") / span).cast("long").alias("n"), F.col("top").alias("digest"))
        rounds.append(materialise(_walked(above), "merkle-blocks"))
        most = -(-most // span)

    def onto(upper: DataFrame, lower: DataFrame) -> DataFrame:
        """Blocks' siblings and roots appended to those of the rows in them; a group of one block has its root already."""
        upper = upper.select(F.col("group").alias("group_"), F.col("place").alias("block_"), F.col("siblings").alias("more"), F.col("top").alias("root"))
        found = lower.join(upper, lower["group"].eqNullSafe(F.col("group_")) & (F.floor(lower["place"] / span) == F.col("block_")), "left")
        return found.withColumns({"siblings": F.concat("siblings", F.coalesce("more", F.lit(b""))), "top": F.coalesce("root", "top")}).drop("group_", "block_", "more", "root")

    return reduce(onto, reversed(rounds[:-1]), rounds[-1])


def manifest(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The manifest of rows (group, digest, and others): the rows with `place` and `n` in their group, `group_place` and `groups`, their group's root `subroot`, `root`, and `siblings`
    (32 bytes each, from the leaf up to the root). Groups stand in the order of their UTF-8 bytes, null first; order: of the rows of a group.

    Null groups are one group of their own. Rows that tie in `order` are put in the order of their digests; equal rows each have a leaf. Of other columns, all but the names above
    are kept as they are; those are refused. An empty table has an empty manifest.
    """
    taken = {"place", "n", "group_place", "groups", "subroot", "root", "siblings", "top", "part", "at"} & set(rows.columns)
    if taken:
        raise ValueError(f"columns with names of the manifest's own: {', '.join(sorted(taken))}")
    under = tree(materialise(rows, "merkle-leaves"), [*order, F.col("digest")]).withColumnRenamed("top", "subroot")
    under = materialise(under, "merkle-groups")
    roots = under.where("place = 0").select(F.lit(None).cast("string").alias("group"), F.col("group").alias("name"), F.col("subroot").alias("digest"))
    over = tree(materialise(roots, "merkle-roots"), [F.col("name").asc_nulls_first()])
    over = over.select("name", F.col("place").alias("group_place"), F.col("n").alias("groups"), F.col("siblings").alias("more"), F.col("top").alias("root"))
    over = F.broadcast(over) if roots.count() <= FEW_GROUPS else over
    found = under.join(over, under["group"].eqNullSafe(over["name"])).drop("name")
    return found.withColumn("siblings", F.concat("siblings", "more")).drop("more")


def folded(made: DataFrame, digest: str, name: str) -> DataFrame:
    """The rows of a manifest with the root, as 32 bytes, that a digest in the leaf's place leads to with the leaf's siblings; null digests have none."""
    schema = made.withColumn(name, F.lit(b"")).schema

    def run(batches):
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            known = zip(column(digest), column("siblings"), zip(column("place"), column("n")), zip(column("group_place"), column("groups")))
            roots = [None if d is None else fold(d, s, list(places)) for d, s, *places in known]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, name])

    return made.mapInArrow(run, schema)


def close(made: DataFrame) -> None:
    """Delete the files that a manifest is read from, once nothing reads it any more."""
    drop_tables(made)
