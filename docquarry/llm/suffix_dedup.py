"""Removal of passages that also stand in an earlier document, and their groups, by common-prefix interval trees over anchored suffixes.

A string of LENGTH bytes that two documents share has the same least 32-byte gram (by hash) at the same place in both: its anchor. So it is
enough to look at the suffixes that begin at anchors, about one position in ten, together with the bytes before them.

1. Texts are packed into blocks of some megabytes where they are read, each a file in the shared folder. Each block sends the hashes of its
   anchors' grams, four bytes each, to a reducer by hash, and learns which grams other blocks have, too. Texts aren't shuffled.
2. Each block sends the distinct contexts (18 bytes before, the gram, 18 after) of these anchors, with the least document that has each, to a
   reducer by gram. It builds an enhanced suffix array (sorted suffixes, longest common prefixes) and scans it with a stack, which gives the
   common-prefix interval tree. Within an interval, sorted left extensions tell occurrences apart; occurrences that share a string of LENGTH bytes
   are followed to the node and the left extension up to which all of them agree: there they branch on both sides, so the string is a maximal repeat.
   All that is compared are bytes; hashes only choose reducers. Between the documents of a block the same is done in the block itself.
3. Each block turns the repeats of its contexts into all occurrences of each, and removes those that an earlier document has.

What is sent about a passage depends on the number of blocks that have it, not of documents, so that large groups of copies cost little. The grams of
HOT blocks or more, whose contexts might be too many for a reducer, are sent as their strings of LENGTH bytes instead, by the hash of each.
Strings are seen up to WIDTH bytes: a longer repeat is a chain of overlapping groups, one for each anchor in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, blocks, drop_tables, materialise, packed, shared_path, small_batches, tidy, unpacked

LENGTH, GRAM = 50, 32
SIDE = LENGTH - GRAM  # bytes before and after a gram that windows with it can reach
WIDTH = SIDE + LENGTH
#: Bytes of text in a block, for each reducer, and of positions that are hashed at once.
BLOCK, PARTITION, PIECE = 4 << 20, 16 << 20, 1 << 16
#: Blocks that have a gram from which its contexts go by their windows.
HOT = 4096
#: Stands between documents; no UTF-8 text has it.
GAP = b"\xfe" * LENGTH
BASE = np.uint64(0x9E3779B97F4A7C15)
POSITION = np.uint64((1 << 24) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit integers, one to one; x is used up."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def grams(body: np.ndarray) -> np.ndarray:
    """The hash of the gram at each position that has one."""
    h, power, n = body.astype(np.uint64), int(BASE), 1
    h += np.uint64(1)
    while n < GRAM:
        longer = h[:-n] * np.uint64(power)
        longer += h[n:]
        h, power, n = longer, power * power % (1 << 64), 2 * n
    return mix(h)


def ascending(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of x in order."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


class Texts:
    """Texts of a block, one after the other with gaps between, and the anchors of all their windows, or those that are given as (at, first, last)."""

    def __init__(self, texts: list[bytes], anchors: tuple[np.ndarray, ...] | None = None):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.lengths + len(GAP)) - self.lengths
        self.body = np.frombuffer(GAP + b"".join([t + GAP for t in texts]), np.uint8)
        if anchors is None:
            self.at, self.hashes, self.first, self.last = self.anchors()
        else:
            self.at, self.first, self.last = anchors
        self.doc = np.searchsorted(self.begins, self.at, "right") - 1

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Places and hashes of the anchors' grams, and the first and the last window that each is the anchor of."""
        has = self.lengths >= LENGTH
        steps = np.zeros(len(self.body) + 1, np.int8)
        steps[self.begins[has]] += 1
        steps[self.begins[has] + self.lengths[has] - LENGTH + 1] -= 1
        valid = np.cumsum(steps, dtype=np.int8).astype(bool)
        parts = [(np.empty(0, np.int64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)]
        for low in range(0, len(self.body), PIECE):
            inside = np.flatnonzero(valid[low : low + PIECE])
            if not len(inside):
                continue
            h = grams(self.body[low : low + PIECE + LENGTH - 1])
            least = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
            for n in (1, 2, 4, 8):
                least = np.minimum(least[:-n], least[n:])
            least = np.minimum(least[: -(SIDE + 1 - 16)], least[SIDE + 1 - 16 :])
            found = (least[inside] & POSITION).astype(np.int64)
            run = np.flatnonzero(np.diff(found, prepend=-1))
            parts.append((found[run] + low, h[found[run]], inside[run] + low, inside[np.append(run[1:], len(found)) - 1] + low))
        at, hashes, first, last = (np.concatenate(x) for x in zip(*parts))
        new = np.diff(at, prepend=-1) > 0  # a window's anchor can lie in the next piece, too
        if not new.all():
            by = np.lexsort((first, at))
            new = np.flatnonzero(np.diff(at[by], prepend=-1))
            at, hashes, first, last = at[by][new], hashes[by][new], first[by][new], np.maximum.reduceat(last[by], new)
        return at, hashes, first, last

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """The bytes around anchors, a row each."""
        return self.body[(self.at[which] - SIDE)[:, None] + np.arange(WIDTH)]


def sortable(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings that numpy sorts and compares whole: it drops zeros at an end, so every byte is raised by one (0xFF is in no text)."""
    raised = np.ascontiguousarray(rows + np.uint8(1))
    return raised.view(f"S{rows.shape[1]}").ravel()


class Sorted:
    """Rows of bytes in order, the longest common prefix of each with the one before, and the least of these in any range."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(sortable(rows), kind="stable")
        same = rows[self.order[1:]] == rows[self.order[:-1]]
        prefix = np.zeros(len(rows), np.uint8)
        prefix[1:] = np.where(same.all(1), rows.shape[1], same.argmin(1)) if len(rows) > 1 else 0
        self.prefix, self.levels = prefix, [prefix]

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """What the rows from place low to place high (greater) in the order have in common."""
        while 1 << len(self.levels) < len(self.prefix):
            last, n = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-n], last[n:]))
        size = high - low
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(low), np.uint8)
        for k in np.flatnonzero(np.bincount(level)).tolist():
            of = level == k
            out[of] = np.minimum(self.levels[k][low[of] + 1], self.levels[k][high[of] + 1 - (1 << k)])
        return out


def interval_tree(prefix: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, parent, leaf) of the intervals of the sorted suffixes with a common prefix of `least` or more, by a stack scan; node 0 is the root, of depth 0.

    leaf: the deepest node that each suffix is in."""
    depth, parent, leaf, stack, before = [0], [0], [], [0], 0
    for common in [*np.where(prefix < least, 0, prefix)[1:].tolist(), 0]:
        top = stack[-1]
        if common > before:  # an interval begins with the suffix before
            depth.append(common)
            parent.append(top)
            top = len(depth) - 1
            stack.append(top)
            leaf.append(top)
        else:
            leaf.append(top)
            while depth[top] > common:
                closed = stack.pop()
                top = stack[-1]
                if depth[top] < common:  # the closed interval is the first child of one that goes on
                    depth.append(common)
                    parent.append(top)
                    top = len(depth) - 1
                    stack.append(top)
                    parent[closed] = top
        before = common
    return np.array(depth, np.int64), np.array(parent, np.int64), np.array(leaf, np.int64)


class Repeats(NamedTuple):
    """Which row stands in which repeat: from `left` bytes before the gram's begin to `right` bytes after it; later: whether a lesser owner has it, too."""

    row: np.ndarray
    left: np.ndarray
    right: np.ndarray
    later: np.ndarray


def maximal_repeats(contexts: np.ndarray, owner: np.ndarray, every: bool) -> Repeats:
    """The maximal repeats of LENGTH bytes or more that contexts of two or more owners share: all of them, or else those with as many occurrences as one of their
    windows of LENGTH bytes, which cover whatever the others cover."""
    empty = Repeats(*(np.empty(0, k) for k in (np.int64, np.int64, np.int64, bool)))
    if len(contexts) < 2:
        return empty
    right = Sorted(np.ascontiguousarray(contexts[:, SIDE:]))
    depth, parent, leaf = interval_tree(right.prefix, GRAM)
    order, node, found = right.order, leaf, []
    left = Sorted(np.ascontiguousarray(contexts[order, SIDE - 1 :: -1]))  # the bytes before the gram, the nearest first
    rank = np.empty(len(order), np.int64)
    rank[left.order] = np.arange(len(order))
    owner = owner[order]
    for r in range(SIDE, -1, -1):  # strings that reach r bytes beyond the gram, and so SIDE - r before it at least
        node = np.where(depth[parent[node]] >= GRAM + r, parent[node], node)  # the largest interval with enough in common
        inside = np.flatnonzero(depth[leaf] >= GRAM + r)
        for back in range(SIDE - r, SIDE + 1 if every else SIDE - r + 1):
            extension = np.cumsum(left.prefix < back)  # equal where the left extensions of so many bytes are
            key = node[inside] * np.int64(len(order) + 1) + extension[rank[inside]]
            by = np.argsort(key, kind="stable")
            at, key = inside[by], key[by]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
            if not len(first):
                continue
            size = np.diff(np.append(first, len(key)))
            least, most = np.minimum.reduceat(owner[at], first), np.maximum.reduceat(owner[at], first)
            shared = least < most
            if not shared.any():
                continue
            low, high = np.minimum.reduceat(rank[at], first)[shared], np.maximum.reduceat(rank[at], first)[shared]
            upto, on = left.least(low, high), right.least(at[first[shared]], at[(first + size - 1)[shared]])  # where the extensions to both sides begin to differ
            member, widths = at[np.repeat(shared, size)], size[shared]
            row = (order[member] << 17) | np.repeat((upto.astype(np.int64) << 9) | (on.astype(np.int64) << 1), widths) | (owner[member] > np.repeat(least[shared], widths))
            found.append(row)
    if not found:
        return empty
    key = ascending(np.concatenate(found))
    return Repeats(key >> 17, (key >> 9) & 255, (key >> 1) & 255, (key & 1).astype(bool))


def by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each gram, and below it the four bytes that name the gram there."""
    return (((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def cut(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each run of an ascending array."""
    first = np.flatnonzero(np.diff(buckets, prepend=-1))
    return list(zip(buckets[first].tolist(), first.tolist(), [*first[1:].tolist(), len(buckets)]))


SENT = "bucket int, kind int, block string, body binary"
ANSWERED = "block string, kind int, bucket int, body binary"
CONTEXTS, WINDOWS = 0, 1


def sent(rows: list[tuple[int, int, bytes]], block: str) -> pa.Table:
    """Rows (kind, bucket, body) of a block; a block with nothing to send has one empty row, so that it gets an answer."""
    kinds, to, bodies = zip(*(rows or [(-1, 0, packed(b""))]))
    return pa.table({"bucket": pa.array(to, pa.int32()), "kind": pa.array(kinds, pa.int32()), "block": pa.array([block] * len(to)), "body": pa.array(bodies, pa.binary())})


def answered(group: pa.Table, bodies: list[bytes]) -> pa.Table:
    return pa.table({"block": group.column("block"), "kind": group.column("kind"), "bucket": group.column("bucket"), "body": pa.array([packed(b) for b in bodies], pa.binary())})


def bodies_of(group: pa.Table) -> list[pa.Buffer]:
    return [unpacked(x.as_buffer()) for x in group.column("body")]


def answer_grams(group: pa.Table, hot: int) -> pa.Table:
    """For each block's distinct grams of a bucket, a byte each: 0 if no other block has the gram, 1 if some have, 2 if `hot` blocks or more have."""
    parts = [np.frombuffer(x, np.uint32) for x in bodies_of(group)]
    every = np.sort(np.concatenate(parts))
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.empty(0, np.int64)
    names, counts = every[first], np.diff(np.append(first, len(every)))
    code = np.where(counts >= hot, 2, counts > 1).astype(np.uint8)
    return answered(group, [code[np.searchsorted(names, p)].tobytes() for p in parts])


def answer_contexts(group: pa.Table, every: bool) -> pa.Table:
    """For each block's contexts of a bucket, their repeats; for windows, whether a lesser owner has the window."""
    width = LENGTH if group.column("kind")[0].as_py() == WINDOWS else WIDTH
    raw = bodies_of(group)
    sizes = [len(x) // (width + 8) for x in raw]
    rows = np.concatenate([np.frombuffer(x, np.uint8, n * width).reshape(n, width) for x, n in zip(raw, sizes)])
    owner = np.concatenate([np.frombuffer(x, np.int64, n, n * width) for x, n in zip(raw, sizes)])
    ends = np.cumsum(sizes)
    if width == LENGTH:
        order = Sorted(rows)
        first = np.flatnonzero(order.prefix < LENGTH)
        least = np.repeat(np.minimum.reduceat(owner[order.order], first), np.diff(np.append(first, len(rows)))) if len(rows) else owner
        later = np.empty(len(rows), bool)
        later[order.order] = owner[order.order] > least
        return answered(group, [later[e - n : e].tobytes() for e, n in zip(ends, sizes)])
    found, out = maximal_repeats(rows, owner, every), []
    low = np.searchsorted(found.row, ends - sizes)
    for a, b, e, n in zip(low, np.searchsorted(found.row, ends), ends, sizes):
        out.append((found.row[a:b] - (e - n)).astype(np.uint32).tobytes() + b"".join(x[a:b].astype(np.uint8).tobytes() for x in found[1:]))
    tidy()
    return answered(group, out)


def distinct(rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the distinct rows with the least owner of each, and for each row the number of its distinct one."""
    by = np.argsort(owner, kind="stable")
    _, first, inverse = np.unique(sortable(rows[by]), return_index=True, return_inverse=True)
    number = np.empty(len(by), np.int64)
    number[by] = inverse.ravel()
    return by[first], number


class Found(NamedTuple):
    """Occurrences of repeats in a block: begin and end in its body, the document's place, whether an earlier document has the repeat, and
    whether its anchor is that of a window inside it, and so in every occurrence."""

    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    later: np.ndarray
    sure: np.ndarray


def occurrences(texts: Texts, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, later: np.ndarray) -> Found:
    """Repeats around anchors, cut to their documents; what is then too short isn't one."""
    at, doc = texts.at[anchor], texts.doc[anchor]
    begin = np.maximum(at - left, texts.begins[doc])
    end = np.minimum(at + right, texts.begins[doc] + texts.lengths[doc])
    good = end - begin >= LENGTH
    sure = np.maximum(begin, texts.first[anchor]) <= np.minimum(end - LENGTH, texts.last[anchor])
    return Found(begin[good], end[good], doc[good], later[good], sure[good])


class Reader(NamedTuple):
    """Reads the blocks of a table and what is known of their repeats. order, cells: the places of the ids and texts among the columns."""

    store: Store
    order: int
    cells: int

    def texts(self, table: pa.Table, anchors: tuple[np.ndarray, ...] | None = None) -> tuple[Texts, np.ndarray]:
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in table.column(self.cells).to_pylist()]
        return Texts(raw, anchors), table.column(self.order).to_numpy().astype(np.int64)

    def block(self, group: pa.Table) -> tuple[pa.Table, Texts, np.ndarray, Found]:
        """The rows of a block, its texts, ids, and the occurrences of all repeats, from the answers that it got."""
        name = group.column("block")[0].as_py()
        table, state = self.store.read(name), self.store.read(f"{name}.state")
        state = {k: np.frombuffer(x.as_buffer(), np.int64) for k, x in zip(state.column("name").to_pylist(), state.column("body"))}
        texts, ids = self.texts(table, (state["at"], state["first"], state["last"]))
        answers = {(k, b): x for k, b, x in zip(group.column("kind").to_pylist(), group.column("bucket").to_pylist(), bodies_of(group)) if k >= 0}
        found = [occurrences(texts, state["own"], state["left"], state["right"], state["later"].astype(bool))]
        for kind in (CONTEXTS, WINDOWS):
            out, number, least = state[f"out{kind}"], state[f"number{kind}"], state[f"first{kind}"]
            parts = []
            for b, x, y in cut(state[f"bucket{kind}"]):
                raw = answers[kind, b]
                if kind == WINDOWS:
                    parts.append((np.arange(x, y), *[np.zeros(y - x, np.int64)] * 2, np.frombuffer(raw, np.uint8).astype(bool)))
                else:
                    n = len(raw) // 7
                    parts.append((np.frombuffer(raw, np.uint32, n).astype(np.int64) + x, *(np.frombuffer(raw, np.uint8, n, (4 + k) * n).astype(np.int64) for k in range(3))))
            if not parts:
                continue
            row, left, right, later = (np.concatenate(x) for x in zip(*parts))
            # each repeat of a context, for each anchor that has the context
            by = np.argsort(row, kind="stable")
            low, high = np.searchsorted(row[by], number), np.searchsorted(row[by], number, "right")
            anchor = np.repeat(np.arange(len(number)), high - low)
            pick = by[np.arange(len(anchor)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
            if kind == WINDOWS:
                left, right = SIDE - state["reach"][anchor], GRAM + state["reach"][anchor]
            else:
                left, right = left[pick], right[pick]
            later = later[pick].astype(bool) | (ids[texts.doc[out[anchor]]] > least[number[anchor]])
            found.append(occurrences(texts, out[anchor], left, right, later))
        return table, texts, ids, Found(*(np.concatenate(x) for x in zip(*found)))


def repeats_of(docs: DataFrame, id_col: str, text_col: str, every: bool) -> tuple[Reader, GroupedData]:
    """Passes 1 and 2: the blocks of a table, and the answers that they got, by block."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError("ids that are no integers have no order here")
    spark = docs.sparkSession
    small_batches(spark)
    order, cells = docs.columns.index(id_col), docs.columns.index(text_col)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = int(max(8, -(-total // PARTITION)))
    tasks, hot = int(max(8, -(-total // (2 * BLOCK)))), HOT
    reader = Reader(Store(shared_path(spark, "blocks")), order, cells)
    store, texts_of = reader.store, reader.texts

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, block in enumerate(blocks(batches, text_col, BLOCK)):
            name = f"{part}-{i}"
            names = ascending(by_bucket(texts_of(store.write(block, name))[0].hashes, buckets))
            runs = cut((names >> np.uint64(32)).astype(np.int64))
            names = names.astype(np.uint32)
            yield from sent([(CONTEXTS, b, packed(names[x:y].tobytes())) for b, x, y in runs], name).to_batches()
        tidy()

    placed = docs.where(F.col(id_col).isNotNull())
    shared = placed.mapInArrow(first_pass, SENT).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda group: answer_grams(group, hot), ANSWERED)
    shared = materialise(shared, "grams")

    def second_pass(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        texts, ids = texts_of(store.read(block))
        owner = ids[texts.doc]
        names, place = np.unique(by_bucket(texts.hashes, buckets), return_inverse=True)
        answers = [x for _, x in sorted({b: x for b, x in zip(group.column("bucket").to_pylist(), bodies_of(group))}.items())]
        code = np.concatenate([np.frombuffer(x, np.uint8) for x in answers])[place.ravel()] if len(names) else np.empty(0, np.uint8)
        # between the documents of this block
        by = np.lexsort((owner, place.ravel()))
        p, o = place.ravel()[by], owner[by]
        first = np.flatnonzero(np.diff(p, prepend=-1))
        ends = np.append(first[1:], len(p))
        own = np.sort(by[np.repeat(o[first] != o[ends - 1], ends - first)]) if len(p) else first
        inside = maximal_repeats(texts.contexts(own), owner[own], every)
        state = {"own": own[inside.row], "left": inside.left, "right": inside.right, "later": inside.later.astype(np.int64)}
        # with other blocks
        rows = []
        for kind in (CONTEXTS, WINDOWS):
            out = np.flatnonzero(code == kind + 1)
            body = texts.contexts(out)
            if kind == WINDOWS:  # each of the windows of an anchor that lie in its document
                reach = np.arange(SIDE + 1)
                begin = texts.at[out][:, None] - SIDE + reach
                fits = (begin >= texts.begins[texts.doc[out]][:, None]) & (begin + LENGTH <= (texts.begins + texts.lengths)[texts.doc[out]][:, None])
                which, reach = np.nonzero(fits)
                body = texts.body[begin[fits][:, None] + np.arange(LENGTH)]
                state["reach"], out = reach, out[which]
                powers = np.cumprod(np.full(LENGTH, BASE), dtype=np.uint64)
                to = (mix((body.astype(np.uint64) * powers).sum(1, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64)
            else:
                to = (by_bucket(texts.hashes[out], buckets) >> np.uint64(32)).astype(np.int64)
            chosen, number = distinct(body, owner[out])
            by = np.argsort(to[chosen], kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            chosen = chosen[by]
            state |= {f"out{kind}": out, f"number{kind}": rank[number], f"first{kind}": owner[out][chosen], f"bucket{kind}": to[chosen]}
            rows += [(kind, b, packed(body[chosen[x:y]].tobytes() + owner[out][chosen[x:y]].tobytes())) for b, x, y in cut(to[chosen])]
        used = ascending(np.concatenate([state[k] for k in ("own", "out0", "out1")]))  # of the anchors, only these are kept
        state |= {k: np.searchsorted(used, state[k]) for k in ("own", "out0", "out1")} | {"at": texts.at[used], "first": texts.first[used], "last": texts.last[used]}
        store.write(pa.table({"name": list(state), "body": pa.array([x.astype(np.int64).tobytes() for x in state.values()], pa.large_binary())}), f"{block}.state")
        tidy()
        return sent(rows, block)

    asked = shared.repartition(tasks, "block").groupBy("block").applyInArrow(second_pass, SENT)
    answers = materialise(asked.repartition(buckets, "bucket").groupBy("bucket", "kind").applyInArrow(lambda group: answer_contexts(group, every), ANSWERED), "contexts")
    drop_tables(shared)
    return reader, answers.repartition(tasks, "block").groupBy("block")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """Every row of docs with spans (array of (begin, end) byte offsets of the maximal removed runs) and kept (the other bytes,
    or with as_text the text of the characters that are left whole).

    A byte goes if a LENGTH-byte string that covers it also starts in a document with a lesser id; strings are judged on the input. Ids are integers.
    Null texts count as empty. Rows with equal ids are no earlier than each other; rows with a null id take no part:
    nothing is removed from them, and nothing because of them. Columns of docs named spans or kept are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("spans", "kept")
    reader, by_block = repeats_of(docs, id_col, text_col, every=False)
    result = T.StructType([*docs.schema.fields, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])

    def last_pass(group: pa.Table) -> pa.Table:
        table, texts, _, found = reader.block(group)
        edge = np.zeros(len(texts.body) + 1, np.int32)
        np.add.at(edge, found.begin[found.later], 1)
        np.add.at(edge, found.end[found.later], -1)
        gone = np.cumsum(edge) > 0
        turn = np.flatnonzero(np.diff(gone, prepend=False))
        begins, ends = turn[::2], turn[1::2]
        doc = np.searchsorted(texts.begins, begins, "right") - 1
        low, body = np.searchsorted(doc, np.arange(len(texts.begins) + 1)), texts.body.tobytes()
        spans, kept = [], []
        for i, (s, n) in enumerate(zip(texts.begins.tolist(), texts.lengths.tolist())):
            b, e = begins[low[i] : low[i + 1]].tolist(), ends[low[i] : low[i + 1]].tolist()
            spans.append([{"begin": x - s, "end": y - s} for x, y in zip(b, e)])
            kept.append(b"".join([body[x:y] for x, y in zip([s, *e], [*b, s + n])]))
        tidy()
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return table.append_column("spans", pa.array(spans, kind)).append_column("kept", pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()))

    content = F.coalesce(F.col(text_col), F.lit("")).cast("string" if as_text else "binary")
    none = docs.where(F.col(id_col).isNull()).withColumn("spans", F.array().cast(result["spans"].dataType)).withColumn("kept", content)
    return by_block.applyInArrow(last_pass, result).unionByName(none)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """group, length, id, begin, end: all occurrences (byte offsets) of every maximal repeat that two or more documents share; group is the MD5 of its bytes.

    Maximal: not all occurrences go on alike, neither to the left nor to the right, as far as WIDTH bytes around an anchor show; a repeat of more bytes is a chain
    of overlapping groups with the same documents. Rows as for remove_repeats: null texts count as empty, rows with a null id take no part, repeated rows are one occurrence."""
    reader, by_block = repeats_of(docs.select(id_col, text_col), id_col, text_col, every=True)

    def last_pass(group: pa.Table) -> pa.Table:
        import hashlib

        _, texts, ids, found = reader.block(group)
        place = np.unique(np.stack((found.begin, found.end, found.doc))[:, found.sure], axis=1)
        body = texts.body.tobytes()
        names = [hashlib.md5(body[b:e]).hexdigest() for b, e in zip(*place[:2].tolist())]
        start = texts.begins[place[2]]
        return pa.table({"group": pa.array(names, pa.string()), "length": place[1] - place[0], "id": ids[place[2]], "begin": place[0] - start, "end": place[1] - start})

    found = by_block.applyInArrow(last_pass, "group string, length long, id long, begin long, end long").distinct()
    return found.withColumnRenamed("id", id_col)


def digests(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of documents after removal."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return done.select(
        id_col,
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
