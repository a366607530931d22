"""Exact merge-type (BPE) SentencePiece encoding and decoding.

A token sequence is the merge result of a text exactly when each of its tokens is the merge result of its own text and
each two neighbours stay apart when their joint text is merged again. The encoder walks over a text, at each position
tries the vocabulary pieces that start there from the longest (by an Aho-Corasick automaton), keeps a piece that is compatible with the one before it, and steps back where none is. A bit for each position remembers
where no encoding can continue, so each position fails at most once.

No piece holds a space mark after another character (checked when the model is loaded), so merges never cross from one
word into the next: texts are cut before each run of spaces that follows another character, and each distinct word is
encoded once while it stays in the bounded memory of the worker. Runs of two or more spaces hold pieces of equal score, for which the
pairwise test isn't decisive; the words that follow such runs are merged directly.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import resident, slices, small_batches, tidy

MARK = "▁"
#: Words that a worker remembers in each of two generations; when the younger is full, the older is dropped.
REMEMBERED = 150_000
#: Longer words are encoded but not remembered.
LONGEST_REMEMBERED = 64
#: Up to so many characters, merging looks at all scores at each step.
SHORT = 40
NEVER = float("-inf")

codecs.register_error("docquarry-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Codec:
    """Encoder and decoder of a merge-type model, from the bytes of its file."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        kinds = pb.ModelProto.SentencePiece.Type
        norm, self.prefix = proto.normalizer_spec, proto.normalizer_spec.add_dummy_prefix
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with leading space marks are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that keep texts as they are are supported")
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.unknown = 0
        fallback = False
        for i, p in enumerate(proto.pieces):
            out = p.piece.replace(MARK, " ").encode()
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError(f"a piece holds a space mark after another character: {p.piece!r}")
            elif p.type == kinds.BYTE:
                value, fallback = int(p.piece[3:5], 16), True
                self.byte_ids[value], out = i, bytes([value])
            elif p.type == kinds.UNKNOWN:
                self.unknown, out = i, proto.trainer_spec.unk_surface.encode()
            elif p.type == kinds.CONTROL:
                out = b""
            else:
                raise ValueError(f"pieces of type {p.type} are not supported")
            self.bytes_of.append(out)
        self.fallback = fallback
        self.marked = {i for piece, i in self.ids.items() if piece[0] == MARK}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        reachable = {piece for piece in self.ids if len(piece) == 1 or self.merge(piece) == [piece]}
        for piece in reachable:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        #: Neighbouring characters inside some piece; merges never cross between others.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: The next shorter piece that a piece begins with; for none, its first character.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in reachable), p[0]) for p in reachable if len(p) > 1}

    def merge(self, text: str) -> list[str]:
        """Join neighbours, best score first and leftmost among equals, until none can be joined."""
        parts: list[str | None] = list(text)
        if len(parts) <= SHORT:
            return self.merge_short(parts)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        score, heap = self.score, []
        for i in range(len(parts) - 1):
            if (s := score.get(parts[i] + parts[i + 1])) is not None:
                heap.append((-s, i, parts[i], parts[i + 1]))
        heapq.heapify(heap)
        n = len(parts)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            if parts[i] != left or (j := after[i]) >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := score.get(parts[i] + parts[after[i]])) is not None:
                    heapq.heappush(heap, (-s, i, parts[i], parts[after[i]]))
            if (h := before[i]) >= 0 and (s := score.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (-s, h, parts[h], parts[i]))
        return [p for p in parts if p is not None]

    def merge_short(self, parts: list[str]) -> list[str]:
        """The same for a few characters, without a heap."""
        score = self.score
        scores = [score.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NEVER:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score.get(parts[i - 1] + parts[i], NEVER)
            if i < len(scores):
                scores[i] = score.get(parts[i] + parts[i + 1], NEVER)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether two tokens stay apart when their joint text is merged again."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 4 * REMEMBERED:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(left + right) == [left, right]
        return found

    def longest(self, text: str, at: int) -> str:
        """The longest piece that starts at a position; where there is none, the character."""
        for end, piece in self.automaton.iter_long(text, at):
            return piece if end - len(piece) + 1 == at else text[at]
        return text[at]

    def backtrack(self, text: str) -> list[str]:
        """The merge result of a text, by longest matches, pair tests and a bit field of failed positions."""
        n, pairs, shorter = len(text), self.pairs, self.shorter
        alive = bytearray(b"\x01") * (n + 1)
        tokens: list[str] = []
        at, last, piece = 0, "", self.longest(text, 0)
        while True:
            while piece and not (alive[at + len(piece)] and (not last or ((good := pairs.get((last, piece))) is None and self.compatible(last, piece)) or good)):
                piece = shorter.get(piece, "")
            if piece:
                tokens.append(piece)
                at += len(piece)
                if at == n:
                    return tokens
                last, piece = piece, self.longest(text, at)
            else:  # no piece continues from here: take the last one back and try its next shorter one
                alive[at] = 0
                piece = tokens.pop()
                at -= len(piece)
                piece, last = shorter.get(piece, ""), tokens[-1] if tokens else ""

    def word(self, text: str) -> bytes:
        """The ids of a word (its leading spaces as marks), as the bytes of 32-bit integers."""
        found = self.older.get(text)
        if found is None:
            inside = self.inside
            cuts = [0, *[i for i in range(1, len(text)) if text[i - 1 : i + 1] not in inside], len(text)]
            if len(cuts) > 2:
                known, word = self.words.get, self.word
                found = b"".join([known(x) or word(x) for x in map(text.__getitem__, map(slice, cuts, cuts[1:]))])
            else:
                ids = array("i")
                for token in self.merge(text) if MARK * 2 in text else self.backtrack(text):
                    i = self.ids.get(token)
                    if i is not None:
                        ids.append(i)
                    elif self.fallback:
                        ids.extend([self.byte_ids[b] for b in token.encode()])
                    else:
                        ids.append(self.unknown)
                found = ids.tobytes()
        if len(text) <= LONGEST_REMEMBERED:
            if len(self.words) >= REMEMBERED:
                self.words, self.older = {}, self.words
            self.words[text] = found
        return found

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text, as the bytes of 32-bit integers."""
        if not text:
            return b""
        text = text.replace(" ", MARK)
        if self.prefix:
            text = MARK + text
        known, word = self.words.get, self.word
        if MARK * 2 in text or text[-1] == MARK or text[0] != MARK:
            cut = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)
        else:
            cut = [MARK + x for x in text[1:].split(MARK)]
        return b"".join([known(x) or word(x) for x in cut])

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def decode(self, ids) -> str:
        """The text of ids; a byte that is part of no character becomes U+FFFD."""
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        if self.prefix and len(ids) and ids[0] in self.marked:
            out = out[1:]
        return out.decode("utf-8", "docquarry-each-byte")


def codec_for(model: bytes) -> Codec:
    """The codec of a model, built once in each worker."""
    return resident("pieces", model, lambda: Codec(model))


def roundtrip(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Every row of docs with the ids of its whole text and the text that these ids decode to.

    Null texts count as empty: no ids, an empty decoded text. Columns of docs named like the results are replaced. Rows
    are kept as they are, repeated ones too; an empty table gives an empty table. There is no shuffle: one pass over the scan.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(ids_col, decoded_col)
    given = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(given.value)
        for batch in slices(batches, text_col):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            encoded = [codec.encode_bytes(x) for x in texts]
            decoded = [codec.decode(array("i", x).tolist()) for x in encoded]
            offsets = array("i", [0])
            for x in encoded:
                offsets.append(offsets[-1] + len(x) // 4)
            body = b"".join(encoded)
            values = pa.Array.from_buffers(pa.int32(), len(body) // 4, [None, pa.py_buffer(body)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            names = [*batch.schema.names, ids_col, decoded_col]
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(decoded, pa.string())], names)
        tidy()

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Every row of df with the text that its ids decode to; null ids count as none."""
    df = df.drop(decoded_col)
    given = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(given.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([codec.decode(x or []) for x in lists], pa.string())], [*batch.schema.names, decoded_col])

    return df.mapInArrow(run, schema)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of a round trip."""
    return coded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
