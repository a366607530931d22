"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams tells the languages whose codeword has it from the others: its weights are
the logarithms of the ratio of the n-grams' mean shares on either side. What a classifier says of a text is the mean weight of the text's n-grams, drawn towards
nothing for short texts, and brought to log odds by the means and the variance of what it says of the training texts. Decoding adds up each codeword's logistic losses, each bit's loss weighted by how
well its classifier tells the training texts apart, and takes the nearest codeword: single classifiers may err. Where the second codeword is nearly as near, the text is ambiguous.

Two passes over all training texts gather sums only: n-gram shares of each language, then two moments of each classifier. Both are whole numbers, so that no partitioning changes
a model. The driver gets SLOTS numbers a language.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Numbers of bytes of an n-gram, and hash slots of all n-grams, as a power of two.
ORDERS, SLOTS = (2, 3, 4), 15
#: With up to so many languages, the code has every way to part them; with more, columns that a rule chooses.
ALL_WAYS = 6
#: More languages than this are refused: a model's size goes with them.
MOST_LANGUAGES = 512
#: A text's n-grams are shares of this; classifiers' outputs are whole numbers of this fraction.
SHARE, FINE = 1 << 20, 1 << 16
#: Share that is added to both sides of a ratio, and n-grams that draw a short text's output to half.
FLOOR, SHORT = 1e-5, 40
#: Log odds at the means of either side, at most: between the means, as for texts of several languages, odds are then near even.
SURE = 5.0
#: Texts whose best two scores are nearer than this are ambiguous.
NEAR = 0.2
UNKNOWN = "und"

_SPACED = np.full(256, 32, np.uint8)  # anything but letters becomes a blank
_SPACED[97:123] = np.arange(97, 123)
_SPACED[128:] = np.arange(128, 256)
_ODD = {1: 0x9E3779B1, 2: 0x85EBCA6B, 3: 0xC2B2AE35, 4: 0x27D4EB2F, 5: 0x165667B1}


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: every parting into two for up to ALL_WAYS languages, else columns of hash bits, each the best of eight for the least distance of two rows."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= ALL_WAYS:
        return np.array([[1 if (way >> i) & 1 else -1 for way in range(1, 1 << (n - 1))] for i in range(n)], np.int8)
    columns, length, tried = [], 6 * math.ceil(math.log2(n)), 0
    apart = np.zeros((n, n), int)
    while len(columns) < length:
        best = None
        for _ in range(8):
            bits = np.array([hashlib.blake2b(f"{tried},{i}".encode(), digest_size=1).digest()[0] & 1 for i in range(n)], np.int8) * 2 - 1
            tried += 1
            found = apart + (bits[:, None] != bits[None, :])
            least = np.sort(found[np.triu_indices(n, 1)])[: 4 * n]
            if abs(int(bits.sum())) < n and (best is None or tuple(least) > tuple(best[0])):
                best = (least, bits, found)
        if best:
            columns.append(best[1])
            apart = best[2]
    return np.stack(columns, 1)


@dataclass
class Model:
    """Learnt languages, their codewords, each bit's weights of n-gram slots, and its log odds (slope, offset) and reliability."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    slope: np.ndarray = field(default_factory=lambda: np.zeros(0))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0))
    reliability: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all n-grams of texts, order after order, (orders, places); and where each text begins. A text stands between blanks; other texts' bytes are in none of its n-grams."""
    pad = max(ORDERS)
    raw = _SPACED[np.frombuffer(b"".join(b" " + t + b" " * pad for t in texts), np.uint8)]
    ends = np.cumsum([len(t) + 1 + pad for t in texts])
    between = (ends[:, None] - np.arange(1, pad + 1)).ravel()  # the blanks after each text: n-grams reach into them, and none begins there
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    keep[between] = keep[np.concatenate([[0], ends[:-1]])] = True
    own = np.ones(len(raw), bool)
    own[between] = False
    own = own[keep][:-pad]
    begins = np.concatenate([[0], np.cumsum(own)[np.cumsum(keep)[ends[:-1] - pad - 1] - 1]]).astype(np.int64)
    raw = raw[keep].astype(np.uint32)
    many = len(raw) - pad
    slots = np.empty((len(ORDERS), int(own.sum())), np.int32)
    gram = np.zeros(many, np.uint32)
    for n in range(1, pad + 1):
        gram = (gram << np.uint32(8)) | raw[n - 1 : many + n - 1] if n <= 4 else gram * np.uint32(_ODD[n]) + raw[n - 1 : many + n - 1]
        if n in ORDERS:
            mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(_ODD[n])
            mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(_ODD[1])
            slots[ORDERS.index(n)] = (mixed >> np.uint32(32 - SLOTS))[own]
    return slots, begins


def _parts(batches, column: str):
    """(batch, its texts in lower case as bytes, whether each has a letter)."""
    for batch in slices(batches, column, 2 << 20):
        text = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
        yield batch, pc.utf8_lower(text).cast(pa.binary()).to_pylist(), pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)


def _said(model: Model, texts: list[bytes]) -> np.ndarray:
    """What each bit's classifier says of each text: (texts, bits)."""
    slots, begins = _grams(texts)
    n = np.diff(np.concatenate([begins, [slots.shape[1]]])) * len(ORDERS)
    found = np.empty((len(texts), model.code.shape[1]))
    for b, weights in enumerate(model.weights):
        found[:, b] = sum(np.add.reduceat(weights[s], begins, dtype=np.float64) for s in slots)
    return found / (n + SHORT)[:, None]


def _shares(docs: DataFrame) -> DataFrame:
    """(lang, slot, mass): what share of a language's texts each slot has, over rows (text, lang)."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch, texts, letters in _parts(batches, "text"):
            langs = batch.column(1).to_pylist()
            slots, begins = _grams(texts)
            n = np.diff(np.concatenate([begins, [slots.shape[1]]]))
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs])
            share = np.where(letters, SHARE // (n * len(ORDERS)), 0)
            key = np.repeat(of << SLOTS, n)
            weights = np.repeat(share, n)
            for s in slots:
                found = np.bincount(key + s, weights, len(names) << SLOTS).astype(np.int64).reshape(len(names), -1)
                for name, row in zip(names, found):
                    sums[name] = sums[name] + row if name in sums else row
        for name, row in sums.items():
            some = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(row[some])], names=["lang", "slot", "mass"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, slot int, mass long").groupBy("lang", "slot").agg(F.sum("mass").alias("mass"))


def _moments(docs: DataFrame, model: Model) -> DataFrame:
    """(lang, bit, n, s, q): number, sum and sum of squares of what the classifiers say of a language's texts."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch, texts, letters in _parts(batches, "text"):
            said = np.rint(_said(model, texts) * FINE).astype(np.int64)
            for name, row, ok in zip(batch.column(1).to_pylist(), said, letters):
                if ok:
                    one = np.stack([np.ones_like(row), row, row * row])
                    sums[name] = sums[name] + one if name in sums else one
        for name, (n, s, q) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(np.arange(len(n), dtype=np.int32)), *map(pa.array, (n, s, q))], names=["lang", "bit", "n", "s", "q"])

    rows = docs.select("text", "lang").mapInArrow(run, "lang string, bit int, n long, s long, q long")
    return rows.groupBy("lang", "bit").agg(*(F.sum(F.col(c).cast("decimal(38,0)") if c == "q" else F.col(c)).alias(c) for c in "nsq"))


def fit(docs: DataFrame) -> Model:
    """A model learnt from rows (text, lang) by two passes over all of them; nothing else of the rows is read.

    Rows with a null lang or a text without a letter teach nothing; repeated rows count each time. Without any row there is no language, with one language no bit. Raises ValueError
    for more than MOST_LANGUAGES.
    """
    small_batches(docs.sparkSession)
    docs = docs.where("lang is not null")
    if docs.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = _shares(docs).where("mass > 0").toArrow()
    languages = sorted(set(rows["lang"].to_pylist()), key=lambda x: x.encode())
    code = codewords(len(languages))
    model = Model(languages, code, np.zeros((code.shape[1], 1 << SLOTS), np.float32))
    if len(languages) < 2:
        return model
    mass = np.zeros((len(languages), 1 << SLOTS))
    at = {x: i for i, x in enumerate(languages)}
    mass[[at[x] for x in rows["lang"].to_pylist()], rows["slot"].to_numpy()] = rows["mass"].to_numpy()
    mass /= mass.sum(1, keepdims=True)
    for b, column in enumerate(code.T):
        model.weights[b] = np.log((mass[column > 0].mean(0) + FLOOR) / (mass[column < 0].mean(0) + FLOOR))
    n, s, q = (np.zeros(code.shape) for _ in range(3))
    for r in _moments(docs, model).collect():  # languages x bits
        i = at[r["lang"]], r["bit"]
        n[i], s[i], q[i] = r["n"], r["s"] / FINE, float(r["q"]) / FINE**2
    mean = s / np.maximum(n, 1)
    spread = np.maximum((q / np.maximum(n, 1) - mean**2).mean(0), 1e-6)  # within languages, each of equal weight
    high, low = (np.array([mean[side, b].mean() for b, side in enumerate(sides)]) for sides in ((code > 0).T, (code < 0).T))
    model.slope = np.minimum((high - low) / spread, 2 * SURE / np.maximum(high - low, 1e-9))
    model.offset = -model.slope * (high + low) / 2
    # a classifier's weight: how far from chance it is where both sides' outputs are normal
    model.reliability = np.array([math.erf(max(0.0, d) / (2 * math.sqrt(2))) for d in (high - low) / np.sqrt(spread)])
    return model


def decode(model: Model, said: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text, from what the classifiers say: the nearest codeword, its score, the lead over the second, and the bits that differ from it."""
    odds = said * model.slope + model.offset
    loss = np.stack([(model.reliability * np.logaddexp(0, -word * odds)).sum(1) for word in model.code.astype(float)], 1)
    score = np.exp(loss.min(1, keepdims=True) - loss)
    score /= score.sum(1, keepdims=True)
    best = loss.argmin(1)
    top = np.sort(score, 1)[:, ::-1]
    return best, top[:, 0], top[:, 0] - top[:, 1], ((odds > 0) != (model.code[best] > 0)).sum(1)


def identify(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """docs with `lang_pred`, `score` (0 to 1), `lead` (over the second language), `bits_off` (bits that differ from the codeword chosen) and `ambiguous`.

    Null texts and texts without a letter are `und`, with score 0, and not ambiguous; so is everything where no language is learnt. With one language, every text with a letter is of it, with score 1.
    Ties go to the lesser language name. Equal texts have equal results. Nothing but the text is read; other columns stay, but those named above are refused. An empty table stays empty.
    """
    new = {"lang_pred": "string", "score": "double", "lead": "double", "bits_off": "int", "ambiguous": "boolean"}
    if clash := set(new) & set(docs.columns):
        raise ValueError(f"columns with names of the result's own: {', '.join(sorted(clash))}")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a few hundred numbers a language and SLOTS a bit

    def run(batches):
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch, texts, letters in _parts(batches, column):
            best, score, lead, off = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), int)
            if len(model.languages) == 1:
                best, score, lead = np.where(letters, 0, best), letters.astype(float), letters.astype(float)
            elif model.languages:
                found = decode(model, _said(model, texts))
                best, score, lead, off = (np.where(letters, x, y) for x, y in zip(found, (best, score, lead, off)))
            known = letters & (best < len(model.languages))
            columns = [pa.array(names[best], pa.string()), pa.array(score), pa.array(lead), pa.array(off.astype(np.int32)), pa.array(known & (lead < NEAR))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    return docs.mapInArrow(run, docs.withColumns({name: F.lit(None).cast(kind) for name, kind in new.items()}).schema)


def train_and_identify(docs: DataFrame, training: Column) -> DataFrame:
    """docs (text, lang, and others), identified by a model learnt from those of them that `training` names."""
    return identify(docs, fit(docs.where(training).select("text", "lang")))
