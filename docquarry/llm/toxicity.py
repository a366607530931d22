"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the bag has a label. A sentence's probability is logistic in the hashed features of
its words; the document's is their noisy-or, 1 - prod(1 - p). The weights are fitted to the document labels by the gradient
of that likelihood, which flows to the sentences in proportion to their share of the blame, so that the fitted model scores
sentences and locates the offending ones.

The fit uses at most `sample` labelled documents, those with the least hashes of their ids: a documented bound, whatever the
size of the corpus. Scoring is one pass over all whole texts with a model of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import resident, slices, small_batches, tidy

WORD, SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[^.!?\n]+")
FEATURE_BITS = 18
PREFIXES = (4, 5)
#: Word weights that a worker remembers.
REMEMBERED = 250_000
SAMPLE = 8000
#: Features of fewer training documents are left out.
LEAST_DOCS = 3
#: Features that a step of the fit handles at once.
AT_ONCE = 1 << 20


def features(word: str) -> list[int]:
    """The hashed features of a lower-case word: the word and its beginnings."""
    import xxhash

    parts = ["=" + word, *[word[:n] for n in PREFIXES if len(word) > n]]
    return [xxhash.xxh3_64_intdigest(p) >> (64 - FEATURE_BITS) for p in parts]


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """(begin, end, distinct lower-case words) of each sentence that has words; a text without words is one empty sentence."""
    found = [(m.start(), m.end(), set(WORD.findall(m[0].lower()))) for m in SENTENCE.finditer(text)]
    return [x for x in found if x[2]] or [(0, len(text), set())]


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features and the bias of a sentence."""

    weights: bytes
    bias: float


class Scorer:
    """Scores texts with a model; remembers the weights of words."""

    class Known(dict):
        def __init__(self, weights: np.ndarray):
            self.weights = weights

        def __missing__(self, word: str) -> float:
            found = self[word] = float(self.weights[features(word)].sum())
            return found

    def __init__(self, model: Model):
        self.known, self.bias = self.Known(np.frombuffer(model.weights, np.float32)), model.bias

    def score(self, text: str) -> float:
        """1 - prod(1 - p) over the sentences of a text."""
        get, find = self.known.__getitem__, WORD.findall
        w = np.array([sum(map(get, set(words))) for x in SENTENCE.findall(text) if (words := find(x.lower()))] or [0.0])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return float(-np.expm1(-np.logaddexp(0, w + self.bias).sum()))

    def of_sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, p) of each sentence, as offsets into the text."""
        return [(b, e, float(-np.expm1(-np.logaddexp(0, sum(map(self.known.__getitem__, words)) + self.bias)))) for b, e, words in sentences(text)]


def scorer_for(model: Model) -> Scorer:
    """The scorer of a model, built once in each worker."""
    return resident("toxicity", model, lambda: Scorer(model))


def fit_bags(bags: list[tuple[list[np.ndarray], int]], **how) -> Model:
    """The model of labelled bags of sentences, each an array of feature numbers."""
    counts, lengths = [len(s) for s, _ in bags], [len(x) for s, _ in bags for x in s]
    return fit_flat(np.array([y for _, y in bags], bool), np.array(counts, np.int64), np.array(lengths, np.int64), np.concatenate([x for s, _ in bags for x in s] or [np.empty(0, np.int32)]), **how)


def fit_flat(labels: np.ndarray, counts: np.ndarray, lengths: np.ndarray, flat: np.ndarray, epochs: int = 100, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """The model of labelled bags by full-batch gradient steps (Adam). counts: sentences of each bag; lengths: features of each sentence; flat: all feature numbers, one after another."""
    sizes = np.bincount(np.repeat(np.arange(len(counts)), counts), lengths, len(counts)).astype(np.int64)
    seen = (np.repeat(np.arange(len(counts)), sizes) << FEATURE_BITS) | flat
    seen.sort()
    seen = seen[np.concatenate(([True], seen[1:] != seen[:-1]))[: len(seen)]] & ((1 << FEATURE_BITS) - 1)
    often = np.bincount(seen, minlength=1 << FEATURE_BITS) >= min(LEAST_DOCS, len(labels))
    del seen
    of_sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    kept, number = often[flat], (np.cumsum(often) - 1).astype(np.int32)
    of_sentence, flat, used = of_sentence[kept], number[flat[kept]], np.flatnonzero(often)
    del kept
    w, bias = np.zeros(len(used)), -4.0
    if labels.any() and not labels.all():
        of_doc = np.repeat(np.arange(len(counts)), counts)
        parts = [slice(k, k + AT_ONCE) for k in range(0, len(flat), AT_ONCE)]  # what a step makes of all features is made of a part of them at a time
        weight = np.where(labels, 0.5 / labels.mean(), 1.0)  # the rarer class counts more
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, epochs + 1):
            z, grad = np.full(len(lengths), bias), decay * w
            for x in parts:
                z += np.bincount(of_sentence[x], w[flat[x]], len(lengths))
            p = np.exp(-np.logaddexp(0, -z))
            stay = np.bincount(of_doc, np.logaddexp(0, z), len(counts))  # -log of prod(1 - p)
            blame = np.where(labels, -np.exp(-stay) / np.maximum(-np.expm1(-stay), 1e-9), 1.0) * weight
            g = p * blame[of_doc] / len(counts)
            for x in parts:
                grad += np.bincount(flat[x], g[of_sentence[x]], len(used))
            grad_b = g.sum()
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b**2
            a, c = rate / (1 - 0.9**step), 1 - 0.99**step
            w -= a * m / (np.sqrt(v / c) + 1e-8)
            bias -= a * mb / (np.sqrt(vb / c) + 1e-8)
    full = np.zeros(1 << FEATURE_BITS, np.float32)
    full[used] = w
    return Model(full.tobytes(), float(bias))


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of the labels (0 or 1; null labels and ids are left out) of at most `sample` documents for whose id `training` holds.

    An id with several labels takes the greatest. Without any label of either kind, the model is its starting point, which calls nothing toxic.
    """
    chosen = labels.where(training & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    bags = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cache(lambda word: np.array(features(word), np.int32))
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column(0).to_pylist():
                out.append([np.concatenate([known(w) for w in words] or [np.empty(0, np.int32)]).tolist() for _, _, words in sentences(text)])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.list_(pa.int32()))), batch.column(1)], ["bag", "label"])

    # at most `sample` rows: the only rows that ever come to the driver
    found = bags.mapInArrow(run, "bag array<array<int>>, label int").toArrow().combine_chunks()
    if not len(found):
        return fit_bags([])
    bag, label = found.column(0).chunk(0), found.column(1).to_numpy()
    sentence = bag.flatten()
    return fit_flat(label.astype(bool), bag.value_lengths().to_numpy().astype(np.int64), sentence.value_lengths().to_numpy().astype(np.int64), sentence.flatten().to_numpy())


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Every row of docs with the probability that its whole text is toxic.

    Null and empty texts count as one empty sentence. Only the text is looked at; a column named like the score is replaced.
    Repeated rows are kept; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_for(given.value)
        for batch in slices(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([scorer.score(x or "") for x in texts], pa.float64())], [*batch.schema.names, score_col])
        tidy()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType(), False)]))


def locate(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sentence (its number among those scored), begin, end (character offsets), text and score of the sentences at or above the threshold."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_for(given.value)
        for batch in slices(batches, "text"):
            rows = [(i, k, b, e, t[b:e], p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, (b, e, p) in enumerate(scorer.of_sentences(t)) if p >= threshold]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "sentence", "begin", "end", "text", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, sentence int, begin long, end long, text string, score double").withColumnRenamed("id", id_col)
