"""Injectable models, with deterministic offline defaults: embedding, answer synthesis, page parsing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 768


class Embedder(Protocol):
    """Vectors for texts; task is "document" or "query"."""

    dimension: int

    def embed(self, texts: list[str], task: str) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed feature hashing of words, scaled to length one: the same vector for the same words, everywhere."""

    dimension: int = DIMENSION

    def embed(self, texts: list[str], task: str = "document") -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[(h >> 1) % self.dimension] += 1.0 if h & 1 else -1.0
            if (length := float(np.linalg.norm(row))) > 0:
                row /= length
        return out.tolist()


def document_vectors(embedder: Embedder, task: str = "document") -> Callable[[Column], Column]:
    """An expression that embeds a text column, an Arrow batch at a time."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(texts.fillna("").tolist(), task))

    return run


class Synthesizer(Protocol):
    """An answer to a prompt; excerpts are the ranked matches that the prompt was made of."""

    def answer(self, prompt: str, excerpts: list[str]) -> str: ...


@dataclass(frozen=True)
class VerbatimSynthesizer:
    """Quotes the excerpts, each with its citation; nothing is paraphrased."""

    longest: int = 400

    def answer(self, prompt: str, excerpts: list[str]) -> str:
        return "\n\n".join(f"[{i}] {x[: self.longest]}" for i, x in enumerate(excerpts, 1))


def plain_pages(content: bytes) -> list[str]:
    """The default page parser: UTF-8 text whose pages end at form feeds. A PDF parser with the same signature can take its place."""
    return content.decode("utf-8").split("\f")
