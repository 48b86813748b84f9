"""Text into vectors: embedders as plug-ins, with a deterministic one built in."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicarta.functions.text import with_language

_WORD = re.compile("[a-z0-9]+")


class Embedder(Protocol):
    """A model; it is pickled to the workers and called with batches of texts."""

    name: str
    dimension: int
    batch_size: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """A row of ``dimension`` numbers for each text."""


_REGISTRY: dict[tuple[str, str], Callable[..., Embedder]] = {}


def register(provider: str, kind: str, build: Callable[..., Embedder]) -> None:
    """Make an embedder known under a provider and a kind, ``text`` or ``code``."""
    _REGISTRY[provider, kind] = build


def create(provider: str, kind: str = "text", **settings: object) -> Embedder:
    """A registered embedder; ValueError if none is registered."""
    try:
        build = _REGISTRY[provider, kind]
    except KeyError:
        raise ValueError(f"no {kind} embedder of provider {provider!r}") from None
    return build(**settings)


def embed(df: DataFrame, text: Column, embedder: Embedder, language: Column | None = None, to: str = "vector") -> DataFrame:
    """``df`` with unit vectors in ``to``; the model is used once per worker, in its batch size.

    Null texts get a null vector. ``language``: puts a line with the language before code.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list = [None] * len(batch)
            places = [i for i, t in enumerate(batch) if t is not None]
            for at in range(0, len(places), embedder.batch_size):
                some = places[at : at + embedder.batch_size]
                found = np.asarray(embedder.embed([batch.iloc[i] for i in some]), dtype=np.float32)
                found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
                for i, v in zip(some, found):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return df.withColumn(to, run(text if language is None else with_language(text, language)))


class HashEmbedder:
    """Counts of hashed words: deterministic, needs no model, says nothing about meaning.

    Words are the longest runs of ASCII letters and digits in lower case; each counts at the place
    that the first 32 bits of its MD5 give. A text without words gives zeros.
    """

    name, batch_size = "hash", 1024

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension
        self._places: dict[str, int] = {}

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), dtype=np.float64)
        places = self._places
        for row, text in zip(out, texts):
            for word in _WORD.findall(text.lower()):
                at = places.get(word)
                if at is None:
                    if len(places) > 1_000_000:
                        places.clear()
                    at = places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dimension
                row[at] += 1
        return out


register("hash", "text", HashEmbedder)
register("hash", "code", HashEmbedder)
