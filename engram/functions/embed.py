"""Embedding providers: the only Python UDF of the engine, Arrow batches in and out, one model in each worker."""

from __future__ import annotations

import importlib
import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Provider(Protocol):
    dim: int

    def column(self, text: Column) -> Column: ...

    def vector(self, text: str) -> list[float]: ...


WORDS = re.compile(r"\w+")


def hashed(text: str | None, dim: int) -> np.ndarray:
    out = np.zeros(dim, np.float32)
    for w in WORDS.findall((text or "").lower()):
        h = zlib.crc32(w.encode())
        out[h % dim] += 1.0 if h >> 31 else -1.0
    n = np.linalg.norm(out)
    return out / n if n else out


class HashingEmbedder:
    """Deterministic unit vectors of signed word hashes; stands in where no model is installed."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def vector(self, text: str) -> list[float]:
        return hashed(text, self.dim).tolist()

    def column(self, text: Column) -> Column:
        dim = self.dim

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([hashed(t, dim) for t in texts])

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<float>")(text)


class ModelEmbedder:
    """Any function from a list of texts to vectors, made once in a worker by load(). name tells models apart."""

    def __init__(self, load, dim: int = 384, name: str | None = None):
        self.load, self.dim, self._model = load, dim, None
        self.name = name or f"{getattr(load, '__module__', '')}:{getattr(load, '__qualname__', type(load).__name__)}"

    def vector(self, text: str) -> list[float]:
        if self._model is None:
            self._model = self.load()
        return list(self._model([text])[0])

    def column(self, text: Column) -> Column:
        load = self.load

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series([np.asarray(v, np.float32) for v in model(texts.fillna("").tolist())])

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<float>")(text)


def provider_of(embedder: str, dim: int) -> Provider:
    """What a setting names: module:function, which loads a model; nothing: hashed words."""
    if not embedder:
        return HashingEmbedder(dim)
    module, _, function = embedder.partition(":")
    if not function:
        raise ValueError(f"an embedder is named module:function, not {embedder}")
    getattr(importlib.import_module(module), function)  # fails here rather than in a task
    return ModelEmbedder(lambda: getattr(importlib.import_module(module), function)(), dim, embedder)
