"""Embedding texts with a pluggable model, in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """A float32 matrix, one unit-length row a text."""


class HashingEmbedder:
    """A deterministic stand-in without a model: signed hashes of words and word pairs.

    It carries no meaning beyond shared words and serves for tests and plumbing.
    """

    def __init__(self, dim: int = 64):
        if dim < 1:
            raise ValueError("dim must be positive")
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            words = (t or "").lower().split()
            for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1.0 if h & 0x80000000 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


# Fixed value: the model where a corpus names none.
DEFAULT_MODEL = "sentence-transformers/all-MiniLM-L6-v2"


class ModelEmbedder:
    """A sentence model by name, loaded where it is first used: on the driver, and once in
    each Python worker, to which only the name travels. Needs the package sentence_transformers."""

    def __init__(self, model: str = DEFAULT_MODEL, device: str | None = None, batch_size: int = 256):
        self.model_name, self.device, self.batch_size = model, device, batch_size
        self._model = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_model": None}

    @property
    def model(self):
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.model_name, device=self.device)
        return self._model

    @property
    def dim(self) -> int:
        return int(self.model.get_sentence_embedding_dimension())

    def encode(self, texts: list[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros((0, self.dim), np.float32)
        return np.asarray(self.model.encode(list(texts), batch_size=self.batch_size, normalize_embeddings=True, show_progress_bar=False), np.float32)


def embedder_for(model: str | None) -> Embedder:
    """The embedder of a manifest's model name: hashing-D is the stand-in of D dimensions."""
    kind, _, dim = (model or DEFAULT_MODEL).partition("-")
    return HashingEmbedder(int(dim)) if kind == "hashing" and dim.isdigit() else ModelEmbedder(model or DEFAULT_MODEL)


def encode_one(embedder: Embedder, text: str) -> np.ndarray:
    return embedder.encode([text])[0]


def encode(df: DataFrame, text_col: str, embedder: Embedder, out_col: str = "embedding", batch_size: int = 256) -> DataFrame:
    """Adds array<float> embeddings; the model goes to each task once, null texts count as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = ["" if t is None else t for t in s]
            rows = [v for at in range(0, len(texts), batch_size) for v in np.asarray(embedder.encode(texts[at : at + batch_size]), np.float32)]
            yield pd.Series(rows)

    return df.withColumn(out_col, run(F.col(text_col)))


def encode_chunked(embedder: Embedder, texts: list[str], chunk_size: int = 20_000, progress: Callable[[int, int], None] | None = None) -> np.ndarray:
    """Driver-side encoding of a list in chunks; ``progress`` gets (done, total)."""
    out = np.zeros((len(texts), embedder.dim), np.float32)
    for at in range(0, len(texts), chunk_size):
        out[at : at + chunk_size] = embedder.encode(texts[at : at + chunk_size])
        if progress:
            progress(min(at + chunk_size, len(texts)), len(texts))
    return out
