"""Embedding functions: text column in, L2-normalised array<float> column out."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import WORD


# Words that a worker counts at a time; a longer text is counted alone.
WORDS_AT_ONCE = 1 << 18


class Embedder(Protocol):
    """Anything with a name and a Column-to-Column embedding."""

    name: str

    def embed(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class HashedWords:
    """Offline default: lower-cased word counts in md5 buckets.

    The JVM cuts a text into words. The worker names the distinct words of an
    Arrow batch by their md5 once each, then counts and normalises with numpy.
    """

    dim: int = 256

    @property
    def name(self) -> str:
        return f"hashed-words-{self.dim}"

    def embed(self, text: Column) -> Column:
        found = F.regexp_extract_all(F.lower(text), F.lit(WORD + "+"), F.lit(0))
        return _unit_counts(self.dim)(found)


def word_parts(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts that have about ``most`` words, one text at least."""
    ends = np.cumsum(lengths)
    parts, start = [], 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        parts.append((start, stop))
        start = stop
    return parts


def _unit_counts(dim: int):
    def unit(texts: pa.Array) -> np.ndarray:
        lengths = np.asarray(texts.value_lengths().fill_null(0), dtype=np.int64)
        rows = np.repeat(np.arange(len(texts)), lengths)
        words = texts.flatten().dictionary_encode()
        bucket = np.array(
            [int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dim for w in words.dictionary.to_pylist()], np.int64
        )
        cells = rows * dim + bucket[np.asarray(words.indices)]
        counts = np.bincount(cells, minlength=len(texts) * dim).reshape(-1, dim)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return (counts / np.maximum(norms, 1e-300)).astype(np.float32)

    @F.arrow_udf("array<float>")
    def unit_counts(texts: pa.Array) -> pa.Array:
        lengths = np.asarray(texts.value_lengths().fill_null(0), dtype=np.int64)
        out = np.empty((len(texts), dim), np.float32)
        for start, stop in word_parts(lengths, WORDS_AT_ONCE):
            out[start:stop] = unit(texts.slice(start, stop - start))
        offsets = np.arange(0, out.size + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, out.ravel())

    return unit_counts


@dataclass(frozen=True)
class SentenceModel:
    """A sentence-transformers model, loaded once per Python worker on first use."""

    name: str = "sentence-transformers/all-MiniLM-L6-v2"
    batch_size: int = 256

    def embed(self, text: Column) -> Column:
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql.types import ArrayType, FloatType

        name = self.name

        def load():
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as problem:
                raise RuntimeError(
                    "this embedding model needs the sentence-transformers package"
                ) from problem
            model = SentenceTransformer(name)
            return lambda texts: model.encode(list(texts), normalize_embeddings=True)

        return predict_batch_udf(
            load, return_type=ArrayType(FloatType()), batch_size=self.batch_size
        )(text)


def embedder_for(name: str) -> Embedder:
    """``hashed-words-<dim>`` or the name of a sentence-transformers model."""
    prefix = "hashed-words-"
    if name.startswith(prefix):
        return HashedWords(int(name.removeprefix(prefix)))
    return SentenceModel(name)
