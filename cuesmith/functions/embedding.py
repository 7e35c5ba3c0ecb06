"""Embeddings by feature hashing of words and their character trigrams."""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION = 256
_WORD = re.compile(r"[^\W_]+")


def _bucket(feature: str) -> tuple[int, float]:
    raw = int.from_bytes(blake2b(feature.encode(), digest_size=8).digest(), "big")
    return raw % DIMENSION, 1.0 if raw & 2 else -1.0


@lru_cache(maxsize=1 << 16)
def _places(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Where a word and its trigrams go, and their signs."""
    found = [_bucket(f) for f in (word, *(word[i : i + 3] for i in range(max(1, len(word) - 2))))]
    return np.array([p for p, _ in found]), np.array([s for _, s in found])


def hashed_all(texts: list[str | None]) -> np.ndarray:
    """A unit vector for each text, zeros for one without words: all features of a batch are summed at once."""
    found = [[_places(w) for w in _WORD.findall((t or "").lower())] for t in texts]
    flat = [x for words in found for x in words]
    vectors = np.zeros(len(texts) * DIMENSION)
    if flat:
        sizes = np.array([sum(len(p) for p, _ in words) for words in found])
        rows = np.repeat(np.arange(len(texts)), sizes)
        vectors = np.bincount(rows * DIMENSION + np.concatenate([p for p, _ in flat]), np.concatenate([s for _, s in flat]), len(texts) * DIMENSION)
    vectors = vectors.reshape(len(texts), DIMENSION)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.round(vectors / np.where(lengths > 0, lengths, 1.0), 6) + 0.0


def hashed(text: str | None) -> list[float]:
    """Unit vector of a text, zeros for one without words."""
    return hashed_all([text])[0].tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed(texts: pd.Series) -> pd.Series:
    return pd.Series(list(hashed_all(texts.tolist())), dtype=object)


@F.pandas_udf(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("sign", T.IntegerType())]))
def hash_features(words: pd.Series) -> pd.DataFrame:
    found = [_bucket(w) for w in words]
    return pd.DataFrame({"bucket": [b for b, _ in found], "sign": [int(s) for _, s in found]})
