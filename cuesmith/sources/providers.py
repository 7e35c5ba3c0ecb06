"""Interfaces to models and transcript sources, with deterministic stand-ins, and the chain that tries sources in turn."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import sha256
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.embedding import embed
from ..functions.text import overlap_ratio, tokens


class EmbeddingProvider(Protocol):
    identity: str

    def column(self, text: str):  # noqa: ANN201
        """A column of vectors of the text column."""


class HashingEmbedding:
    identity = "hashing-256"

    def column(self, text: str):  # noqa: ANN201
        return embed(text)


class FakeEmbedding:
    """Vectors that depend on the text's hash only."""

    def __init__(self, dimension: int = 32) -> None:
        self.dimension, self.identity = dimension, f"fake-{dimension}"

    def column(self, text: str):  # noqa: ANN201
        n = self.dimension

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield texts.map(lambda t: [(sha256(f"{i}\n{t or ''}".encode()).digest()[0] - 127.5) / 128 for i in range(n)])

        return make(text)


class Reranker(Protocol):
    def scores(self, pairs: DataFrame) -> DataFrame:
        """Adds ``rerank_score`` to rows with ``question`` and ``text``."""


class OverlapReranker:
    """Stand-in for a cross-encoder: the share of the question's words in the text."""

    def scores(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rerank_score", F.round(overlap_ratio(tokens(F.col("question")), tokens(F.col("text"))), 6))


class LlmProvider(Protocol):
    name: str

    def generate(self, prompt: str) -> str: ...


@dataclass
class FakeLlm:
    """Gives its replies in turn; an exception among them is raised."""

    replies: list
    name: str = "fake"

    def generate(self, prompt: str) -> str:
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply


def generated(provider: LlmProvider | None, prompt: str, fallback: Callable[[], str], usable: Callable[[str], bool]) -> tuple[str, str, str | None]:
    """Text, how it came about, and why the model was not used if it was not."""
    if provider is None:
        return fallback(), "extractive", "no provider"
    try:
        text = provider.generate(prompt)
    except Exception as e:  # noqa: BLE001
        return fallback(), "extractive", str(e)[:300]
    return (text, provider.name, None) if usable(text) else (fallback(), "extractive", "unusable reply")


class SourceError(Exception):
    def __init__(self, code: str, retryable: bool = False, terminal: bool = False) -> None:
        super().__init__(code)
        self.code, self.retryable, self.terminal = code, retryable, terminal


class TranscriptSource(Protocol):
    name: str

    def fetch(self, video: str, languages: Sequence[str]) -> list[tuple[str, int, int]]: ...


@dataclass
class Acquired:
    cues: list[tuple[str, int, int]]
    source: str
    attempts: list[dict] = field(default_factory=list)


def acquire(sources: Sequence[TranscriptSource], video: str, languages: Sequence[str], tries: int = 2, sleep: Callable[[float], None] = time.sleep, base: float = 0.5) -> Acquired:
    """Cues of the first source that has them.

    A source is tried again only after a retryable error, ``tries`` times at most; a terminal error ends the chain, an
    unexpected one counts as a retryable failed download. The error raised in the end is the last retryable one, else the
    last one to parse, else the last.
    """
    attempts: list[dict] = []
    errors: list[SourceError] = []
    for source in sources:
        for n in range(1, tries + 1):
            number = len(attempts) + 1
            try:
                cues = source.fetch(video, languages)
                attempts.append({"attempt_number": number, "source": source.name, "outcome": "succeeded", "error_code": None})
                return Acquired(cues, source.name, attempts)
            except SourceError as e:
                error = e
            except Exception:  # noqa: BLE001
                error = SourceError("DOWNLOAD_FAILED", retryable=True)
            errors.append(error)
            attempts.append({"attempt_number": number, "source": source.name, "outcome": "failed", "error_code": error.code})
            if error.terminal:
                raise error
            if not error.retryable:
                break
            if n < tries:
                sleep(base * 2 ** (n - 1))
    kept = [e for e in errors if e.retryable] or [e for e in errors if e.code == "PARSE_FAILED"] or errors
    raise kept[-1] if kept else SourceError("NOT_FOUND")
