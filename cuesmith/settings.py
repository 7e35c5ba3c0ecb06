"""Typed settings from an environment mapping, clamped to their ranges."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    embedding: str = "hashing"
    vector_store: str = "parquet"
    transcript_order: tuple[str, ...] = ("manual", "generated", "asr")
    languages: tuple[str, ...] = ("vi", "en")
    reranker: bool = False
    top_k: int = 4
    groundedness: float = 0.08

    @classmethod
    def read(cls, env: Mapping[str, str]) -> Settings:
        """Unknown names and repeated or unknown transcript kinds are errors; numbers are clamped."""
        kinds = tuple(x.strip() for x in env.get("TRANSCRIPT_ORDER", ",".join(cls.transcript_order)).split(",") if x.strip())
        if len(set(kinds)) != len(kinds) or not set(kinds) <= {"manual", "generated", "asr"}:
            raise ValueError(f"bad transcript order: {kinds}")
        embedding = env.get("EMBEDDING", cls.embedding)
        if embedding not in {"hashing", "fake"}:
            raise ValueError(f"unknown embedding: {embedding}")
        return cls(
            embedding=embedding, vector_store=env.get("VECTOR_STORE", cls.vector_store), transcript_order=kinds,
            languages=tuple(x.strip() for x in env.get("LANGUAGES", "vi,en").split(",") if x.strip()),
            reranker=env.get("RERANKER", "").lower() in {"1", "true", "yes"}, top_k=min(20, max(1, int(env.get("TOP_K", cls.top_k)))), groundedness=max(0.0, float(env.get("GROUNDEDNESS", cls.groundedness))),
        )


@dataclass(frozen=True)
class ChunkerConfig:
    """Sizes of child and parent chunks in words and seconds; checked when made."""

    child_target_tokens: int = 320
    child_max_tokens: int = 420
    child_overlap_tokens: int = 48
    child_max_duration_seconds: int = 75
    parent_target_tokens: int = 1000
    parent_max_tokens: int = 1400
    parent_max_duration_seconds: int = 300
    timing_gap_boundary_seconds: float = 2.5
    semantic: bool = False

    def __post_init__(self) -> None:
        if self.semantic:
            raise ValueError("semantic boundaries are not supported")
        if not 0 < self.child_target_tokens <= self.child_max_tokens or not 0 < self.parent_target_tokens <= self.parent_max_tokens:
            raise ValueError("targets must be positive and within the limits")
        if not 0 <= self.child_overlap_tokens < self.child_target_tokens:
            raise ValueError("the overlap must be smaller than the target")
        if min(self.child_max_duration_seconds, self.parent_max_duration_seconds, self.timing_gap_boundary_seconds) <= 0:
            raise ValueError("durations must be positive")
