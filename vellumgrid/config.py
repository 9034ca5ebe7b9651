"""Settings of the engine, with their checks."""

from __future__ import annotations

from dataclasses import dataclass


class EngineError(Exception):
    """Base of the engine's errors."""


class ConfigurationError(EngineError):
    pass


class ParsingError(EngineError):
    pass


class StorageError(EngineError):
    pass


class RetrievalError(EngineError):
    pass


class GenerationError(EngineError):
    pass


@dataclass(frozen=True)
class Settings:
    """Sizes are tokens; scores lie between 0 and 1."""

    parent_size: int = 2048
    child_size: int = 512
    overlap: int = 50
    vector_top_k: int = 100
    bm25_top_k: int = 100
    top_k: int = 10
    similarity_threshold: float = 0.7
    rerank_top_k: int = 5
    rrf_k: int = 60
    vector_weight: float = 0.6
    graph_weight: float = 0.4
    max_depth: int = 3
    max_context_tokens: int = 4096
    faithfulness_threshold: float = 0.8
    entity_threshold: float = 0.85
    k1: float = 1.5
    b: float = 0.75
    idf: str = "plus1"

    def __post_init__(self) -> None:
        if not 0 < self.child_size <= self.parent_size:
            raise ConfigurationError("child_size must lie between 1 and parent_size")
        if not 0 <= self.overlap < self.child_size:
            raise ConfigurationError("overlap must be less than child_size")
        if abs(self.vector_weight + self.graph_weight - 1) > 0.001:
            raise ConfigurationError("vector_weight and graph_weight must sum to 1")
        if not 1 <= self.max_depth <= 5:
            raise ConfigurationError("max_depth must lie between 1 and 5")
        if not 1 <= self.top_k <= 100:
            raise ConfigurationError("top_k must lie between 1 and 100")
        for name in ("similarity_threshold", "faithfulness_threshold", "entity_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ConfigurationError(f"{name} must lie between 0 and 1")
        if self.idf not in ("okapi", "okapi_floor", "plus1"):
            raise ConfigurationError("idf must be okapi, okapi_floor or plus1")
