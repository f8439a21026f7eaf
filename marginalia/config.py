"""Engine parameters in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Sizes count code points; ranks count from 1."""

    child_target: int = 400
    child_max: int = 750
    child_overlap: int = 80
    bm25_k: int = 20
    dense_k: int = 20
    rerank_candidates: int = 40
    final_children: int = 18
    final_parents: int = 4
    rrf_k: int = 60
    rrf_alpha: float = 0.6
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    refusal_threshold: float = 0.1119
    relevance_threshold: float = 0.4
    history_window: int = 6
    history_tokens: int = 4000
    summary_words: int = 500
    broadcast_bytes: int = 64 * 1024 * 1024


DEFAULT = EngineConfig()
