"""Policy parameters; every default is this library's own."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    expire_after_misses: int = 3
    presence_fresh_days: int = 30
    id_reuse_gap_days: int = 365
    similarity_threshold: float = 0.8
    shingle_words: int = 5
    match_window_days: int = 45
    fingerprint_min_confidence: float = 0.6
    circuit_open_after: int = 2
    circuit_cooldown_minutes: int = 30
    backoff_base_seconds: int = 30
    backoff_cap_seconds: int = 3600
    max_attempts: int = 3
    lease_minutes: int = 5
    template_change_share: float = 0.5
    min_score_inbox: int = 20
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    retention_versions: int = 2


POLICY = Policy()
