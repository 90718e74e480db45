"""Parameters of the linkage stages, with the defaults that results depend on."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

#: Weights of the cheap score and the thresholds tried for the rule score.
RULE_THRESHOLDS = (0.70, 0.75, 0.80, 0.84, 0.86, 0.88, 0.90, 0.93, 0.95, 0.98)


@dataclass(frozen=True)
class LinkConfig:
    """Limits and weights; the defaults are fixed values, as results depend on them. Values that make no sense are refused."""

    candidate_k: int = 30
    name_token_df: int = 100
    address_token_df: int = 50
    posting_cap: int = 250
    min_token_length: int = 3
    df_mode: str = "absolute"
    name_df_fraction: float = 0.0
    address_df_fraction: float = 0.0
    posting_cap_fraction: float = 0.0
    posting_cap_max: int = 250
    ranked_name_tokens: int = 0
    tfidf_k: int = 50
    ngrams: tuple[int, int] = (3, 4)
    max_features: int | None = 300_000
    min_df: int = 1
    address_k: int = 20
    pool_cap: int = 15_000
    numeric_max_df: int = 5_000
    prefix_length: int = 3
    prefix_max_df: int = 2_000
    rare_token_max_df: int = 500
    rare_tokens_per_query: int = 3
    fallback_features: int = 3
    fallback_max_df: int = 5_000
    close_tolerance: float = 0.05
    hard_negatives: int = 5
    weight_full: float = 5.0
    weight_core: float = 4.5
    weight_sorted: float = 4.0
    weight_name_token: float = 1.0
    weight_address: float = 3.0
    weight_address_token: float = 0.5
    weight_country: float = 0.5
    weight_tfidf: float = 4.0

    def __post_init__(self) -> None:
        least = {"candidate_k": 1, "name_token_df": 0, "address_token_df": 0, "posting_cap": 1, "posting_cap_max": 1, "min_token_length": 1, "tfidf_k": 1, "min_df": 1, "address_k": 1, "pool_cap": 1, "numeric_max_df": 0, "prefix_length": 1, "prefix_max_df": 0, "rare_token_max_df": 0, "rare_tokens_per_query": 0, "fallback_features": 1, "fallback_max_df": 0, "ranked_name_tokens": 0, "hard_negatives": 0}
        if bad := [k for k, v in least.items() if getattr(self, k) < v]:
            raise ValueError(f"too small: {', '.join(bad)}")
        shares = ("name_df_fraction", "address_df_fraction", "posting_cap_fraction", "close_tolerance")
        if bad := [k for k in shares if not 0 <= getattr(self, k) <= 1]:
            raise ValueError(f"not between 0 and 1: {', '.join(bad)}")
        if self.df_mode not in ("absolute", "relative", "hybrid") or not 1 <= self.ngrams[0] <= min(3, self.ngrams[1]) or (self.max_features is not None and self.max_features < 1):
            raise ValueError("unknown df_mode, or n-grams or max_features out of range")

    def fingerprint(self) -> str:
        """First 12 hex digits of the SHA-256 of the parameters; no paths, so it is the same on every host."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]


def artifact_hash(*parts: object) -> str:
    """First 12 hex digits of the SHA-256 of what an artifact was made from; parts that JSON doesn't know count by their text."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:12]
