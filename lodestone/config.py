"""Settings, validated on construction, and dotted overrides such as ``data.num_products=10``."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any


def _check(name: str, value: float, low: float | None = None, high: float | None = None, strict: bool = False) -> None:
    if low is not None and (value <= low if strict else value < low):
        raise ValueError(f"{name}={value} must be {'over' if strict else 'at least'} {low}")
    if high is not None and value > high:
        raise ValueError(f"{name}={value} must be at most {high}")


@dataclass(frozen=True)
class VectorStoreConfig:
    max_vectors: int = 10_000_000
    max_k: int = 1_000
    hashes: int = 8  # of the approximate index

    def __post_init__(self) -> None:
        for f in fields(self):
            _check(f.name, getattr(self, f.name), 0, strict=True)


@dataclass(frozen=True)
class DataConfig:
    num_products: int = 1000
    queries_per: int = 5
    external_max_rows: int = 50_000
    hard_negative_ratio: float = 0.10
    attribute_noise_ratio: float = 0.05
    synonym_injection_ratio: float = 0.30
    retrieval_k: int = 100
    rrf_k: int = 60
    semantic_weight: float = 0.5
    bm25_weight: float = 0.5
    max_hard_negatives: int = 10
    hard_negative_score: float = 0.7
    seed: int = 42

    def __post_init__(self) -> None:
        _check("num_products", self.num_products, 0)
        for name in ("queries_per", "external_max_rows", "retrieval_k", "rrf_k", "max_hard_negatives"):
            _check(name, getattr(self, name), 0, strict=True)
        for name in ("hard_negative_ratio", "attribute_noise_ratio", "synonym_injection_ratio", "semantic_weight", "bm25_weight", "hard_negative_score"):
            _check(name, getattr(self, name), 0, 1)


@dataclass(frozen=True)
class RankerConfig:
    max_depth: int = 5  # 31 leaves
    learning_rate: float = 0.05
    rounds: int = 300
    test_size: float = 0.2
    min_rows_in_leaf: int = 20
    early_stopping_rounds: int = 50
    neg_downsample_ratio: float = 3.0
    brand_demote_threshold: float = 0.9
    brand_demote_factor: float = 0.1
    bm25_norm_factor: float = 10.0
    l2: float = 1.0
    feature_fraction: float = 0.8
    bagging_fraction: float = 0.8
    neg_bagging_fraction: float = 0.3
    bagging_freq: int = 1  # 0: no bagging

    def __post_init__(self) -> None:
        for name in ("max_depth", "rounds", "min_rows_in_leaf", "early_stopping_rounds", "neg_downsample_ratio", "bm25_norm_factor", "learning_rate", "test_size", "feature_fraction", "bagging_fraction", "neg_bagging_fraction"):
            _check(name, getattr(self, name), 0, strict=True)
        _check("bagging_freq", self.bagging_freq, 0)
        for name in ("feature_fraction", "bagging_fraction", "neg_bagging_fraction", "learning_rate", "test_size", "brand_demote_threshold", "brand_demote_factor"):
            _check(name, getattr(self, name), 0, 1)


@dataclass(frozen=True)
class EngineConfig:
    data: DataConfig = field(default_factory=DataConfig)
    ranker: RankerConfig = field(default_factory=RankerConfig)
    vectors: VectorStoreConfig = field(default_factory=VectorStoreConfig)


def with_overrides(config: EngineConfig, overrides: list[str]) -> EngineConfig:
    """config with ``section.name=value`` settings; values take the type of the default."""
    for item in overrides:
        key, _, raw = item.partition("=")
        section, _, name = key.partition(".")
        part: Any = getattr(config, section)
        kind = type(getattr(part, name))
        value = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        config = replace(config, **{section: replace(part, **{name: value})})
    return config
