"""Frozen settings. Only their values reach a plan, as literals."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class ChunkConfig:
    target_tokens: int = 400
    overlap: int = 60
    min_tokens: int = 80


@dataclass(frozen=True)
class RerankConfig:
    enabled: bool = False
    top_n: int = 10


@dataclass(frozen=True)
class HybridConfig:
    enabled: bool = False
    rrf_k: int = 60
    dense_weight: float = 1.0
    lexical_weight: float = 1.0


@dataclass(frozen=True)
class RewriteConfig:
    enabled: bool = False
    trigger_max_tokens: int = 5


@dataclass(frozen=True)
class RetrieveConfig:
    k: int = 20
    n_context: int = 5
    tau: float = 0.45
    rerank: RerankConfig = field(default_factory=RerankConfig)
    hybrid: HybridConfig = field(default_factory=HybridConfig)
    rewrite: RewriteConfig = field(default_factory=RewriteConfig)


@dataclass(frozen=True)
class GenerateConfig:
    max_new_tokens: int = 512
    temperature: float = 0.2
    max_prompt_tokens: int = 6000
    language_reminder: bool = True


@dataclass(frozen=True)
class ModelSpec:
    name: str
    device: str = "CPU"
    precision: str = "fp32"


@dataclass(frozen=True)
class ModelsConfig:
    embedder: ModelSpec = field(default_factory=lambda: ModelSpec("hashing"))
    generator: ModelSpec = field(default_factory=lambda: ModelSpec("extractive"))
    reranker: ModelSpec | None = None


@dataclass(frozen=True)
class Config:
    models: ModelsConfig = field(default_factory=ModelsConfig)
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    retrieve: RetrieveConfig = field(default_factory=RetrieveConfig)
    generate: GenerateConfig = field(default_factory=GenerateConfig)

    def __post_init__(self) -> None:
        if self.retrieve.n_context > self.retrieve.k:
            raise ConfigError("n_context must not exceed k")
        if self.chunk.overlap >= self.chunk.target_tokens:
            raise ConfigError("overlap must be below target_tokens")
        if self.retrieve.rerank.enabled and self.models.reranker is None:
            raise ConfigError("rerank needs a reranker")

    @property
    def config_hash(self) -> str:
        return hash_object(asdict(self))

    @property
    def chunk_config_hash(self) -> str:
        """Apart from config_hash, so that other settings do not invalidate chunks."""
        return hash_object(asdict(self.chunk))

    def with_arms(self, arms: set[str]) -> Config:
        """The same settings with exactly the named retrieval arms on."""
        if unknown := arms - {"rerank", "hybrid", "rewrite"}:
            raise ConfigError(f"unknown arms: {sorted(unknown)}")
        data = asdict(self)
        for name in ("rerank", "hybrid", "rewrite"):
            data["retrieve"][name]["enabled"] = name in arms
        return from_dict(data)


def hash_object(value: Any) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


_NESTED = {"models": ModelsConfig, "chunk": ChunkConfig, "retrieve": RetrieveConfig, "generate": GenerateConfig, "rerank": RerankConfig, "hybrid": HybridConfig, "rewrite": RewriteConfig, "embedder": ModelSpec, "generator": ModelSpec, "reranker": ModelSpec}


def from_dict(data: dict, kind: type = Config) -> Any:
    """Strict: unknown keys are an error."""
    known = {f.name for f in fields(kind)}
    if unknown := set(data) - known:
        raise ConfigError(f"unknown keys in {kind.__name__}: {sorted(unknown)}")
    out = {}
    for key, value in data.items():
        nested = _NESTED.get(key)
        out[key] = from_dict(value, nested) if nested and isinstance(value, dict) and is_dataclass(nested) else value
    return kind(**out)


def load_config(path: str) -> Config:
    """JSON always; YAML where a parser is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return from_dict(yaml.safe_load(text) or {})
    return from_dict(json.loads(text))
