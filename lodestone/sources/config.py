"""Settings from YAML and secrets from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from lodestone.functions.vectors import distance


@dataclass(frozen=True)
class Settings:
    """All tunables, checked."""

    locations: tuple[str, ...] = ()
    lang: str = "en"
    max_docs_per_location: int = 1
    max_chars: int = 1_000_000
    chunk_size: int = 800
    dim: int = 256
    query_prefix: str = ""
    normalize: bool = True
    collection: str = "passages"
    distance: str = "Cosine"
    top_k: int = 10
    allow_any_top_k: bool = False
    backend: str = "local"
    temperature: float = 0.1
    max_tokens: int = 512
    models: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        distance(self.distance)
        if not self.allow_any_top_k and not 1 <= self.top_k <= 15:
            raise ValueError("top_k lies between 1 and 15 unless allow_any_top_k is set")
        if self.chunk_size < 1 or self.dim < 1 or self.max_docs_per_location < 1:
            raise ValueError("sizes and limits are positive")


def load_settings(path: str | Path) -> Settings:
    """Settings from a YAML file with the sections below; what is missing has its default."""
    import yaml

    raw: dict[str, Any] = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    part = lambda name: raw.get(name) or {}
    ingest, vectors, store, generator = part("ingest"), part("embeddings"), part("store"), part("generator")
    given = {
        "locations": tuple(raw.get("locations") or ()),
        "lang": ingest.get("lang"),
        "max_docs_per_location": ingest.get("max_docs_per_location"),
        "chunk_size": ingest.get("chunk_size"),
        "dim": vectors.get("dim"),
        "query_prefix": vectors.get("query_instruction"),
        "normalize": vectors.get("normalize"),
        "collection": store.get("collection"),
        "distance": store.get("distance"),
        "top_k": part("retrieval").get("top_k"),
        "allow_any_top_k": part("retrieval").get("allow_any_top_k"),
        "backend": generator.get("backend"),
        "temperature": generator.get("temperature"),
        "max_tokens": generator.get("max_tokens"),
        "models": {k: v["model"] for k, v in generator.items() if isinstance(v, dict) and "model" in v} or None,
    }
    if ingest.get("chunk_overlap"):
        raise ValueError("chunks never overlap")
    return Settings(**{k: v for k, v in given.items() if v is not None})


def load_dotenv(path: str | Path) -> None:
    """``NAME=value`` lines into the environment, where the name is not set yet."""
    if not Path(path).exists():
        return
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, sep, value = line.strip().partition("=")
        if sep and not name.startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("'\""))


def env(name: str, default: str | None = None) -> str | None:
    return os.getenv(name, default)


def required_env(name: str) -> str:
    value = os.getenv(name)
    if not value:
        raise RuntimeError(f"set {name} in the environment")
    return value
