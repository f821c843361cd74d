"""Settings from a mapping with environment overrides, checked before anything runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

#: Providers that have an adapter.
PROVIDERS = ("mock", "injected")


@dataclass(frozen=True)
class Settings:
    root: str
    corpus: str
    series: str
    seed: int = 42
    max_length: int = 512
    stride: int = 64
    batch_size: int = 8
    provider: str = "mock"
    processing_version: str = "1"

    def __post_init__(self) -> None:
        for name in ("max_length", "batch_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.stride < self.max_length - 2:
            raise ValueError("stride must be below max_length - 2")
        if self.provider not in PROVIDERS:
            raise ValueError(f"no adapter for provider {self.provider!r}")


def read(path: str, environ: Mapping[str, str], prefix: str = "TIDEMARK_") -> Settings:
    """Settings from a YAML file (sections are joined), with the same overrides."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("settings in YAML need the yaml package; pass a mapping to load() instead") from e
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    if not isinstance(raw, dict):
        raise ValueError(f"{path} holds no settings")
    values: dict[str, object] = {}
    for key, value in raw.items():
        values.update(value if isinstance(value, dict) else {key: value})
    return load(values, environ, prefix)


def load(values: Mapping[str, object], environ: Mapping[str, str], prefix: str = "TIDEMARK_") -> Settings:
    """Values by name; ``TIDEMARK_SEED`` and the like replace them."""
    kinds = {f: t for f, t in Settings.__annotations__.items()}
    merged = dict(values)
    for name, kind in kinds.items():
        if (text := environ.get(prefix + name.upper())) is not None:
            merged[name] = int(text) if kind == "int" else text
    unknown = sorted(set(merged) - set(kinds))
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    return Settings(**merged)
