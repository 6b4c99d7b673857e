"""Parameters: defaults, a TOML file, and the environment."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    version: int = 1
    store_path: str = ""
    embedding_basis: str = "title_original"
    token_env: str = "GITHUB_TOKEN"
    api_key_env: str = "OPENAI_API_KEY"
    embed_model: str = "text-embedding-3-small"
    embed_dimensions: int = 1024
    batch_size: int = 64
    default_sort: str = "size"

    def has_token(self, env: Mapping[str, str] = os.environ) -> bool:
        return bool(env.get(self.token_env, "").strip())


def load(path: str | None = None, env: Mapping[str, str] = os.environ) -> Config:
    """Defaults, overlaid by the file (tables are flattened), then by SKEIN_<NAME>."""
    values: dict = {}
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            for k, v in tomllib.load(f).items():
                values |= v if isinstance(v, dict) else {k: v}
    known = {f.name: f for f in fields(Config)}
    values = {k: v for k, v in values.items() if k in known}
    for name in known:
        if own := env.get(f"SKEIN_{name.upper()}"):
            values[name] = int(own) if isinstance(getattr(Config(), name), int) else own
    return Config(**values)


def save(config: Config, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        for field in fields(config):
            value = getattr(config, field.name)
            f.write(f"{field.name} = {value}\n" if isinstance(value, int) else f"{field.name} = {_quoted(value)}\n")


def _quoted(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace('"', '\\"')
    return f'"{escaped}"'
