"""Settings, checked where they are made; from_env() reads QUARRYMILL_* variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from quarrymill.errors import ConfigError
from quarrymill.operators.splitting import LADDER

TRUE = ("1", "true", "yes", "on", "y", "是")


@dataclass(frozen=True)
class Chunking:
    size: int = 512
    overlap: int = 128
    separators: tuple[str, ...] = LADDER

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ConfigError("chunks need a positive size and an overlap below it")


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    hybrid: bool = False
    alpha: float = 0.5
    adaptive: bool = False
    short_query: int = 12
    short_alpha: float = 0.4
    long_alpha: float = 0.6
    rerank: bool = False
    multiplier: int = 4
    context_tokens: int = 4000

    def __post_init__(self) -> None:
        if not all(0 <= a <= 1 for a in (self.alpha, self.short_alpha, self.long_alpha)):
            raise ConfigError("weights lie between 0 and 1")
        if min(self.top_k, self.multiplier, self.short_query) < 1:
            raise ConfigError("top_k, multiplier and short_query are 1 at least")


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    folder: str = "./index"


def env_file(path: str = ".env") -> dict[str, str]:
    """The variables of a file of NAME=value lines; none without the file."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = [line.strip().removeprefix("export ").split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#")]
    return {name.strip(): value.strip().strip("\"'") for name, value in pairs}


def from_env(env: Mapping[str, str] | None = None) -> Settings:
    """Settings by the variables of the environment, or of a file .env beside it where the environment says nothing."""
    env = env_file() | dict(os.environ) if env is None else env

    def read(kind: type):
        found = {}
        for f in fields(kind):
            raw = env.get(f"QUARRYMILL_{f.name.upper()}")
            if raw is None or f.type not in ("bool", "int", "float"):
                continue
            try:
                found[f.name] = raw.strip().lower() in TRUE if f.type == "bool" else {"int": int, "float": float}[f.type](raw)
            except ValueError as e:
                raise ConfigError(f"QUARRYMILL_{f.name.upper()} can't be {raw!r}") from e
        return kind(**found)

    return Settings(read(Chunking), read(Retrieval), env.get("QUARRYMILL_FOLDER", "./index"))
