"""Where things lie, and which providers serve: from the environment, with defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Folders:
    """The places of a project; any store that Spark reads. Nothing is made before it is written."""

    root: str = field(default_factory=lambda: os.environ.get("QUERN_ROOT", "quern-data"))

    @property
    def manifest(self) -> str:
        return f"{self.root}/manifest"

    @property
    def raw(self) -> str:
        return f"{self.root}/raw"

    @property
    def cache(self) -> str:
        return f"{self.root}/cache"

    @property
    def processed(self) -> str:
        return f"{self.root}/processed"

    @property
    def index(self) -> str:
        return f"{self.root}/index"

    @property
    def questions(self) -> str:
        return f"{self.root}/eval/questions.jsonl"


@dataclass(frozen=True)
class Settings:
    """Names of the providers and their models; keys stay in the environment and are read by the provider."""

    folders: Folders = field(default_factory=Folders)
    provider: str = field(default_factory=lambda: os.environ.get("LLM_PROVIDER", "extractive"))
    model: str = field(default_factory=lambda: os.environ.get("LLM_MODEL", ""))
    fast_model: str = field(default_factory=lambda: os.environ.get("LLM_FAST_MODEL", ""))
    encoder: str = field(default_factory=lambda: os.environ.get("QUERN_ENCODER", "hash-64"))


def settings() -> Settings:
    return Settings()
