"""Settings from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path


def _path(name: str, default: str) -> Path:
    return Path(os.environ.get(f"TRACEWELL_{name}", default)).expanduser()


@dataclass(frozen=True)
class Settings:
    """Where copies of repositories, the registry and the job log are kept (folders that a Spark session can reach)."""

    cache: Path = field(default_factory=lambda: _path("CACHE", "~/.cache/tracewell/clones"))
    registry: str = field(default_factory=lambda: os.environ.get("TRACEWELL_REGISTRY", ""))
    jobs: str = field(default_factory=lambda: os.environ.get("TRACEWELL_JOBS", ""))
    #: package.module:function of a chat, (system, user) to an answer; advice is made with it, and only if it is asked for
    chat: str = field(default_factory=lambda: os.environ.get("TRACEWELL_CHAT", ""))
