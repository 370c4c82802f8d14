"""Settings: defaults, then a TOML file, then an extra file, then the environment."""

from __future__ import annotations

import hmac
import os
import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    data_dir: str = "."
    sync_url: str = ""
    sync_token: str = ""
    sync_mode: str = "local"
    page_limit: int = 100
    semantic: bool = True
    min_score: float = 0.45

    def checked(self) -> Settings:
        """Unknown modes are local; remote modes without an address too."""
        mode = self.sync_mode if self.sync_mode in ("local", "remote", "hybrid") else "local"
        return replace(self, sync_mode=mode if self.sync_url else "local", page_limit=min(max(self.page_limit, 1), 500))


def _typed(kind: str, value: object) -> object:
    if kind == "bool":
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float, "str": str}[kind](value)


def load(paths: list[str] = (), environment: dict[str, str] | None = None, prefix: str = "SKEINERY_") -> Settings:
    """Later sources win; missing files and unknown keys are ignored."""
    environment = os.environ if environment is None else environment
    kinds = {f.name: str(f.type) for f in fields(Settings)}
    values: dict[str, object] = {}
    for path in paths:
        if os.path.exists(path):
            with open(path, "rb") as f:
                values |= {k: v for k, v in tomllib.load(f).items() if k in kinds}
    values |= {k: environment[prefix + k.upper()] for k in kinds if prefix + k.upper() in environment}
    return Settings(**{k: _typed(kinds[k], v) for k, v in values.items()}).checked()


def token_matches(given: str | None, wanted: str) -> bool:
    """Is the bearer token the wanted one?  Takes the same time wherever they differ; an empty wanted token lets all pass."""
    return not wanted or hmac.compare_digest((given or "").encode(), wanted.encode())
