"""Settings of the environment: ENTLOOM_STORE, ENTLOOM_VALIDATION, ENTLOOM_RETRY and so on, by field."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    store: str = "entloom-store"
    validation: str = "coerce"
    retry: bool = False
    check_references: bool = False

    def __post_init__(self):
        if self.validation not in ("coerce", "strict", "off"):
            raise ValueError(f"no validation mode {self.validation!r}")

    @staticmethod
    def from_env(env: Mapping[str, str] | None = None, prefix: str = "ENTLOOM_") -> Config:
        env = os.environ if env is None else env
        found = {}
        for f in fields(Config):
            if (v := env.get(prefix + f.name.upper())) is not None:
                found[f.name] = v.lower() in ("1", "true", "yes") if f.type == "bool" else v
        return Config(**found)
