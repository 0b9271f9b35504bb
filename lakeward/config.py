"""Settings of a warehouse. The salt is required and is never shown."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    data_root: str
    warehouse: str
    salt: str = field(repr=False)
    as_of: str | None = None
    dedupe_mode: str = "coalesce"
    sketches: bool = False
    profiles: bool = True

    def path(self, *parts: str) -> str:
        return "/".join([self.warehouse, *parts])


def get_config(data_root: str | None = None, warehouse: str | None = None, salt: str | None = None, as_of: str | None = None, dedupe_mode: str = "coalesce", sketches: bool = False, profiles: bool = True) -> Config:
    """Arguments, else DATA_ROOT, WAREHOUSE_PATH and LAKEWARD_SALT. sketches: profiles count distinct values approximately; profiles: batches leave them."""
    salt = salt or os.environ.get("LAKEWARD_SALT", "")
    if not salt.strip():
        raise ValueError("a salt is required: pass salt or set LAKEWARD_SALT")
    return Config((data_root or os.environ.get("DATA_ROOT", "data")).rstrip("/"), (warehouse or os.environ.get("WAREHOUSE_PATH", "warehouse")).rstrip("/"), salt, as_of, dedupe_mode, sketches, profiles)
