"""Settings: nested dictionaries, later ones win, then environment variables."""

from __future__ import annotations

import os
from copy import deepcopy
from typing import Any


def merged(base: dict, over: dict) -> dict:
    """``base`` with ``over`` laid over it, level by level; neither is changed."""
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def with_environment(settings: dict, prefix: str = "CORPUSLOOM_", environ: dict[str, str] | None = None) -> dict:
    """Overrides such as CORPUSLOOM_TRIAGE__SEND=0.8: two underscores step down, so that keys may contain one. Values keep the type of what they replace."""
    out = deepcopy(settings)
    for name, value in (os.environ if environ is None else environ).items():
        if not name.startswith(prefix):
            continue
        *path, key = name[len(prefix) :].lower().split("__")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        old = at.get(key)
        at[key] = value.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(value) if isinstance(old, (int, float)) else value
    return out


def get(settings: dict, path: str, default: Any = None) -> Any:
    """The value at a dotted path."""
    at: Any = settings
    for p in path.split("."):
        if not isinstance(at, dict) or p not in at:
            return default
        at = at[p]
    return at
