"""Settings: defaults, then the user's file, then the project's, then the environment."""

from __future__ import annotations

import json
import os
from pathlib import Path

DEFAULTS = {
    "project": {"include": ["**/*.{ts,tsx,js,jsx,mjs,cjs,py,go,java}"], "exclude": ["**/node_modules/**", "**/dist/**"]},
    "llm": {"model": "", "baseUrl": "", "apiKey": "", "concurrency": 5},
    "embedding": {"model": "", "baseUrl": "", "apiKey": "", "dimension": 1024, "batch": 32},
    "retrieval": {"fileTopK": 10, "nodeTopK": 10, "fallback": 0.75, "hops": 2, "rrfK": 60},
    "multimodal": {"strong": 0.85, "weak": 0.70, "resourceTopK": 3},
}
#: Keys that a project's file must not have
SECRET_KEYS = {"apikey", "api_key", "token", "secret"}


def merge(base: dict, over: dict) -> dict:
    """over wins; maps merge, all else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def secret_keys(data, at: str = "") -> list[str]:
    if isinstance(data, dict):
        return [p for k, v in data.items() for p in ([f"{at}{k}"] if k.lower() in SECRET_KEYS else secret_keys(v, f"{at}{k}."))]
    return [p for i, v in enumerate(data) for p in secret_keys(v, f"{at}{i}.")] if isinstance(data, list) else []


def _read(path: Path) -> dict:
    if not path.exists():
        return {}
    data = json.loads(path.read_text())
    if not isinstance(data, dict):
        raise ValueError(f"{path} must hold an object")
    return data


def validate(c: dict) -> dict:
    r, m = c["retrieval"], c["multimodal"]
    for name in ("fileTopK", "nodeTopK", "rrfK"):
        if not isinstance(r[name], int) or r[name] < 1:
            raise ValueError(f"retrieval.{name} must be a whole number of at least 1")
    if not 0 <= r["hops"] <= 5:
        raise ValueError("retrieval.hops must be from 0 to 5")
    if not 0 <= m["weak"] <= m["strong"] <= 1:
        raise ValueError("thresholds must be 0 <= weak <= strong <= 1")
    return c


def load(project: str, user: str | None = None, env: dict | None = None) -> dict:
    env = os.environ if env is None else env
    own = _read(Path(project))
    if found := secret_keys(own):
        raise ValueError(f"credentials don't belong in the project's settings: {', '.join(found)}")
    out = merge(merge(DEFAULTS, _read(Path(user)) if user else {}), own)
    for part in ("llm", "embedding"):
        if key := env.get(f"LODEGRAPH_{part.upper()}_KEY"):
            out = merge(out, {part: {"apiKey": key}})
    return validate(out)


def mask(secret: str) -> str:
    return "" if not secret else "****" if len(secret) <= 8 else f"{secret[:4]}****{secret[-4:]}"


def get(config: dict, key: str):
    for part in key.split("."):
        config = config[part]
    return config


def put(path: str, key: str, value) -> None:
    data, parts = _read(Path(path)), key.split(".")
    nested = value
    for p in reversed(parts):
        nested = {p: nested}
    Path(path).write_text(json.dumps(merge(data, nested), indent=2))
