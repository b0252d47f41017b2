"""Settings: defaults, then a file, then the environment, then arguments."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

from sextant.errors import ConfigError

#: Defaults and the values that are allowed.
DEFAULTS: dict[str, dict[str, Any]] = {
    "ingestion": {"connector": "local", "chunker": "sentence", "chunk_size": 2000, "overlap": 200},
    "embeddings": {"provider": "hashing", "dimension": 64},
    "store": {"kind": "parquet", "path": "vectors", "metric": "cosine", "collection": "default"},
    "answers": {"provider": "extractive"},
    "graph": {"max_retries": 2, "refusal_threshold": 0.8, "early_confidence": 0.4, "k": 5},
}
ALLOWED = {("ingestion", "connector"): ("local", "json_pages", "s3", "web"), ("ingestion", "chunker"): ("fixed", "sentence"), ("store", "metric"): ("cosine", "l2", "ip")}


def coerce(text: str) -> bool | int | float | str:
    """true/yes/1 and false/no/0 to booleans, then whole numbers, then numbers, else the text."""
    low = text.lower()
    if low in ("true", "yes", "1"):
        return True
    if low in ("false", "no", "0"):
        return False
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def merged(base: Mapping, over: Mapping) -> dict:
    """base with the entries of over, sections merged in turn."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _file(path: str) -> dict:
    """A settings file in JSON, or in YAML where the yaml package is installed; an empty one sets nothing."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        if path.endswith((".yaml", ".yml")):
            import yaml

            out = yaml.safe_load(text)
        else:
            out = json.loads(text or "{}")
    except ImportError as e:
        raise ConfigError("settings in YAML need the yaml package") from e
    except Exception as e:  # the parsers' own errors differ
        raise ConfigError(f"{path}: {e}") from e
    if out is not None and not isinstance(out, dict):
        raise ConfigError(f"{path} holds no sections")
    return out or {}


def settings(path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "SEXTANT_", **over: Any) -> dict:
    """All settings by section; the environment names them PREFIX_SECTION__KEY."""
    out = merged({}, DEFAULTS)
    if path:
        out = merged(out, _file(path))
    for k, v in (os.environ if env is None else env).items():
        section, _, key = k.removeprefix(prefix).lower().partition("__")
        if k.startswith(prefix) and key:
            out = merged(out, {section: {key: coerce(v)}})
    out = merged(out, over)
    for (section, key), values in ALLOWED.items():
        if out[section][key] not in values:
            raise ConfigError(f"{section}.{key} is one of {', '.join(values)}")
    return out
