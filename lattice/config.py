"""Settings from a flat mapping or a small YAML/JSON file."""

from __future__ import annotations

import json

from lattice.plans.engine import DEFAULTS


def load_config(path: str) -> dict:
    """Known settings of a JSON file, or of a YAML file if a YAML reader is installed; one level of sections is flattened."""
    text = open(path, encoding="utf-8").read()
    try:
        raw = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML reader is installed; use JSON") from e
        raw = yaml.safe_load(text) or {}
    flat = {}
    for key, value in raw.items():
        flat |= value if isinstance(value, dict) else {key: value}
    return {k: v for k, v in flat.items() if k in DEFAULTS}
