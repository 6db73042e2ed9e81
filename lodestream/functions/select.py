"""Feature lists from configuration."""

from __future__ import annotations

import difflib
import json
from collections.abc import Mapping, Sequence


def features(spec: Mapping, wanted: str | Sequence[str] = "all", without: Sequence[str] = ()) -> list[str]:
    """Columns for ``all``, a group's name, a list, a JSON list or a comma list of groups and columns; first seen first, minus ``without``.

    A name that is no group is a column. Nothing left is an error.
    """
    spec = spec.get("features", spec)
    groups = spec.get("feature_groups", {})
    every = list(spec.get("feature_all") or spec.get("input") or [c for g in groups.values() for c in g])
    if isinstance(wanted, str):
        text = wanted.strip()
        wanted = json.loads(text.replace("'", '"')) if text.startswith("[") else [w.strip() for w in text.split(",") if w.strip()]
    out: list[str] = []
    for w in wanted:
        out += every if w in ("all", "feature_all") else groups.get(w, [w])
    out = [c for c in dict.fromkeys(out) if c not in set(without)]
    if not out:
        raise ValueError("no features are left")
    return out


def audit(columns: Sequence[str], wanted: Sequence[str]) -> dict[str, list[str]]:
    """The wanted columns that are missing, each with up to three similar names."""
    return {w: difflib.get_close_matches(w, columns, 3, 0.6) for w in wanted if w not in columns}


def settings(path: str) -> dict:
    """A YAML or JSON file; an empty one gives no settings."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def checked(params: Mapping, allowed: Sequence[str], what: str = "parameters") -> dict:
    """``params`` if all are allowed."""
    if unknown := sorted(set(params) - set(allowed)):
        raise ValueError(f"unknown {what}: {unknown}; allowed are {sorted(allowed)}")
    return dict(params)
