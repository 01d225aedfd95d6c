"""Pipelines from YAML or JSON files."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Any

_VARIABLE = re.compile(r"\$\{(\w+)\}")


def expand(value: Any) -> Any:
    """``${NAME}`` in any text by the environment; an unset one is an error."""
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    if isinstance(value, str):

        def one(m: re.Match) -> str:
            if m[1] not in os.environ:
                raise ValueError(f"environment variable {m[1]} is not set")
            return os.environ[m[1]]

        return _VARIABLE.sub(one, value)
    return value


def load(path: str) -> dict[str, Any]:
    """The settings of a file; ``data`` is another name of ``dataset``, and a dataset's source may be nested."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        raw = yaml.safe_load(text)
    elif path.endswith(".json"):
        raw = json.loads(text)
    else:
        raise ValueError(f"unknown kind of settings: {path}")
    if not isinstance(raw, dict):
        raise ValueError("settings must be a mapping")
    found = expand(raw)
    if "data" in found:
        found["dataset"] = found.pop("data")
    dataset = found.get("dataset", {})
    if isinstance(dataset.get("source"), dict):
        dataset = {**dataset, **dataset["source"]}
        dataset.pop("source")
        found["dataset"] = dataset
    return found
