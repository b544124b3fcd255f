"""Settings: defaults, dotted access, checks, a JSON file."""

from __future__ import annotations

import json
from copy import deepcopy
from pathlib import Path
from typing import Any

from .errors import ParameterError

DEFAULTS: dict[str, Any] = {
    "preview": {"max_rows": 100, "max_files": 10, "max_text_length": 200},
    "process": {"chunk_size": 1000, "similarity_threshold": 0.95},
    "generation": {"max_workers": 4, "quality_threshold": 0.7, "max_attempts": 3, "max_backoff": 8.0},
    "model": {"timeout": 120.0, "max_tokens": 2048, "temperature": 0.7, "top_p": 0.9},
    "tasks": {"days_to_keep": 30, "stale_after_hours": 1},
}
#: Lower and upper bounds of numbers.
BOUNDS = {
    "preview.max_rows": (1, 100_000), "preview.max_files": (1, 10_000), "preview.max_text_length": (1, 1_000_000),
    "process.chunk_size": (1, 1_000_000), "process.similarity_threshold": (0.0, 1.0),
    "generation.max_workers": (1, 1024), "generation.quality_threshold": (0.0, 1.0), "generation.max_attempts": (1, 100), "generation.max_backoff": (0.0, 3600.0),
    "model.timeout": (0.1, 3600.0), "model.max_tokens": (1, 1_000_000), "model.temperature": (0.0, 2.0), "model.top_p": (0.0, 1.0),
    "tasks.days_to_keep": (0, 100_000), "tasks.stale_after_hours": (0, 100_000),
}


class Config:
    def __init__(self, path: str | None = None):
        self.path, self.values = Path(path) if path else None, deepcopy(DEFAULTS)
        if self.path and self.path.exists():
            for section, values in json.loads(self.path.read_text(encoding="utf-8")).items():
                self.values.setdefault(section, {}).update(values)

    def get(self, key: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, key: str, value: Any) -> None:
        if key in BOUNDS and not (isinstance(value, int | float) and BOUNDS[key][0] <= value <= BOUNDS[key][1]):
            raise ParameterError(f"{key} lies within {BOUNDS[key]}")
        *path, last = key.split(".")
        at = self.values
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
        self.save()

    def reset(self, section: str | None = None) -> None:
        if section is None:
            self.values = deepcopy(DEFAULTS)
        else:
            self.values[section] = deepcopy(DEFAULTS[section])
        self.save()

    def problems(self) -> list[str]:
        return [f"{k}: {self.get(k)!r} is not within {b}" for k, b in BOUNDS.items() if not (isinstance(self.get(k), int | float) and b[0] <= self.get(k) <= b[1])]

    def save(self) -> None:
        if self.path:
            part = self.path.with_name(self.path.name + ".tmp")
            part.write_text(json.dumps(self.values, ensure_ascii=False, indent=2), encoding="utf-8")
            part.replace(self.path)
