"""Settings: a JSON document by run category and state, with paths resolved against the run folder."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """One run's values: those of its category, overlaid by those of its state; relative *_path values are resolved."""

    run_dir: Path
    values: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str, category: str | None = None, state: str | None = None, run_dir: str = ".") -> "Settings":
        document = json.loads(Path(path).read_text())
        values = {k: v for k, v in document.items() if not isinstance(v, dict)}
        part = document.get(category, {}) if category else {}
        if category and category not in document:
            raise KeyError(f"no run category {category}")
        values |= {k: v for k, v in part.items() if not isinstance(v, dict)}
        if state:
            if not isinstance(part.get(state), dict):
                raise KeyError(f"no state {state} in {category}")
            values |= part[state]
        return cls(Path(run_dir), values)

    def __getitem__(self, name: str):
        return self.values[name]

    def path(self, name: str) -> Path:
        """A path value, against the run folder; its parent is made if absent."""
        found = self.run_dir / self.values[name]
        found.parent.mkdir(parents=True, exist_ok=True)
        return found
