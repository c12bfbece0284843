"""Configuration: defaults, search, merge, validation; and entry points named by a package manifest."""

from __future__ import annotations

import json
import logging
import os
import posixpath
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

log = logging.getLogger("codeloom")

# Defaults.
DEFAULTS: dict[str, Any] = {
    "entryPoints": ["src/index.js", "bin/**/*.js"],
    "ignore": [
        "**/*.test.js", "**/*.spec.js", "tests/**", "dist/**", "build/**", "coverage/**", "node_modules/**", ".git/**",
    ],
    "thresholds": {"fileLines": 500, "functionLines": 50, "cyclomaticComplexity": 10, "functionParameters": 5},
    "languages": ["javascript"],
    "includeTests": False,
    "outputFormat": "json",
}


def merge(defaults: dict, user: dict) -> dict:
    """User values over defaults; thresholds are merged one by one, lists are replaced, empty ones by the defaults only if null."""
    out = {**defaults, **user, "thresholds": {**defaults["thresholds"], **(user.get("thresholds") or {})}}
    for key in ("ignore", "entryPoints", "languages"):
        if out.get(key) is None:
            out[key] = defaults[key]
    return out


@dataclass
class Config:
    values: dict[str, Any] = field(default_factory=lambda: merge(DEFAULTS, {}))

    @classmethod
    def load(cls, path: str | None = None, folder: str = ".", home: str | None = None, name: str = "codeloom") -> Config:
        """The first readable file of: path, .<name>.json and .<name>/config.json in folder, .<name>.json at home."""
        places = [path, f"{folder}/.{name}.json", f"{folder}/.{name}/config.json", f"{home or os.path.expanduser('~')}/.{name}.json"]
        for place in filter(None, places):
            if Path(place).exists():
                try:
                    return cls(merge(DEFAULTS, json.loads(Path(place).read_text("utf-8"))))
                except (ValueError, OSError) as why:
                    log.warning("Failed to load %s: %s", place, why)
        return cls()

    def get(self, key: str) -> Any:
        return self.values.get(key)

    def threshold(self, key: str) -> Any:
        return self.values["thresholds"].get(key)

    @property
    def ignore(self) -> list[str]:
        return self.values["ignore"]

    @property
    def entry_points(self) -> list[str]:
        return self.values["entryPoints"]

    @property
    def entry_patterns(self) -> list[str]:
        return self.values.get("entryPointPatterns") or []

    @property
    def languages(self) -> list[str]:
        return self.values["languages"]

    @property
    def include_tests(self) -> bool:
        return self.values["includeTests"]

    @property
    def output_format(self) -> str:
        return self.values["outputFormat"]

    def validate(self) -> bool:
        """True, or a ValueError that names everything wrong."""
        wrong = [
            f"threshold {key} must be a positive number"
            for key, v in self.values["thresholds"].items()
            if isinstance(v, bool) or not isinstance(v, (int, float)) or v <= 0
        ]
        wrong += [f"{key} must be a list" for key in ("entryPoints", "languages") if not isinstance(self.values[key], list)]
        if wrong:
            raise ValueError("Invalid configuration: " + "; ".join(wrong))
        return True


def manifest_entries(text: str | None, root: str) -> list[str]:
    """Paths that a package manifest (JSON) names as main, bin or exports; none where it cannot be read."""
    try:
        manifest = json.loads(text or "")
    except ValueError:
        return []
    if not isinstance(manifest, dict):
        return []
    found: list[str] = []
    if isinstance(manifest.get("main"), str) and manifest["main"]:
        found.append(manifest["main"])
    bins = manifest.get("bin")
    found += [bins] if isinstance(bins, str) and bins else [b for b in bins.values() if isinstance(b, str)] if isinstance(bins, dict) else []

    def exported(value: Any) -> None:
        if isinstance(value, str):
            found.append(value)
        elif isinstance(value, dict):
            for key, inner in value.items():
                if key.startswith(".") or isinstance(inner, str):
                    exported(inner)

    exported(manifest.get("exports"))
    return [posixpath.normpath(posixpath.join(root, p)) for p in found]
