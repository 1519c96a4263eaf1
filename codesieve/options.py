"""Scan options: defaults, nested overrides, validation."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from codesieve.catalog import fixed_values as V


def merged(base: dict, changes: dict) -> dict:
    """Defaults with nested changes applied; values other than mappings replace."""
    out = copy.deepcopy(base)
    for key, value in changes.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged(out[key], value) if both else copy.deepcopy(value)
    return out


@dataclass
class ScanOptions:
    """Options of a scan; build it with ``ScanOptions.of`` to override nested defaults."""

    values: dict = field(default_factory=lambda: copy.deepcopy(V.DEFAULT_OPTIONS))

    @classmethod
    def of(cls, changes: dict | None = None, **analysis) -> ScanOptions:
        options = cls(merged(V.DEFAULT_OPTIONS, merged(changes or {}, {"analysis": analysis})))
        options.validate()
        return options

    def validate(self) -> None:
        problems = self.problems()
        if problems:
            raise ValueError("; ".join(problems))

    def problems(self) -> list[str]:
        analysis, found = self.values["analysis"], []
        names = [s[0] for s in V.SEVERITIES]
        if analysis["min_severity"] not in names:
            found.append(f"min_severity must be one of {names}, not {analysis['min_severity']!r}")
        value = analysis["max_file_size_mb"]
        if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or value <= 0):
            found.append(f"max_file_size_mb must be a positive number or None, not {value!r}")
        return found

    def with_exclusions(self, *globs: str) -> ScanOptions:
        out = copy.deepcopy(self)
        out.values["exclusions"]["patterns"] += list(globs)
        return out

    @property
    def min_severity(self) -> str:
        return self.values["analysis"]["min_severity"]

    @property
    def include_tests(self) -> bool:
        return self.values["analysis"]["include_tests"]

    @property
    def max_file_bytes(self) -> float | None:
        """Size limit, None (the default) for no limit."""
        limit = self.values["analysis"]["max_file_size_mb"]
        return None if limit is None else limit * 1024 * 1024

    @property
    def exclusion_globs(self) -> list[str]:
        exclusions = self.values["exclusions"]
        return exclusions["patterns"] + ([] if self.include_tests else exclusions["test_patterns"])

    @property
    def disabled_languages(self) -> list[str]:
        return sorted(k for k, v in self.values["languages"].items() if not v.get("enabled", False))

    @property
    def enabled_languages(self) -> list[str]:
        return sorted(k for k, v in self.values["languages"].items() if v.get("enabled", False))
