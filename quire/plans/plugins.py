"""Hooks for code from outside: cleaners, classifiers, checks, patterns, post-processors.

A hook is a function from DataFrame to DataFrame, so plugins are planned with the rest.
A hook that fails is reported and passed over.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from quire.functions.patterns import Registry

Hook = Callable[[DataFrame], DataFrame]


@dataclass
class Plugins:
    cleaners: list[Hook] = field(default_factory=list)
    classifiers: list[Hook] = field(default_factory=list)
    checks: list[Hook] = field(default_factory=list)
    post_processors: list[Callable[[str], None]] = field(default_factory=list)
    rules: dict[str, list[str]] = field(default_factory=dict)
    failures: list[str] = field(default_factory=list)

    def register(self, kind: str, hook: Callable) -> Callable:
        hooks = getattr(self, kind)
        if hook not in hooks:
            hooks.append(hook)
        return hook

    def register_rules(self, key: str, rules: list[str]) -> None:
        known = self.rules.setdefault(key, [])
        known += [r for r in rules if r not in known]

    def registry(self, base: Registry | None = None) -> Registry:
        out = base or Registry()
        out.apply(self.rules)
        return out

    def apply(self, kind: str, df: DataFrame) -> DataFrame:
        """All hooks of a kind in turn; a check adds its findings to those before."""
        for hook in getattr(self, kind):
            try:
                new = hook(df)
                df = df.unionByName(new) if kind == "checks" else new
            except Exception as e:  # noqa: BLE001 - a plugin may raise anything
                self.failures.append(f"{kind}: {getattr(hook, '__name__', hook)}: {e}")
        return df

    def discover(self, folder: str) -> list[str]:
        """Loads the folder's modules by name; each gets this object through its ``register(plugins)``."""
        loaded = []
        for path in sorted(Path(folder).glob("*.py")) if Path(folder).is_dir() else []:
            if path.name.startswith("_"):
                continue
            try:
                spec = importlib.util.spec_from_file_location(f"quire_plugin_{path.stem}", path)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                module.register(self)
                loaded.append(path.stem)
            except Exception as e:  # noqa: BLE001
                self.failures.append(f"{path.name}: {e}")
        return loaded
