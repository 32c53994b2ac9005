"""Rule packs: reviewed regexes from files, and suggestions for new ones from reports."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quire.functions.patterns import PACK_KEYS, Registry


def pack_names(setting: str) -> list[str]:
    return [n for n in (x.strip() for x in re.split("[,;]", setting or "")) if n]


def read_pack(path: str) -> dict[str, list[str]]:
    """A rule pack: a mapping of keys to one regex or a list of them."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no mapping")
    return {k: [v] if isinstance(v, str) else list(v or []) for k, v in data.items()}


def load(setting: str, folder: str, registry: Registry | None = None) -> Registry:
    """A registry extended by the named packs of a folder, in their order."""
    registry = registry or Registry()
    for name in pack_names(setting):
        registry.apply(read_pack(str(Path(folder) / name)))
    return registry


def suggestions(report: str) -> dict[str, list[str]]:
    """Valid regexes under known keys in a report's fenced ``rule_suggestions`` block."""
    import yaml

    m = re.search(r"```(?:ya?ml)?\s*\n(.*?)```", report, re.S)
    text = m[1] if m else report[report.find("rule_suggestions") :] if "rule_suggestions" in report else ""
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        return {}
    data = data.get("rule_suggestions", data) if isinstance(data, dict) else {}
    out: dict[str, list[str]] = {}
    for key in PACK_KEYS:
        for rule in (data or {}).get(key) or [] if isinstance(data, dict) else []:
            try:
                re.compile(str(rule))
            except re.error:
                continue
            out.setdefault(key, []).append(str(rule))
    return out


def table(spark: SparkSession, pack: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(k, n, r) for k, rules in pack.items() for n, r in enumerate(rules)], "key string, seq long, pattern string")
