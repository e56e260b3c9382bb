"""Suites and reports as YAML or JSON files. The keys of the files are fixed values: suite, name, dataset_urn, description, rules, type, column, severity, params."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from .engine import Report
from .rules import KINDS, Suite, rule

_SUFFIXES = (".yaml", ".yml", ".json")


def plain(suite: Suite) -> dict[str, Any]:
    """A suite as its file holds it."""
    rules = []
    for r in suite.rules:
        entry = {"name": r.name, "type": r.kind, "severity": "blocking" if r.blocking else "warning", "column": r.column, "params": {r.spec.parameter: r.limit} if r.spec.parameter else None}
        rules.append({k: v for k, v in entry.items() if v is not None})
    return {"suite": {"name": suite.name, "dataset_urn": suite.dataset, "description": suite.description, "rules": rules}}


def of_plain(data: dict[str, Any]) -> Suite:
    """With or without the outer `suite`; the type may be called rule_type, and a parameter may stand under params or beside the other keys."""
    body = data.get("suite", data)
    rules = []
    for entry in body.get("rules") or []:
        kind = entry.get("type") or entry["rule_type"]
        key = KINDS[kind].parameter
        limit = (entry.get("params") or {}).get(key, entry.get(key)) if key else None
        rules.append(rule(kind, entry.get("column"), limit, name=entry.get("name"), blocking=entry.get("severity", "blocking") == "blocking", dataset=entry.get("dataset_urn", "")))
    return Suite(body["name"], body.get("dataset_urn", ""), tuple(rules), body.get("description", ""))


def _text(data: Any, path: Path) -> str:
    if path.suffix == ".json":
        return json.dumps(data, indent=2, ensure_ascii=False, default=str)
    import yaml

    return yaml.safe_dump(data, sort_keys=False, allow_unicode=True)


def _checked(path: str | Path) -> Path:
    path = Path(path)
    if path.suffix not in _SUFFIXES:
        raise ValueError(f"{path.name}: not one of {', '.join(_SUFFIXES)}")
    return path


def save(what: Suite | Report, path: str | Path) -> None:
    """A suite, or a report with its tally."""
    path = _checked(path)
    data: dict[str, Any]
    if isinstance(what, Suite):
        data = plain(what)
    else:
        data = {"suite": what.suite.name, "dataset_urn": what.suite.dataset, "at": what.at.isoformat(), **what.tally()}
        data["results"] = [{"rule": o.rule.name, "type": o.rule.kind, "column": o.rule.column, "passed": o.passed, "measured": o.measured if isinstance(o.measured, (int, float, str, bool)) else None if o.measured is None else str(o.measured), "error": o.error} for o in what.outcomes]
    path.write_text(_text(data, path), encoding="utf-8")


def load(path: str | Path) -> list[Suite]:
    """A file's suite, or those of all files in a folder by name."""
    path = Path(path)
    if path.is_dir():
        return [s for f in sorted(path.iterdir()) if f.suffix in _SUFFIXES for s in load(f)]
    text = _checked(path).read_text(encoding="utf-8")
    if path.suffix == ".json":
        return [of_plain(json.loads(text))]
    import yaml

    return [of_plain(yaml.safe_load(text))]
