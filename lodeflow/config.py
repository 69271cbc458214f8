"""The settings that the plans take, read from JSON: names and kinds are checked while reading, paths are made absolute."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from types import MappingProxyType

ROOTED = "paths"  # the section whose values are paths


@dataclass(frozen=True)
class Grouping:
    radius: int = 8


@dataclass(frozen=True)
class Splitting:
    val_ratio: float = 0.1
    least: int = 10
    folds: int = 3
    seed: int = 42
    head: float = 0.33
    tail: float = 0.33


@dataclass(frozen=True)
class Signals:
    k: int = 20
    tau: float = 10.0
    scale: float = 20.0
    conflict: float = 0.1
    least_mass: float = 5.0


@dataclass(frozen=True)
class Settings:
    grouping: Grouping = field(default_factory=Grouping)
    splitting: Splitting = field(default_factory=Splitting)
    signals: Signals = field(default_factory=Signals)
    weights: MappingProxyType[str, float] = MappingProxyType({"cls": 1.0, "proto": 1.0, "knn": 1.0})
    paths: MappingProxyType[str, str] = MappingProxyType({})


def _section(kind: type, told: object, where: str) -> object:
    if not isinstance(told, dict):
        raise ValueError(f"{where} is no table of settings")
    known = {f.name: f.default for f in fields(kind)}
    for name, value in told.items():
        if name not in known:
            raise ValueError(f"unknown setting {where}.{name}")
        wanted = (int, float) if isinstance(known[name], float) else (type(known[name]),)
        if isinstance(value, bool) or not isinstance(value, wanted):
            raise ValueError(f"{where}.{name} is {value!r}, not of kind {type(known[name]).__name__}")
    return kind(**{name: type(known[name])(value) for name, value in told.items()})


def read_settings(path: str | Path) -> Settings:
    """Settings from a JSON file; what it leaves out has its default.

    ValueError for an unknown name, a value of another kind, or a file that holds no table. Relative paths are relative to
    the file's folder; URLs and absolute paths stay as they are.
    """
    path = Path(path)
    told = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(told, dict):
        raise ValueError(f"{path} holds no table of settings")
    sections = {"grouping": Grouping, "splitting": Splitting, "signals": Signals}
    found: dict[str, object] = {}
    for name, value in told.items():
        if name in sections:
            found[name] = _section(sections[name], value, name)
        elif name == "weights" and isinstance(value, dict) and value and all(isinstance(w, int | float) and not isinstance(w, bool) for w in value.values()):
            found[name] = MappingProxyType({k: float(w) for k, w in value.items()})
        elif name == ROOTED and isinstance(value, dict) and all(isinstance(p, str) for p in value.values()):
            found[name] = MappingProxyType({k: p if "://" in p or Path(p).is_absolute() else str(path.resolve().parent / p) for k, p in value.items()})
        else:
            raise ValueError(f"unknown or malformed setting {name}")
    return Settings(**found)
