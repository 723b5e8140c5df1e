"""Mode configurations in JSON with comments: sections of plugins, modes that name them, and what a mode really depends on."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from ..operators.modes import Mode

SECTIONS = ("dservices", "recognizers", "deciders")
_COMMENT = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
_OWN = {"MinCover": "min_cover", "Bigram": "bigram", "HybridStat": "hybrid", "Address": "address"}
_TERMS = {"bigram.weight": "bigram", "length.weight": "length", "length.power": "power", "token.penalty": "token", "unknown.penalty": "unknown", "lexical.weight": "lexical"}


def locate(name: str, folders: Iterable[str | os.PathLike] = (), variable: str | None = None) -> str:
    """The first place where a resource is: as given, below each of the folders and their parents, below the folder an environment variable names; else as given."""
    named = [os.environ[variable]] if variable and os.environ.get(variable) else []
    roots = [Path(), *(p for f in folders for p in (Path(f), Path(f).resolve().parent)), *map(Path, named)]
    return next((str(r / name) for r in roots if (r / name).exists()), name)


def parse(text: str) -> dict[str, Any]:
    """JSON in which // and /* */ comments stand outside of strings; anything but an object is an error."""
    told = json.loads(_COMMENT.sub(lambda m: m[0] if m[0][0] == '"' else " ", text))
    if not isinstance(told, dict):
        raise ValueError("a configuration is an object")
    return told


def closure(config: Mapping[str, Any], mode: str | None = None) -> dict[str, dict[str, Any]]:
    """name -> definition of the plugins that a mode (or the default one) depends on, each after those it depends on itself.

    Plugins of other modes may be broken. Unknown modes and plugins, definitions without a type and circles are errors.
    """
    name = mode or config.get("default.mode")
    chosen = config.get("modes", {}).get(name)
    if not isinstance(chosen, Mapping):
        raise ValueError(f"unknown mode: {name}")
    done: dict[str, dict[str, Any]] = {}

    def visit(plugin: str, above: tuple[str, ...]) -> None:
        if plugin in above:
            raise ValueError(f"circle of plugins: {' -> '.join((*above, plugin))}")
        if plugin in done:
            return
        node = next((config[s][plugin] for s in SECTIONS if plugin in config.get(s, {})), None)
        if not isinstance(node, Mapping) or not isinstance(node.get("type"), str) or not node["type"]:
            raise ValueError(f"no usable plugin: {plugin}")
        for other in node.get("deps", {}).values():
            visit(other, (*above, plugin))
        done[plugin] = dict(node)

    for plugin in [chosen.get("decider"), *chosen.get("recognizers", [])]:
        if plugin:
            visit(plugin, ())
    return done


def mode_of(config: Mapping[str, Any], name: str | None = None) -> Mode:
    """A Mode as configured. A decider of a known type is ours, any other goes by its name and must be registered; so must recognizers that
    aren't dictionaries. Terms that are no numbers from 0 up keep their defaults; a dictionary in atom mode gives topn (0: all labels, one by one)."""
    plugins = closure(config, name)
    chosen = config["modes"][name or config["default.mode"]]
    told = plugins.get(chosen.get("decider"), {})
    decider = next((own for kind, own in _OWN.items() if told.get("type", "").startswith(kind)), chosen.get("decider"))
    terms = {own: float(told[k]) for k, own in _TERMS.items() if _usable(told.get(k))}
    found, topn, readings = [], None, False
    for r in chosen.get("recognizers", []):
        node = plugins[r]
        if node["type"].startswith("DictWord"):
            topn = int(node.get("topn", 0)) if node.get("atom.mode") == "true" else topn
        elif node["type"].startswith("Pinyin"):
            readings = True
        else:
            found.append(next((own for own in ("temporal", "address") if node["type"].lower().startswith(own)), r))
    return Mode(decider, tuple(found), terms, topn, readings)


def _usable(value: Any) -> bool:
    try:
        return math.isfinite(float(value)) and float(value) >= 0
    except (TypeError, ValueError):
        return False
