"""Settings: layers of dictionaries merged into validated dataclasses, and review profiles."""

from __future__ import annotations

import json
import os
from copy import deepcopy
from dataclasses import dataclass, field

from loomgrid.operators.findings import Gate
from loomgrid.sources import yaml

ACTIONS = ("block", "warn", "ignore")
BACKENDS = ("auto", "hashing", "pretrained")


def merge(*layers: dict) -> dict:
    """Later layers win; dictionaries merge by key, everything else is replaced; None leaves a value as it is."""
    out: dict = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = merge(out[k], v)
            elif v is not None:
                out[k] = deepcopy(v)
    return out


def load_config(*sources: str | dict | None) -> dict:
    """Settings from files and dictionaries, later ones winning: global file, project file, command line.

    A missing file is an empty layer; one that is no mapping is an error.  The gate is
    validated, and so is the embedding backend.
    """
    layers = []
    for x in sources:
        if isinstance(x, str):
            if not os.path.exists(x):
                continue
            with open(x, encoding="utf-8") as f:
                text = f.read()
            x = json.loads(text) if x.endswith(".json") else yaml.load(text)
            if x is not None and not isinstance(x, dict):
                raise ValueError("a configuration is a mapping")
        layers.append(x or {})
    out = merge(*layers)
    if isinstance(out.get("gate"), dict):
        gate(out["gate"])
    if "embedding" in out:
        backend((out["embedding"] or {}).get("backend"), True)
    return out


def load_profiles(text: str) -> dict[str, Profile]:
    """Profiles of a document: name -> extends, and areas by id with weight and text."""
    out = {}
    for name, p in (yaml.load(text) or {}).items():
        p = p or {}
        areas = {k: (int((a or {}).get("weight", 5)), str((a or {}).get("text", ""))) for k, a in (p.get("areas") or {}).items()}
        out[name] = Profile(name, p.get("extends"), areas)
    return out


def gate(config: dict) -> Gate:
    """The quality gate of a configuration; unknown keys and actions are errors, categories are compared in lower case."""
    known = {"enabled", "max_critical", "max_major", "max_minor", "max_security", "categories"}
    if bad := set(config) - known:
        raise ValueError(f"unknown gate settings: {sorted(bad)}")
    cats = {}
    for name, c in (config.get("categories") or {}).items():
        action = str(c.get("action", "warn")).lower()
        if action not in ACTIONS:
            raise ValueError(f"unknown action {action!r} of category {name!r}")
        cats[name.lower()] = (action, c.get("max_findings"))
    return Gate(**{k: v for k, v in config.items() if k != "categories"}, categories=cats)


def backend(setting: str | None, vocabulary_present: bool) -> str:
    """hashing or pretrained: auto takes the vocabulary where there is one."""
    s = (setting or "auto").lower()
    if s not in BACKENDS:
        raise ValueError(f"unknown embedding backend {setting!r}")
    if s == "pretrained" and not vocabulary_present:
        raise ValueError("the pretrained backend needs a vocabulary")
    return ("pretrained" if vocabulary_present else "hashing") if s == "auto" else s


@dataclass
class Profile:
    """What a review looks for: focus areas by id, each with a weight from 1 to 10."""

    name: str
    extends: str | None = None
    areas: dict[str, tuple[int, str]] = field(default_factory=dict)


def resolve_profile(name: str, profiles: dict[str, Profile], seen: tuple[str, ...] = ()) -> Profile:
    """A profile with all it extends; its own areas win. A ring of profiles and a weight out of range are errors."""
    if name in seen:
        raise ValueError(f"profiles extend each other: {' -> '.join([*seen, name])}")
    p = profiles[name]
    base = resolve_profile(p.extends, profiles, (*seen, name)).areas if p.extends else {}
    areas = {**base, **p.areas}
    for i, (w, _) in areas.items():
        if not 1 <= w <= 10:
            raise ValueError(f"weight {w} of area {i!r} is not within 1 and 10")
    return Profile(name, None, areas)


def profile_prompt(p: Profile) -> str:
    """Focus areas, heaviest first, then by id."""
    return "\n".join(f"- {i} ({w}/10): {text}" for i, (w, text) in sorted(p.areas.items(), key=lambda x: (-x[1][0], x[0])))
