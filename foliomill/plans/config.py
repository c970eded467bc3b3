"""Run settings from TOML, JSON or YAML files, with defaults lists, overrides and checks."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path


def merge(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, nested tables merged."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _parse(p: Path) -> dict:
    body = p.read_text(encoding="utf-8")
    if p.suffix == ".toml":
        return tomllib.loads(body)
    if p.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError(f"{p}: reading YAML needs the yaml package") from error
        settings = yaml.safe_load(body) or {}
    else:
        settings = json.loads(body)
    if isinstance(settings, dict) and isinstance(settings.get("defaults"), list):
        settings = _with_defaults(p, settings)
    return settings


def _with_defaults(p: Path, settings: dict) -> dict:
    """The files that a list of defaults names ("group: name" beside the file), each under its group, with the file's own settings over them; _self_
    says where its own come."""
    out: dict = {}
    own = {k: v for k, v in settings.items() if k != "defaults"}
    placed = False
    for one in settings["defaults"]:
        if one == "_self_":
            out, placed = merge(out, own), True
        elif isinstance(one, dict):
            for group, name in one.items():
                if name is not None:
                    out = merge(out, {group: _parse(p.parent / group / f"{name}{p.suffix}")})
        else:
            out = merge(out, _parse(p.parent / f"{one}{p.suffix}"))
    return out if placed else merge(out, own)


def selected(flags: dict[str, bool], components: list[str], generated: bool = False, everything: bool = False) -> list[str]:
    """The components to fetch: those whose flag is set, all but the first (the files themselves) with ``generated``, all with ``everything`` or if nothing
    is chosen; in the order of ``components``."""
    chosen = {c for c in components if flags.get(c)} | (set(components[1:]) if generated else set())
    return [c for c in components if everything or not chosen or c in chosen]


def load(path: str | Path, overrides: list[str] = ()) -> dict:
    """Settings of a file; overrides are given as a.b=value, the value as JSON or plain text."""
    p = Path(path)
    settings = _parse(p)
    if not isinstance(settings, dict):
        raise ValueError(f"{p} holds no table of settings")
    for one in overrides:
        name, _, value = one.partition("=")
        try:
            parsed = json.loads(value)
        except ValueError:
            parsed = value
        for part in reversed(name.split(".")):
            parsed = {part: parsed}
        settings = merge(settings, parsed)
    return settings
