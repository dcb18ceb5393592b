"""Settings from YAML: a file, or a folder whose files are merged in order of name; and subscribers' filters as YAML documents."""

from __future__ import annotations

from dataclasses import fields, replace
from pathlib import Path

from .operators.correction import Settings
from .operators.filters import DIMENSIONS, Filter, Rule


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading settings needs PyYAML") from e
    return yaml


def merge(base: dict, over: dict) -> dict:
    """over on base: maps are merged key by key, everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str) -> dict:
    p, out = Path(path), {}
    for f in sorted(p.glob("*.y*ml")) if p.is_dir() else [p]:
        data = _yaml().safe_load(f.read_text()) or {}
        if not isinstance(data, dict):
            raise ValueError(f"{f} is no map")
        out = merge(out, data)
    return out


def correction_settings(config: dict) -> Settings:
    """Settings of the section `correction`; what is absent or not positive keeps its default."""
    given = config.get("correction") or {}
    known = {f.name: f for f in fields(Settings)}
    unknown = set(given) - set(known)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    ok = {k: v for k, v in given.items() if not isinstance(v, (int, float)) or isinstance(v, bool) or v > 0}
    if isinstance(ok.get("min_snr"), dict):
        ok["min_snr"] = tuple(sorted((m.upper(), int(v)) for m, v in ok["min_snr"].items()))
    return replace(Settings(), **ok)


def save_filter(f: Filter, path: str) -> None:
    doc = {"call": f.call, "beacons": f.beacons, "rules": {d.lower(): {"allow": sorted(r.allow), "block": sorted(r.block), "all": r.all, "block_all": r.block_all} for d, r in f.rules}}
    Path(path).write_text(_yaml().safe_dump(doc, sort_keys=True))


def load_filter(path: str) -> Filter:
    """A saved filter; dimensions that it lacks are open, and one that neither allows nor blocks anything is open too."""
    doc = _yaml().safe_load(Path(path).read_text()) or {}
    rules = {}
    for d, r in (doc.get("rules") or {}).items():
        rule = Rule(frozenset(r.get("allow") or ()), frozenset(r.get("block") or ()), bool(r.get("all")), bool(r.get("block_all")))
        rules[d.upper()] = Rule() if rule == Rule(all=False) else rule
    return Filter(tuple((d, rules.get(d, Rule())) for d in DIMENSIONS), doc.get("beacons"), doc.get("call") or "")
