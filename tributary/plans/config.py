"""Configurations from JSON or YAML: one analysis, or a group of cases with swept keys."""

from __future__ import annotations

import copy
import json
import os
import re
from collections.abc import Iterator, Mapping

from ..errors import ConfigError
from ..operators.stationarity import StationarityTransformer
from . import selectors
from .layout import LagConfiguration

SEPARATORS = ("->", "|", ",", ":")
EFFECT, CAUSE, RULE = ("effect", "output", "target"), ("cause", "predictor", "input"), ("rule", "value", "zero", "min_abs_sum", "force_abs_sum")


def read(path: str):
    """A JSON or YAML file's content."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.lower().endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e


def relations(spec, base: str = ".") -> dict[tuple[str, str], object] | None:
    """(effect, cause) -> rule, from a mapping with keys such as "y->x", a list of entries, or a file of either."""
    if spec is None:
        return None
    if isinstance(spec, Mapping) and set(spec) == {"path"}:
        spec = spec["path"]
    if isinstance(spec, str):
        spec = read(spec if os.path.isabs(spec) else os.path.join(base, spec))
    out: dict[tuple[str, str], object] = {}
    if isinstance(spec, Mapping):
        for k, v in spec.items():
            if isinstance(k, tuple):
                out[k] = v
                continue
            sep = next((s for s in SEPARATORS if s in k), None)
            if sep is None:
                raise ConfigError(f"{k!r} names no pair")
            effect, cause = (x.strip() for x in k.split(sep, 1))
            out[effect, cause] = v
        return out
    for entry in spec:
        pick = lambda names, e=entry: next((e[n] for n in names if n in e), None)
        effect, cause = pick(EFFECT), pick(CAUSE)
        key = next((k for k in RULE if k in entry), None)
        if effect is None or cause is None or key is None:
            raise ConfigError(f"{entry!r} is no relation")
        out[effect, cause] = None if key == "zero" and entry[key] else entry[key]
    return out


def lag_config(spec) -> LagConfiguration:
    if spec is None or isinstance(spec, LagConfiguration):
        return spec or LagConfiguration()
    spec = dict(spec)
    spec["custom_lags"] = {k: tuple(v) if isinstance(v, list | tuple) else (v,) for k, v in (spec.get("custom_lags") or {}).items()}
    pairs = spec.get("custom_pair_lags") or {}
    pairs = {tuple(k.split("->")) if isinstance(k, str) else k: v for k, v in pairs.items()}
    spec["custom_pair_lags"] = {tuple(x.strip() for x in k): tuple(v) if isinstance(v, list | tuple) else (v,) for k, v in pairs.items()}
    try:
        return LagConfiguration(**spec)
    except TypeError as e:
        raise ConfigError(str(e)) from e


def selector(spec, lags: LagConfiguration):
    if spec is None or hasattr(spec, "select"):
        return spec
    spec = {"type": spec} if isinstance(spec, str) else dict(spec)
    kind = str(spec.pop("type", spec.pop("name", "ic"))).lower()
    params = {"max_lag": lags.max_lag, "use_lag_zero": lags.use_lag_zero} | dict(spec.pop("params", {})) | spec
    if kind in ("ic", "iclagselector", "aic", "bic"):
        return selectors.ICLagSelector(**params | ({"use_bic": True} if kind == "bic" else {}))
    if kind in ("cv", "cross_validation", "cvlagselector"):
        return selectors.CVLagSelector(**params)
    if kind in ("var", "varlagselector"):
        return selectors.VARLagSelector(**params)
    raise ConfigError(f"no lag selector {kind!r}")


def normalised(raw: Mapping, base: str = ".") -> dict:
    """Arguments of a fit (and backend, reuse_data, data) from a raw configuration."""
    cfg = dict(raw)
    backend = cfg.pop("backend", None)
    if isinstance(backend, Mapping):
        cfg["model_config"] = dict(backend.get("params", {})) | dict(cfg.get("model_config") or {})
        backend = backend.get("type", backend.get("name"))
    cfg["backend"] = backend
    device = cfg.pop("device", None)
    if device is not None:
        if not re.fullmatch(r"auto|cpu|cpu-only|gpu|cuda(:\d+)?", str(device)):
            raise ConfigError(f"no device {device!r}")
        cfg["model_config"] = dict(cfg.get("model_config") or {}) | {"device": device}
    cfg["lag_config"] = lag_config(cfg.get("lag_config"))
    cfg["lag_selector"] = selector(cfg.get("lag_selector"), cfg["lag_config"])
    if "relations" in cfg:
        cfg["relations"] = relations(cfg["relations"], base)
    t = cfg.get("stationarity_transformer")
    if isinstance(t, Mapping):
        cfg["stationarity_transformer"] = StationarityTransformer(**t)
    if isinstance(cfg.get("initializer"), Mapping):
        cfg["initializer"] = cfg["initializer"].get("type", cfg["initializer"].get("name"))
    for k in ("causes", "effects", "tested_causes"):
        if isinstance(cfg.get(k), str):
            cfg[k] = [cfg[k]]
    return cfg


def dotted(cfg: dict, key: str, value) -> None:
    """Sets cfg["a"]["b"] for "a.b"; only mappings can be entered."""
    *path, last = key.split(".")
    for p in path:
        cfg = cfg.setdefault(p, {}) if cfg.get(p) is not None else cfg.update({p: {}}) or cfg[p]
        if not isinstance(cfg, dict):
            raise ConfigError(f"{key}: {p} is no mapping")
    cfg[last] = value


def cases(group: Mapping) -> Iterator[tuple[dict, dict]]:
    """(raw configuration, swept values) of each case: explicit cases, not a product; base keys win over the group's."""
    shared = {k: v for k, v in group.items() if k not in ("base_config", "sweep")} | dict(group.get("base_config") or {})
    sweep = group.get("sweep") or {}
    names, rows = list(sweep.get("param_names") or ()), list(sweep.get("cases") or [[]])
    for row in rows:
        row = row if isinstance(row, list | tuple) else [row]
        if len(row) != len(names):
            raise ConfigError(f"a case has {len(row)} values for {len(names)} parameters")
        cfg = copy.deepcopy(shared)
        for k, v in zip(names, row, strict=True):
            dotted(cfg, k, v)
        yield cfg, dict(zip(names, row, strict=True))
