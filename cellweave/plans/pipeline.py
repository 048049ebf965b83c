"""Declarative pipelines and the search over them.

A pipeline config is {"type", "desc", "pipeline": [...]}; an element has type, target,
scope, params and may be skipped. A planner config adds include, exclude, skippable and
params_to_tune, and yields a search space and concrete configs.
"""

from __future__ import annotations

import copy
import importlib
import inspect
import itertools
import json
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

from ..registry import REGISTRY, resolve

SKIP = "_skip_"
MODES = ("pipeline", "params")


def load_config(path: str | Path) -> dict:
    """A JSON or YAML file as a dictionary."""
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def dump_config(config: dict, path: str | Path, exists: str = "warn") -> None:
    """Write a config; an existing file is kept as told: none overwrites, warn says so, error raises."""
    path = Path(path)
    if path.exists():
        if exists == "error":
            raise FileExistsError(path)
        if exists == "warn":
            import warnings

            warnings.warn(f"{path} is overwritten", stacklevel=2)
    if path.suffix == ".json":
        path.write_text(json.dumps(config, indent=2))
    else:
        import yaml

        path.write_text(yaml.safe_dump(config, sort_keys=False))


# Packages whose functions a config may name by scope; more are allowed by adding to the set.
ALLOWED_MODULES = {"cellweave"}


def named(target: str, scope: str) -> Callable:
    """A registered callable, or one of a module of the allowed packages."""
    if scope.startswith("_registry_"):
        return resolve(target, scope)
    if not any(scope == m or scope.startswith(f"{m}.") for m in ALLOWED_MODULES):
        raise PermissionError(f"configs may not import {scope!r}; add its package to ALLOWED_MODULES")
    return getattr(importlib.import_module(scope), target)


class Action:
    """One element: a registered (or imported) callable with parameters."""

    KEYS = ("type", "desc", "target", "scope", "params")

    def __init__(self, type: str | None = None, target: str | None = None, scope: str | None = None, params: dict | None = None, desc: str | None = None):  # noqa: A002
        self.type, self.target, self.desc, self.params = type, target, desc, dict(params or {})
        self.scope = scope or (f"_registry_.{self.full_type}" if type else "_registry_")

    @property
    def full_type(self) -> str:
        t = self.type or ""
        return t if t.startswith(("preprocessor", "metric", "dataset")) or not t else f"preprocessor.{t}"

    @property
    def skipped(self) -> bool:
        return self.target in (None, SKIP)

    @property
    def functional(self) -> Callable:
        if self.skipped:
            return lambda frame: frame
        found = named(self.target, self.scope)
        return lambda frame: found(frame, **self.params)

    def __call__(self, frame: Any) -> Any:
        return self.functional(frame)

    def to_dict(self) -> dict:
        return {k: v for k in self.KEYS if (v := getattr(self, k)) not in (None, {}) and not (k == "scope" and str(v).startswith("_registry_"))}

    def __repr__(self) -> str:
        return f"Action({', '.join(f'{k}={v!r}' for k, v in self.to_dict().items())})"


class Pipeline:
    """Elements called one after another; elements may be pipelines. Skipped ones do nothing."""

    def __init__(self, config: dict):
        if "pipeline" in config and config.get("params"):
            raise KeyError("an element has either params or a pipeline")
        self.type, self.desc = config.get("type"), config.get("desc")
        self.elements: list[Action | Pipeline] = []
        for item in config["pipeline"]:
            if "pipeline" in item:
                self.elements.append(Pipeline({**item, "type": item.get("type", self.type)}))
            else:
                known = {k: v for k, v in item.items() if k in Action.KEYS}
                self.elements.append(Action(**{**known, "type": known.get("type", self.type)}))

    def __iter__(self) -> Iterator:
        return (e for e in self.elements if not (isinstance(e, Action) and e.skipped))

    def __len__(self) -> int:
        return len(self.elements)

    def __getitem__(self, k: int) -> Any:
        return self.elements[k]

    def __call__(self, frame: Any) -> Any:
        for e in self:
            frame = e(frame)
        return frame

    def to_dict(self) -> dict:
        out = {"type": self.type, "desc": self.desc, "pipeline": [e.to_dict() for e in self.elements]}
        return {k: v for k, v in out.items() if v is not None}


class PipelinePlanner:
    """Candidate targets or parameters of each element, and configs made of choices."""

    def __init__(self, config: dict):
        self.mode = config.get("tune_mode", "pipeline")
        if self.mode not in (*MODES, "pipeline_params"):
            raise ValueError(f"unknown mode {self.mode!r}")
        self.config = copy.deepcopy(config)
        self.items = self.config["pipeline"]

    def candidates(self, k: int) -> list[str] | None:
        """Targets that element k may take; None if it is fixed."""
        item = self.items[k]
        if item.get("target"):
            return None
        scope = Action(type=item["type"]).full_type
        names = sorted(x.rpartition(".")[2] for x in REGISTRY.children(scope))
        if (include := item.get("include")) is not None:
            if unknown := set(include) - set(names):
                raise ValueError(f"unknown targets {sorted(unknown)} in {scope}")
            names = [n for n in names if n in include]
        names = [n for n in names if n not in item.get("exclude", ())]
        return names + [SKIP] if item.get("skippable") else names

    def search_space(self) -> dict[str, dict]:
        """{key: {"values": [...]} or a range}: what there is to choose."""
        space: dict[str, dict] = {}
        for k, item in enumerate(self.items):
            if self.mode != "params":
                found = self.candidates(k)
                if found:
                    space[f"pipeline.{k}.{item['type']}"] = {"values": found}
            if self.mode == "params":
                for name, spec in (item.get("params_to_tune") or {}).items():
                    space[f"params.{k}.{item['target']}.{name}"] = spec
        return space

    def generate(self, pipeline: list | dict | None = None, params: list | dict | None = None) -> dict:
        """A concrete config: defaults of the target, then given parameters, checked against the signature."""
        pick = lambda given, k: None if given is None else given[k] if isinstance(given, list) else given.get(str(k), given.get(k))
        for given in (pipeline, params):
            if isinstance(given, list) and len(given) != len(self.items):
                raise ValueError(f"{len(self.items)} choices are needed, not {len(given)}")
        out = []
        for k, item in enumerate(self.items):
            target = item.get("target") or pick(pipeline, k)
            if target is None:
                raise ValueError(f"element {k} has no target")
            allowed = self.candidates(k)
            if allowed is not None and target not in allowed:
                raise ValueError(f"{target!r} is not a candidate of element {k}: {allowed}")
            made = {key: item[key] for key in ("type", "scope", "desc") if key in item} | {"target": target}
            if target != SKIP:
                values = {**item.get("params", {}), **(item.get("default_params", {}).get(target) or {}), **(pick(params, k) or {})}
                self.check(Action(**{**made, "params": values}))
                if values:
                    made["params"] = values
            out.append(made)
        return {key: v for key, v in self.config.items() if key in ("type", "desc")} | {"pipeline": out}

    @staticmethod
    def check(action: Action) -> None:
        found = named(action.target, action.scope)
        names = inspect.signature(found).parameters
        if any(p.kind is inspect.Parameter.VAR_KEYWORD for p in names.values()):
            return
        if unknown := set(action.params) - set(names):
            raise ValueError(f"{action.target} has no parameters {sorted(unknown)}")

    def grid(self) -> Iterator[dict]:
        """All configs of a finite search space."""
        space = self.search_space()
        keys = list(space)
        for choice in itertools.product(*(space[k]["values"] for k in keys)):
            targets: dict[int, str] = {}
            params: dict[int, dict] = {}
            for key, value in zip(keys, choice):
                kind, k, *rest = key.split(".")
                if kind == "pipeline":
                    targets[int(k)] = value
                else:
                    params.setdefault(int(k), {})[rest[-1]] = value
            yield self.generate(targets, params)

    def run(self, frame: Any, score: Callable[[Any], float], higher: bool = True) -> list[tuple[float, dict]]:
        """Every config applied and scored, best first; the local stand-in for a sweep service."""
        found = [(score(Pipeline(c)(frame)), c) for c in self.grid()]
        return sorted(found, key=lambda r: -r[0] if higher else r[0])


def flatten(nested: dict, prefix: str = "") -> dict:
    """Nested dictionaries and lists as one level with dotted keys."""
    out = {}
    for key, value in nested.items() if isinstance(nested, dict) else enumerate(nested):
        name = f"{prefix}.{key}" if prefix else str(key)
        out |= flatten(value, name) if isinstance(value, (dict, list)) and value else {name: value}
    return out


def subsets(config: dict, required: tuple[int, ...] = (), least: int = 1) -> list[dict]:
    """Pipelines of all ordered subsets of the elements that hold the required ones."""
    items = config["pipeline"]
    picks = (c for n in range(least, len(items) + 1) for c in itertools.combinations(range(len(items)), n))
    return [{**config, "pipeline": [copy.deepcopy(items[k]) for k in c]} for c in picks if set(required) <= set(c)]


def top_configs(results: list[dict], metric: str, k: int, higher: bool = True) -> list[dict]:
    """The k best result rows; rows without the metric are left out, ties keep their order."""
    rows = [r for r in results if r.get(metric) is not None and r[metric] == r[metric]]
    return sorted(rows, key=lambda r: -r[metric] if higher else r[metric])[:k]


def tuning_configs(results: list[dict], planner: dict, metric: str, k: int, params: dict[str, dict], higher: bool = True) -> list[dict]:
    """Planner configs of mode params for the k best pipelines; params maps a target to what to tune."""
    out = []
    for row in top_configs(results, metric, k, higher):
        items = [{**item, "params_to_tune": params.get(item["target"], {})} for item in row["pipeline"] if item.get("target") != SKIP]
        out.append({**{key: v for key, v in planner.items() if key != "pipeline"}, "tune_mode": "params", "pipeline": items})
    return out
