"""Registry of transforms, metrics, statistics and data sets under dotted scopes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

LEAF = "_leaf"


class Registry:
    """A tree addressed by dotted keys."""

    def __init__(self) -> None:
        self.tree: dict[str, Any] = {}

    def set(self, key: str, value: Any, overwrite: bool = False) -> None:
        *path, name = key.split(".")
        node = self.tree
        for part in path:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise KeyError(f"{part!r} in {key!r} is a leaf")
        if name in node and node[name] is not value and not overwrite:
            raise KeyError(f"{key!r} is registered already")
        node[name] = value

    def get(self, key: str, default: Any = KeyError) -> Any:
        node: Any = self.tree
        for part in key.split("."):
            if not isinstance(node, dict) or part not in node:
                if default is KeyError:
                    raise KeyError(f"{key!r} is not registered")
                return default
            node = node[part]
        return node

    def children(self, key: str = "", leaf_only: bool = True) -> Iterator[str]:
        """Keys below a key, depth first; a leaf has none and raises KeyError."""
        node = self.get(key) if key else self.tree
        if not isinstance(node, dict):
            raise KeyError(f"{key!r} is a leaf")
        for name, value in node.items():
            full = f"{key}.{name}" if key else name
            if isinstance(value, dict):
                if not leaf_only:
                    yield full
                yield from self.children(full, leaf_only)
            else:
                yield full


REGISTRY = Registry()


def register(scope: str, name: str | None = None, overwrite: bool = False) -> Callable:
    """Decorator: put a callable under a scope, as its own or another name."""

    def put(f: Callable) -> Callable:
        REGISTRY.set(f"{scope}.{name or f.__name__}", f, overwrite)
        return f

    return put


def resolve(name: str, scope: str) -> Callable:
    return REGISTRY.get(f"{scope.removeprefix('_registry_.')}.{name}")
