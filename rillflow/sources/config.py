"""TOML configuration with dotted paths.

``Config(path).get("Section.Sub", "name", int)``: empty segments of a path are
skipped; an integer may be read as float, not a float as integer; one wrong
element fails a whole list.  A missing or ill-formed file gives a config that
has not succeeded and whose every read is None.
"""

from __future__ import annotations

import logging
import tomllib
from typing import Any

log = logging.getLogger("rillflow")


class Config:
    def __init__(self, path: str):
        self._node: dict | None = None
        try:
            with open(path, "rb") as f:
                self._root: dict | None = tomllib.load(f)
        except (OSError, tomllib.TOMLDecodeError) as e:
            log.critical("configuration %s: %s", path, e)
            self._root = None
        self._node = self._root

    @property
    def succeed(self) -> bool:
        return self._root is not None

    @property
    def exists(self) -> bool:
        """Whether the working table is there."""
        return self._node is not None

    def items(self) -> dict[str, Any]:
        """What the working table holds, as it is."""
        return dict(self._node or {})

    def at(self, path: str = "") -> Config:
        """The config with another working table, from the root; a path that isn't a table reads None everywhere."""
        out = object.__new__(Config)
        node: Any = self._root
        for part in filter(None, path.split(".")):
            node = node.get(part) if isinstance(node, dict) else None
        out._root, out._node = self._root, node if isinstance(node, dict) else None
        return out

    def get(self, name: str, kind: type, log_errors: bool = True) -> Any:
        """A scalar (int, float, bool, str), list[int], list[float], list[str], or list (as it is); None if it is missing or of another type."""
        value = (self._node or {}).get(name)
        out = None
        if kind is list:
            out = value if isinstance(value, list) else None
        elif getattr(kind, "__origin__", None) is list:
            if isinstance(value, list):
                each = [_scalar(v, kind.__args__[0]) for v in value]
                out = None if any(v is None for v in each) else each
        else:
            out = _scalar(value, kind)
        if out is None and log_errors:
            log.error("configuration: no %s of type %s", name, kind)
        return out


def _scalar(v: Any, kind: type) -> Any:
    if kind is float and isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v if isinstance(v, kind) and (kind is bool or not isinstance(v, bool)) else None
