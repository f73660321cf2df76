"""JSON with // comments, and access with checks that name what is there."""

from __future__ import annotations

import json
from typing import Any

from ..errors import ConfigError


def stripped(text: str) -> str:
    """Without // comments outside strings."""
    out = []
    for line in text.split("\n"):
        inside, at = False, 0
        while at < len(line):
            c = line[at]
            if inside and c == "\\":
                at += 2
                continue
            if c == '"':
                inside = not inside
            elif not inside and line.startswith("//", at):
                line = line[:at]
                break
            at += 1
        out.append(line)
    return "\n".join(out)


def parse(text: str) -> Config:
    try:
        return Config(json.loads(stripped(text)))
    except json.JSONDecodeError as e:
        raise ConfigError("config", f"line {e.lineno}: {e.msg}") from e


class Config:
    """A view into a tree of settings that knows its path."""

    def __init__(self, value: Any, path: str = ""):
        self.value, self.path = value, path

    def has(self, key: str) -> bool:
        return isinstance(self.value, dict) and key in self.value

    def __getitem__(self, key: str) -> Config:
        if not isinstance(self.value, dict):
            raise ConfigError("config", f"{self.path or 'the root'} is not an object")
        if key not in self.value:
            raise ConfigError("config", f"no {key} in {self.path or 'the root'}", f"there are {sorted(self.value)}")
        return Config(self.value[key], f"{self.path}.{key}" if self.path else key)

    def get(self, key: str, kind: type, default: Any = None) -> Any:
        """A value of a kind; without a default it must be there."""
        if not self.has(key) and default is not None:
            return default
        got = self[key].value
        if kind is float and isinstance(got, int) and not isinstance(got, bool):
            got = float(got)
        if not isinstance(got, kind) or (kind in (int, float) and isinstance(got, bool)):
            raise ConfigError("config", f"{self[key].path} is not a {kind.__name__}: {got!r}")
        return got
