"""Nested options with defaults, kept as JSON."""

from __future__ import annotations

import json
from copy import deepcopy
from typing import Any

Options = dict[str, Any]


def merged(defaults: Options, given: Options) -> Options:
    """defaults with what is given in place; unknown names and values of another kind raise."""
    out = deepcopy(defaults)
    for name, value in given.items():
        if name not in out:
            raise ValueError(f"no option {name}")
        if isinstance(out[name], dict):
            out[name] = merged(out[name], value)
        elif out[name] is not None and not isinstance(value, (type(out[name]), *((int,) if isinstance(out[name], float) else ()))):
            raise ValueError(f"option {name} is a {type(out[name]).__name__}")
        else:
            out[name] = value
    return out


def load(path: str, defaults: Options) -> Options:
    with open(path, encoding="utf-8") as f:
        return merged(defaults, json.load(f))


def save(path: str, options: Options) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(options, f, indent=2, sort_keys=True)
