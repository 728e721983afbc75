"""Options of a run: defaults, then a mapping (such as a parsed file), then --key=value arguments; never executed as code."""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence


def literal(text: str):
    """A Python literal, or the text itself."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def override(defaults: Mapping, settings: Mapping, arguments: Sequence[str] = ()) -> dict:
    """The defaults with overrides. An unknown key or another type is an error."""
    out = dict(defaults)

    def put(key: str, value) -> None:
        if key not in out:
            raise KeyError(f"unknown option: {key}")
        if type(value) is not type(out[key]) and not (isinstance(out[key], float) and type(value) is int):
            raise TypeError(f"{key} is a {type(out[key]).__name__}, not a {type(value).__name__}")
        out[key] = type(out[key])(value)

    for key, value in settings.items():
        put(key, value)
    for a in arguments:
        key, eq, value = a.removeprefix("--").partition("=")
        if not a.startswith("--") or not eq:
            raise ValueError(f"not --key=value: {a}")
        put(key, literal(value))
    return out
