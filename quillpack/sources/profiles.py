"""Saved arguments: named profiles, and defaults of directories. Two JSON maps in the user's settings folder."""

from __future__ import annotations

import json
import os
from pathlib import Path

from ..operators.sinks import write_atomic

PROFILES, DEFAULTS = "profiles.json", "defaults.json"


def folder() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "quillpack"


def read(kind: str) -> dict[str, list[str]]:
    """All of a kind; a missing or damaged file has none."""
    try:
        got = json.loads((folder() / kind).read_text("utf-8"))
    except (OSError, ValueError):
        return {}
    return {str(k): [str(x) for x in v] for k, v in got.items() if isinstance(v, list)} if isinstance(got, dict) else {}


def _key(kind: str, name: str) -> str:
    return name.lower() if kind == PROFILES else os.path.abspath(name)


def save(kind: str, name: str, arguments: list[str]) -> None:
    write_atomic(str(folder() / kind), json.dumps(read(kind) | {_key(kind, name): list(arguments)}, indent=2) + "\n")


def load(kind: str, name: str) -> list[str] | None:
    """The arguments saved under that name (profiles: in any case), None if there are none."""
    return read(kind).get(_key(kind, name))
