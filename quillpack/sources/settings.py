"""Settings from JSON files, laid over each other: system, user, project. Read on the driver."""

from __future__ import annotations

import json
import os
import re
from dataclasses import fields
from pathlib import Path

from ..functions.text import parse_size
from ..model import Settings

MAX_BYTES = 4 << 20
FOLDER, FILE = ".quillpack", "config.json"
_TOKENS = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.DOTALL)


def read_json(text: str) -> dict:
    """JSON with comments and trailing commas."""
    bare = _TOKENS.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    strings = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])')
    return json.loads(strings.sub(lambda m: m[0] if m[0][0] == '"' else "", bare))


def load_file(path: str | Path) -> dict:
    """The settings in one file; {} if there is none."""
    path = Path(path)
    if not path.is_file():
        return {}
    if path.stat().st_size > MAX_BYTES:
        raise ValueError(f"{path} has more than {MAX_BYTES} bytes")
    got = read_json(path.read_text("utf-8-sig"))
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no object")
    return got


def project_file(start: str | Path) -> Path | None:
    """The nearest settings file at or above start, up to the root of its git repository."""
    for folder in (Path(start).resolve(), *Path(start).resolve().parents):
        if (folder / FOLDER / FILE).is_file():
            return folder / FOLDER / FILE
        if (folder / ".git").exists():
            return None
    return None


def layers(start: str | Path = ".", system: str | Path = "/etc/quillpack") -> list[dict]:
    """Settings of the system, the user and the project, in the order in which later ones win."""
    user = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "quillpack" / FILE
    found = project_file(start)
    return [load_file(Path(system) / FILE), load_file(user), load_file(found) if found else {}]


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def merge(settings: Settings, layer: dict) -> Settings:
    """settings with what layer gives (null counts as not given). Lists replace, languages overwrite each other by key, presets unite their extensions."""
    known = {f.name for f in fields(Settings)}
    changes = {}
    for raw, value in layer.items():
        name = _snake(raw)
        if value is None or name not in known or (name == "max_files" and not value > 0):
            continue
        if name == "presets":
            value = settings.presets | {k: tuple(dict.fromkeys((*settings.presets.get(k, ()), *v))) for k, v in value.items()}
        elif name == "languages":
            value = settings.languages | {k.lower(): v for k, v in value.items()}
        elif isinstance(value, list):
            value = tuple(value)
        changes[name] = value
    return settings.but(**changes)


def load(start: str | Path = ".", system: str | Path = "/etc/quillpack") -> Settings:
    out = Settings()
    for layer in layers(start, system):
        out = merge(out, layer)
    return out


def validate(settings: Settings) -> list[tuple[str, str]]:
    """(severity, message) of all that is wrong ('error') or odd ('warning')."""
    out: list[tuple[str, str]] = []
    for name in ("max_file_size", "max_clipboard_size", "max_output"):
        try:
            if parse_size(getattr(settings, name)) <= 0:
                out.append(("error", f"{name} must be above 0"))
        except ValueError:
            out.append(("error", f"{name} is no size: {getattr(settings, name)!r}"))
    if settings.max_files <= 0:
        out.append(("error", "max_files must be above 0"))
    if settings.discovery not in ("auto", "git", "filesystem"):
        out.append(("error", f"discovery is none of auto, git, filesystem: {settings.discovery!r}"))
    if settings.max_depth is not None and settings.max_depth < 0:
        out.append(("error", "max_depth must not be below 0"))
    if not 1 <= settings.cluster_depth <= 20:
        out.append(("error", "cluster_depth must be from 1 to 20"))
    if "{path}" not in settings.header:
        out.append(("warning", "header names no {path}"))
    if not re.fullmatch("`{3,}|~{3,}", settings.fence):
        out.append(("error", f"fence is no Markdown fence: {settings.fence!r}"))
    for name, extensions in settings.presets.items():
        if not extensions:
            out.append(("warning", f"preset {name} has no extensions"))
    for name in ("system_ignore", "exclude_path", "include_path"):
        if any(not p.strip() for p in getattr(settings, name)):
            out.append(("warning", f"{name} has an empty pattern"))
    return out


def dump(settings: Settings) -> str:
    return json.dumps({f.name: getattr(settings, f.name) for f in fields(Settings)}, indent=2)


def schema() -> dict:
    """A JSON schema of the settings file."""
    kinds = {str: "string", int: "integer", bool: "boolean", tuple: "array", dict: "object"}
    described = {f.name: {"type": kinds.get(type(getattr(Settings(), f.name)), "integer")} for f in fields(Settings)}
    return {"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "additionalProperties": False, "properties": described}


def init(folder: str | Path = ".") -> Path:
    """A new settings file with the defaults; one that is there stays."""
    path = Path(folder) / FOLDER / FILE
    path.parent.mkdir(parents=True, exist_ok=True)
    if not path.exists():
        path.write_text(dump(Settings()) + "\n")
    return path
