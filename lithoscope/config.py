"""Configuration: command line over environment over file over defaults."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path

FILE = "lithoscope.config.json"
PREFIX = "LITHOSCOPE_"


@dataclass(frozen=True)
class Config:
    repo_root: str = "."
    output_dir: str = "storage"
    max_files: int = 50_000
    max_bytes: int = 2_000_000_000
    clock_iso: str | None = None
    print_paths: bool = False


def typed(name: str, value):
    default = {f.name: f.default for f in fields(Config)}[name]
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes")
    return int(value) if isinstance(default, int) else value


def merged(cli: dict | None = None, env: dict | None = None, file: str | Path | None = None) -> Config:
    """The first of command line, environment, file and default that gives a value. Unknown names in the file fail."""
    env = os.environ if env is None else env
    path = Path(file or FILE)
    stored = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    names = {f.name for f in fields(Config)}
    if unknown := stored.keys() - names:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = {}
    for name in names:
        for value in ((cli or {}).get(name), env.get(PREFIX + name.upper()), stored.get(name)):
            if value is not None:
                out[name] = typed(name, value)
                break
    return Config(**out)


def create(folder: str | Path, config: Config = Config(), force: bool = False) -> Path:
    """The configuration file, with paths relative to its folder; an existing one stays unless forced."""
    path = Path(folder) / FILE
    if path.exists() and not force:
        raise FileExistsError(path)
    values = {k: v for k, v in asdict(config).items() if v is not None}
    for name in ("repo_root", "output_dir"):
        values[name] = os.path.relpath(values[name], folder) if os.path.isabs(values[name]) else values[name]
    path.write_text(json.dumps(values, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return path
