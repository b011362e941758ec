"""Configuration files: what the engine assumes, not what it measures."""

from __future__ import annotations

import json
import tomllib
from functools import lru_cache
from importlib.resources import files
from pathlib import Path


def parse(text: str, name: str) -> dict:
    """A TOML, JSON or YAML text by the ending of its name; YAML needs its library to be installed."""
    ending = name.rsplit(".", 1)[-1].lower()
    if ending == "toml":
        return tomllib.loads(text)
    if ending == "json":
        return json.loads(text)
    if ending in ("yml", "yaml"):
        import yaml

        return yaml.safe_load(text) or {}
    raise ValueError(f"{name}: not a TOML, JSON or YAML file")


def load(path: str | Path) -> dict:
    return parse(Path(path).read_text(), str(path))


@lru_cache
def default(name: str) -> dict:
    """A file of this package, such as ``estimation``."""
    return parse(files(__package__).joinpath(f"{name}.toml").read_text(), f"{name}.toml")
