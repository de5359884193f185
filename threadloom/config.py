"""Local configuration (TOML): where the archive lies, which documents are made, which embedding service is used.

An unknown section or field is an error, so a misspelt one is never ignored.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass


class ConfigError(ValueError):
    """A configuration that can't be read."""


@dataclass(frozen=True)
class Documents:
    recipe: str = "discussion_enriched"


@dataclass(frozen=True)
class Embeddings:
    endpoint: str = ""
    model: str = ""
    dimensions: int | None = None
    max_input_bytes: int = 7_000
    max_batch_input_bytes: int = 250_000
    batch_size: int = 64


@dataclass(frozen=True)
class ArchivePlace:
    path: str = ""


@dataclass(frozen=True)
class Config:
    archive: ArchivePlace = field(default_factory=ArchivePlace)
    documents: Documents = field(default_factory=Documents)
    embeddings: Embeddings = field(default_factory=Embeddings)


def _read(kind, values: dict, at: str):
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ConfigError(f"unknown field {at}{unknown[0]}")
    out = {}
    for name, value in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else known[name].default
        if is_dataclass(default):
            if not isinstance(value, dict):
                raise ConfigError(f"{at}{name} is no section")
            out[name] = _read(type(default), value, f"{at}{name}.")
        elif default is not None and type(value) is not type(default) or default is None and type(value) is not int:
            raise ConfigError(f"{at}{name} has the wrong type")
        else:
            out[name] = value
    return kind(**out)


def parse(text: str) -> Config:
    try:
        values = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    return _read(Config, values, "")
