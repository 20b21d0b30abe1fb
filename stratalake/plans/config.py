"""Configuration of a lake: files, environment, arguments; and its refusals."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml

from stratalake.sources import files


class ConfigError(Exception):
    exit_code = 64


@dataclass
class Config:
    layers: list[str] = field(default_factory=list)
    schema: str = "lake"
    database: str = "lake"
    base: str | None = None
    write: str | None = None
    writeFormat: str = "json"
    writable: bool = True
    materialize: bool = False
    lazy: bool = False
    store: str | None = None
    storeMode: str | None = None
    compress: bool = False
    sortSmallTables: bool = False
    checkKeys: bool = True
    serializeTransactions: bool = False
    deriveIds: bool = False
    defaultKey: list[str] = field(default_factory=list)
    dacpac: str | None = None
    cache: str | None = None
    sessionVariables: dict = field(default_factory=dict)
    columns: list[dict] = field(default_factory=list)
    tables: dict[str, dict] = field(default_factory=dict)
    # of the wire doors, which this library does not open; read so that a shared file is accepted
    listen: str | None = None
    tds: str | None = None
    tdsPacketSize: int = 4096
    installDuckDb: bool = False

    def validate(self) -> Config:
        if not 512 <= int(self.tdsPacketSize) <= 32767:
            raise ConfigError("tdsPacketSize is outside 512..32767")
        self.layers = [files.plain(x) for x in self.layers]
        for name in ("base", "write", "store", "dacpac", "cache"):
            if p := getattr(self, name):
                setattr(self, name, files.plain(p))
        for layer in self.layers:
            if not files.is_dir(layer):
                raise ConfigError(f"layer {layer} is not a directory")
        for name in ("dacpac", "base"):
            if (p := getattr(self, name)) and not os.path.exists(p):
                raise ConfigError(f"{name} {p} does not exist")
        if self.base and self.layers:
            raise ConfigError("base and layers cannot stand together")
        if self.store and not self.materialize:
            raise ConfigError("store needs materialize")
        if self.lazy and not self.materialize:
            raise ConfigError("lazy needs materialize")
        if self.storeMode and not self.store:
            raise ConfigError("storeMode needs store")
        for name in ("base", "store"):
            if (p := getattr(self, name)) and Path(p).stem.lower() == self.schema.lower():
                raise ConfigError(f"{name} {p} is named like the schema")
        dynamic = [n for n, t in self.tables.items() if t.get("filter")] + [c["name"] for c in self.columns if "getvariable" in str(c.get("expr", "")).lower()]
        dynamic += [f"{n}.{c['name']}" for n, t in self.tables.items() for c in t.get("columns") or [] if "getvariable" in str(c.get("expr", "")).lower()]
        if (self.materialize or self.base) and dynamic:
            raise ConfigError(f"{dynamic[0]} depends on the session and cannot be materialized")
        if self.cache and any(Path(self.cache).resolve().is_relative_to(Path(x).resolve()) for x in self.layers):
            raise ConfigError("the cache lies inside a layer")
        return self


def _lists(d: dict) -> dict:
    for k in ("layers", "defaultKey"):
        if isinstance(d.get(k), str):
            d[k] = [d[k]]
    return d


def load(path: str | None = None, env: dict[str, str] | None = None, defaults: list[str] = (), **arguments) -> Config:
    """Lowest first: machine and user files (`defaults`), LAKE_ variables (`__` nests), the named file, arguments."""
    merged: dict = {}

    def add(data: dict, base: Path | None) -> None:
        data = _lists(dict(data or {}))
        if base:
            for k in ("base", "write", "store", "dacpac", "cache"):
                if isinstance(data.get(k), str):
                    data[k] = str(base / data[k])
            if "layers" in data:
                data["layers"] = [x if "://" in x else str(base / x) for x in data["layers"]]
        merged.update(data)

    for p in defaults:
        if os.path.exists(p):
            add(yaml.safe_load(Path(p).read_text()), Path(p).parent)
    nested: dict = {}
    known = {f.name.lower(): f.name for f in fields(Config)}
    for k, v in (os.environ if env is None else env).items():
        if k.startswith("LAKE_"):
            parts, at = k[5:].split("__"), nested
            for x in parts[:-1]:
                at = at.setdefault(known.get(x.lower(), x), {})
            at[known.get(parts[-1].lower(), parts[-1])] = yaml.safe_load(v)
    add(nested, None)
    if path:
        if not os.path.exists(path):
            raise ConfigError(f"{path} does not exist")
        add(yaml.safe_load(Path(path).read_text()), Path(path).parent)
    add({k: v for k, v in arguments.items() if v is not None}, None)
    unknown = set(merged) - {f.name for f in fields(Config)}
    if unknown:
        raise ConfigError(f"unknown setting {sorted(unknown)[0]}")
    return Config(**merged).validate()
