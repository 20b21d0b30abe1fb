"""Layers: directories of YAML, JSON and Parquet files found and read as tables.

File names are walked on the driver, without a job. Parquet is scanned by Spark in
place; YAML and JSON are small seed files, parsed on the driver into local relations.
"""

from __future__ import annotations

import json
import logging
import os
import re
import shutil
import uuid
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.operators import state
from stratalake.sources import files

log = logging.getLogger("stratalake")
FORMATS = ("parquet", "json", "yaml", "yml")


@dataclass
class Source:
    """One layer's part of a table."""

    table: str
    format: str
    paths: list[str]
    root: str  # partition columns are those between here and the file
    partitions: list[str] = field(default_factory=list)
    directory: bool = False
    keyed_by: str | None = None
    shape: T.StructType | None = None  # found once, so that later reads open no footers


def _pair(name: str) -> tuple[str, str] | None:
    k, eq, v = name.partition("=")
    return (k, v) if eq and k else None


def scan(layer: str) -> dict[str, Source]:
    """The tables of a layer: files and directories of Parquet, below any number of key=value directories."""
    found: dict[str, Source] = {}

    def add(s: Source) -> None:
        key = s.table.lower()
        old = found.get(key)
        if old is None:
            found[key] = s
        elif s.partitions and old.partitions == s.partitions and old.format == s.format:
            old.paths += s.paths
        else:
            log.warning("%s: %s is already read from %s; ignored", s.table, s.paths[0], old.paths[0])

    def walk(folder: str, parts: list[str]) -> None:
        held = files.listing(folder)
        names = [n for n, is_dir, _, _ in held if not n.startswith(".") and not is_dir]
        for kind in FORMATS:
            for n in names:
                if n.lower().endswith("." + kind):
                    add(Source(n[: -len(kind) - 1], kind, [f"{folder}/{n}"], layer, list(parts)))
            if kind == "parquet":
                # a directory named like a Parquet file is one
                for n in [n for n, is_dir, _, _ in held if is_dir and n.lower().endswith(".parquet")]:
                    add(Source(n[:-8], kind, [f"{folder}/{n}"], f"{folder}/{n}" if not parts else layer, list(parts), directory=True))
        for n in [n for n, is_dir, _, _ in held if is_dir and not n.startswith(".") and not n.lower().endswith(".parquet")]:
            path = f"{folder}/{n}"
            if pair := _pair(n):
                walk(path, [*parts, pair[0]])
                continue
            inner = sorted(p for p, _, _ in files.walk(path) if p.endswith(".parquet"))
            if inner:
                below = [q[0] for x in _between(path, inner[0]) if (q := _pair(x))]
                add(Source(n, "parquet", [path] if not parts else inner, path if not parts else layer, [*parts, *below], directory=True))

    layer = files.plain(layer).rstrip("/")
    walk(layer, [])
    return found


def _between(root: str, path: str) -> list[str]:
    """The directories between a root and a file."""
    return path[len(root.rstrip("/")) + 1 :].split("/")[:-1]


# ------------------------------------------------------------------ YAML and JSON
def scalar(node: yaml.ScalarNode):
    """Plain scalars are null, a boolean, a number or text; quoted ones are always text."""
    v = node.value
    if node.style is not None:
        return v
    if v in ("", "~", "null", "Null", "NULL"):
        return None
    if v in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return v.lower() == "true"
    if re.fullmatch(r"[-+]?\d+", v) and -(1 << 63) <= int(v) < 1 << 63:
        return int(v)
    if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", v):
        return float(v)
    return v


def _plain(node):
    if isinstance(node, yaml.MappingNode):
        return {k.value: _plain(v) for k, v in node.value}
    if isinstance(node, yaml.SequenceNode):
        return [_plain(v) for v in node.value]
    return scalar(node)


def _typed(text: str):
    """A JSON key read as the value its text spells."""
    return int(text) if re.fullmatch(r"-?\d+", text) and str(int(text)) == text else text


def load(path: str, key: str | None) -> tuple[list[dict], str | None]:
    """(rows, the key column if the file is a mapping of entries)."""
    raw = files.read_text(path)
    if path.endswith(".json"):
        data = json.loads(raw) if raw.strip() else []
        keys = {k: _typed(k) for k in data} if isinstance(data, dict) else {}
    else:
        node = yaml.compose(raw)
        data = _plain(node) if node is not None else []
        keys = {k.value: scalar(k) for k, _ in node.value} if isinstance(node, yaml.MappingNode) else {}
    if isinstance(data, list):
        return [r for r in data if isinstance(r, dict)], None
    if not isinstance(data, dict):
        raise ValueError(f"{path}: neither a list of rows nor a mapping")
    if data and key and all(isinstance(v, dict) for v in data.values()):
        return [{key: keys[k], **{c: x for c, x in v.items() if c.lower() != key.lower()}} for k, v in data.items()], key
    if len(data) == 1 and isinstance(next(iter(data.values())), list):
        log.warning("%s: one row with the single column %s; a list of rows stands at the root", path, next(iter(data)))
    elif data and all(isinstance(v, dict) for v in data.values()):
        log.warning("%s: a mapping of mappings without a single key column is read as one row", path)
    return [data], None


_seeds: dict[tuple, tuple[list[dict], str | None]] = {}


def _loaded(path: str, key: str | None) -> tuple[list[dict], str | None]:
    """A seed file parsed once for each of its versions; the latest version alone is kept."""
    mark = next(iter(files.walk(path)))
    if _seeds.get((path, key), (None,))[0] != mark:
        _seeds[path, key] = (mark, load(path, key))
    return _seeds[path, key][1]


def infer(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return T.StringType()
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {int}:
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    if kinds == {dict}:
        names = dict.fromkeys(k for v in values if v for k in v)
        return T.StructType([T.StructField(n, infer([v.get(n) for v in values if v])) for n in names])
    if kinds == {list}:
        return T.ArrayType(infer([x for v in values if v for x in v]))
    return T.StringType()


def fit(v, t: T.DataType):
    if v is None:
        return None
    if isinstance(t, T.DoubleType):
        return float(v)
    if isinstance(t, T.StructType):
        return tuple(fit(v.get(f.name), f.dataType) for f in t)
    if isinstance(t, T.ArrayType):
        return [fit(x, t.elementType) for x in v]
    if isinstance(t, T.StringType) and not isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    return v


def local(spark: SparkSession, rows: list[dict], partitions: dict[str, str] | None = None) -> DataFrame:
    rows = [{**r, **{k: _typed(v) for k, v in (partitions or {}).items()}} for r in rows]
    names: dict[str, str] = {}
    for r in rows:
        for k in r:
            names.setdefault(k.lower(), k)
    schema = T.StructType([T.StructField(n, infer([r.get(n) for r in rows])) for n in names.values()])
    return spark.createDataFrame([tuple(fit(r.get(f.name), f.dataType) for f in schema) for r in rows], schema)


def read(spark: SparkSession, s: Source, key: str | None) -> DataFrame:
    """The source's rows with its own partition columns and `_file`."""
    if s.format == "parquet":
        hidden = any(p.rsplit("/", 1)[-1].startswith("_") for p in s.paths)
        reader = spark.read.option("mergeSchema", "true")
        if not hidden:
            reader = reader.option("basePath", s.root if s.partitions or s.directory else s.paths[0].rsplit("/", 1)[0])
        if s.shape is not None:
            reader = reader.schema(s.shape)
        df = reader.parquet(*([_visible(spark, p) for p in s.paths] if hidden else s.paths))
        s.shape = df.schema
        return df.withColumn("_file", F.col("_metadata.file_path"))
    out = None
    for path in s.paths:
        rows, keyed = _loaded(path, key)
        s.keyed_by = keyed or s.keyed_by
        parts = dict(q for x in _between(s.root, path) if (q := _pair(x)))
        if not rows:
            continue
        df = local(spark, rows, parts).withColumn("_file", F.lit(path if s.format == "json" and not keyed else None).cast("string"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], T.StructType([T.StructField("_file", T.StringType())]))


def _visible(spark: SparkSession, path: str) -> str:
    """A copy, in the folder that executors share, of a file whose own name Spark would hide."""
    copy = f"{state.root(spark)}/shown-{uuid.uuid4().hex[:10]}/{path.rsplit('/', 1)[-1].lstrip('_.')}"
    files.copy(path, copy)
    return copy


# ------------------------------------------------------------------ sinks
def write_file(df: DataFrame, path: str, kind: str, key: str | None = None) -> None:
    """One layer file, staged and renamed. With key, entries of a mapping under it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temp = f"{os.path.dirname(path)}/.{os.path.basename(path)}.tmp-{uuid.uuid4().hex[:8]}"
    if kind == "parquet":
        df.write.option("compression", "zstd").parquet(temp)
        parts = [p for p in os.listdir(temp) if p.startswith("part-")]
        if os.path.isdir(path) or len(parts) > 1:
            # as many files as Spark wrote: a directory of the table's name
            old = f"{temp}-old"
            if os.path.exists(path):
                os.replace(path, old)
            os.replace(temp, path)
            shutil.rmtree(old, ignore_errors=True) if os.path.isdir(old) else Path(old).unlink(missing_ok=True)
            return
        os.replace(f"{temp}/{parts[0]}", path)
        shutil.rmtree(temp)
        return
    rows = (plain(r.asDict(recursive=True)) for r in df.toLocalIterator())
    with open(temp, "w", encoding="utf-8") as f:
        if key:
            data = {str(r[key]) if kind == "json" else r[key]: {k: v for k, v in r.items() if k != key} for r in rows}
            f.write(json.dumps(data, ensure_ascii=False, indent=1) if kind == "json" else yaml.safe_dump(data, allow_unicode=True, sort_keys=False))
        elif kind == "json":
            f.write("[" + ",\n ".join(json.dumps(r, ensure_ascii=False) for r in rows) + "]\n")
        else:
            data = list(rows)
            f.write(yaml.safe_dump(data, allow_unicode=True, sort_keys=False) if data else "[]\n")
    os.replace(temp, path)


def plain(v):
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return float(v) if type(v).__name__ == "Decimal" else str(v)
