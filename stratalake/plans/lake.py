"""The lake: ordered layers published as keyed tables, with their writes and rules."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import shutil
import threading
import uuid
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions import host
from stratalake.operators import state
from stratalake.operators.merge import Branch, merge, published
from stratalake.plans.config import Config
from stratalake.plans.tsql.lexer import TSqlError
from stratalake.plans.tsql.parser import Parser
from stratalake.plans.tsql.render import Context, Renderer
from stratalake.sources import files
from stratalake.sources import layers as L
from stratalake.sources.schema import Declared, Reference, Schema, read_package

log = logging.getLogger("stratalake")


class LakeError(Exception):
    def __init__(self, message: str, sqlstate: str = "42000", number: int = 50000):
        super().__init__(message)
        self.sqlstate, self.number = sqlstate, number


@dataclass
class Writes:
    """A table's write state: effective rows and tombstoned keys, as versioned scratch paths."""

    rows: str | None = None
    tombs: str | None = None


@dataclass
class Table:
    name: str
    sources: list[tuple[int, L.Source]]
    columns: list[T.StructField] = field(default_factory=list)
    key: list[str] = field(default_factory=list)
    virtual: list[tuple[str, str]] = field(default_factory=list)
    filter: str | None = None
    writable: bool = True
    declared: Declared | None = None
    frozen: str | None = None  # collapsed read layers
    writes: Writes = field(default_factory=Writes)
    version: int = 0
    format: str | None = None
    keyed_by: str | None = None
    partitions: list[str] = field(default_factory=list)

    def column(self, name: str) -> T.StructField | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


class Lake:
    def __init__(self, spark: SparkSession, config: Config | None = None, *, schema: Schema | None = None, **options):
        self.spark = spark
        self.config = config or Config(**{k: [v] if k in ("layers", "defaultKey") and isinstance(v, str) else v for k, v in options.items()}).validate()
        self.given = schema
        self.turn, self.lock = threading.Semaphore(1), threading.RLock()
        self.tables: dict[str, Table] = {}
        self.generation = 0
        self.identities: dict[str, int] = {}
        self.frozen_defaults: dict[str, object] = {}
        self.start()

    def __enter__(self) -> Lake:
        return self

    def __exit__(self, *_) -> None:
        self.stop()

    # ---- start
    def start(self) -> None:
        c = self.config
        self.tables, self.views, self.functions = {}, {}, {}
        roots = [*c.layers]
        if c.base:
            manifest = json.loads(Path(c.base, "manifest.json").read_text())
            roots = [str(Path(c.base, "tables"))]
            self.given = self.given or _schema_from(manifest)
        package = c.dacpac
        if not package:
            found = [f"{layer}/{n}" for layer in c.layers if not files.remote(layer) for n, folder, _, _ in files.listing(layer) if n.endswith(".dacpac") and not folder]
            if len(found) > 1:
                raise LakeError(f"several declared schemas: {', '.join(found)}")
            package = found[0] if found else None
        self.schema = self.given or (read_package(package) if package else Schema())
        if os.path.isdir(c.write or ""):
            write = L.scan(c.write)
        else:
            write = {}
        for seq, layer in enumerate(roots):
            for key, s in L.scan(layer).items():
                self.tables.setdefault(key, Table(s.table, [])).sources.append((seq, s))
        for key, s in write.items():
            self.tables.setdefault(key, Table(s.table, []))
        for key, d in self.schema.tables.items():
            self.tables.setdefault(key, Table(d.name, [])).declared = d
        for key, d in self.schema.tables.items():
            self.tables[key].name = d.name
        if not self.tables:
            log.warning("no tables in %s", ", ".join(roots) or "no layers")
        host.register(self.spark)
        for key, t in self.tables.items():
            self._resolve(t, write.get(key), len(roots))
        self._functions()
        self._views()
        self.references = self._acyclic([r for r in map(self._reference, self.schema.references) if r])
        if c.materialize and not c.lazy:
            for t in self.tables.values():
                self.materialize(t)
        self.generation += 1

    def reload(self) -> None:
        self.start()

    def _resolve(self, t: Table, write: L.Source | None, height: int) -> None:
        c, settings = self.config, next((v for k, v in self.config.tables.items() if k.lower() == t.name.lower()), {})
        single = self._key_names(t, settings, None)
        branches = [Branch(L.read(self.spark, s, single[0] if len(single) == 1 else None), seq, s.format == "parquet") for seq, s in t.sources]
        every = list(branches)
        if write is not None:
            w = L.read(self.spark, write, single[0] if len(single) == 1 else None)
            every.append(Branch(w, height, write.format == "parquet"))
            t.format, t.keyed_by = write.format, write.keyed_by
        elif t.sources:
            top = t.sources[-1][1]
            t.keyed_by = top.keyed_by if c.writeFormat != "parquet" else None
        if t.declared:
            t.columns = [T.StructField(n, T._parse_datatype_string(k)) for n, k in t.declared.columns]
        else:
            t.columns = published(branches) if branches else []
            have = {x.name.lower() for x in t.columns}
            if write is not None:
                t.columns = [*([replace_type(x, published(every)) for x in t.columns]), *[x for x in published(every) if x.name.lower() not in have]]
        names = {x.name.lower() for x in t.columns}
        t.partitions = list(dict.fromkeys(p for _, s in t.sources for p in s.partitions if p.lower() in names))
        t.key = self._key_names(t, settings, names)
        if t.key:
            t.key = [t.column(k).name for k in [*t.key, *[p for p in t.partitions if p.lower() not in {k.lower() for k in t.key}]]]
        t.virtual = self._virtual(t, settings)
        t.filter = settings.get("filter")
        t.writable = bool(settings.get("writable", c.writable))
        if write is not None:
            w = L.read(self.spark, write, t.key[0] if len(t.key) == 1 else None)
            t.writes.rows = state.save(_fit(w, t.columns), t.name)
        tomb = next((p for k in L.FORMATS if os.path.exists(p := f"{c.write}/.deleted/{t.name}.{k}")), None) if c.write else None
        if tomb and t.key:
            d = L.read(self.spark, L.Source(t.name, tomb.rsplit(".", 1)[1], [tomb], str(Path(tomb).parent)), None)
            t.writes.tombs = state.save(_fit(d, [t.column(k) for k in t.key]), t.name + "-deleted")

    def _key_names(self, t: Table, settings: dict, names: set[str] | None) -> list[str]:
        key = settings.get("key")
        if key:
            return [key] if isinstance(key, str) else list(key)
        have = names if names is not None else None
        if self.config.defaultKey and (have is None or all(k.lower() in have for k in self.config.defaultKey)):
            return list(self.config.defaultKey)
        if t.declared and t.declared.key and (have is None or all(k.lower() in have for k in t.declared.key)):
            return list(t.declared.key)
        return []

    def _virtual(self, t: Table, settings: dict) -> list[tuple[str, str]]:
        names = {c.name.lower() for c in t.columns}
        out = []
        for c in self.config.columns:
            only, less = c.get("only"), c.get("except") or []
            if c["name"].lower() in names or t.name in less or only and t.name not in only:
                continue
            out.append(c)
        out += settings.get("columns") or []
        done = []
        for c in out:
            sql = repr_sql(c["const"]) if "const" in c else c["expr"]
            done.append((c["name"], f"CAST({sql} AS {c['type']})" if c.get("type") else sql))
        return done

    # ---- defaults
    def expression(self, text: str) -> str:
        return Renderer(Context(functions=set(map(str.lower, self.schema.functions)))).expr(Parser(text).expr())

    def default_value(self, t: Table, column: str) -> object:
        """A declared default, evaluated once per process; a failing one is NULL, with a warning."""
        k = f"{t.name}.{column}".lower()
        if k not in self.frozen_defaults:
            try:
                self.frozen_defaults[k] = self.spark.sql(f"SELECT {self.expression(t.declared.defaults[column])} AS x").first()[0]
            except Exception as e:  # the engine's own error types vary
                log.warning("default of %s: %s", k, e)
                self.frozen_defaults[k] = None
        return self.frozen_defaults[k]

    def read_defaults(self, t: Table) -> dict:
        out = {}
        for column, text in (t.declared.defaults if t.declared else {}).items():
            if self.config.deriveIds and text.strip("() ").lower() == "newid" and t.key:
                prefix = hashlib.sha256(f"{t.name}.{column}".lower().encode()).hexdigest()[:16]
                n = F.lpad(F.lower(F.hex(F.col(t.key[0]).cast("bigint") if len(t.key) == 1 and isinstance(t.column(t.key[0]).dataType, (T.ShortType, T.IntegerType, T.LongType)) else F.xxhash64(*t.key))), 16, "0")
                h = F.concat(F.lit(prefix), n)
                out[column] = F.concat_ws("-", *[h.substr(a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
            else:
                out[column] = F.lit(self.default_value(t, column))
        return out

    # ---- frames
    def branches(self, t: Table, spark: SparkSession) -> list[Branch]:
        if t.frozen:
            return [Branch(state.load(spark, t.frozen), 0, True)]
        key = t.key[0] if len(t.key) == 1 else None
        return [Branch(L.read(spark, s, key), seq, s.format == "parquet") for seq, s in t.sources]

    def frame(self, name: str, spark: SparkSession | None = None, writes: Writes | None = None, variables: dict | None = None) -> DataFrame:
        """The merged table. Without writes, filter, virtual columns and with one layer it is that layer's plain projection."""
        t, spark = self.tables[name.lower()], spark or self.spark
        if self.config.materialize and self.config.lazy and not t.frozen:
            self.materialize(t)
        writes = writes or t.writes
        cached = self._cached(t, spark) if self.config.cache and not t.frozen else None
        branches = [Branch(cached, 0, True)] if cached is not None else self.branches(t, spark)
        schema = T.StructType(t.columns)
        write = Branch(state.load(spark, writes.rows, schema), 1 << 20, True) if writes.rows else None
        tombs = state.load(spark, writes.tombs) if writes.tombs else None
        if not branches:
            branches = [Branch(spark.createDataFrame([], schema), 0)]
        settled = t.frozen or cached is not None
        return merge(branches, t.columns, t.key, tombstones=tombs, write=write, filter_=_bind(t.filter, variables) if t.filter else None, virtual=[(n, _bind(e, variables)) for n, e in t.virtual], defaults=None if settled else self.read_defaults(t))

    def materialize(self, t: Table) -> None:
        """Collapses the read layers; the key and the unique rules are enforced once more here."""
        if t.frozen:
            return
        if self.keeps and self._reopen(t):
            return
        plain = replace(t, writes=Writes(), virtual=[], filter=None)
        df = self._plain(plain)
        if self.config.store:
            path = f"{self.config.store}/{t.name}/table-{uuid.uuid4().hex[:12]}" if self.keeps else f"{self.config.store}/{t.name}"
            _write_sorted(df, t, path)
            t.frozen = path
        else:
            t.frozen = state.save(df, t.name)
        got = state.load(self.spark, t.frozen)
        if t.key and got.groupBy(*t.key).count().filter("count > 1").limit(1).count():
            t.frozen = None
            raise LakeError(f"duplicate key in {t.name}", "23505", 2627)
        for rule in t.declared.uniques if t.declared else []:
            names = [*rule, *[p for p in t.partitions if p not in rule]]
            if all(t.column(n) for n in rule) and got.dropna(subset=rule).groupBy(*names).count().filter("count > 1").limit(1).count():
                t.frozen = None
                raise LakeError(f"the rows of {t.name} break the UNIQUE rule ({', '.join(rule)})", "23505", 2627)
        if self.keeps:
            self.keep(t)

    # ---- a kept store
    @property
    def keeps(self) -> bool:
        """Whether the store is the state: tables it holds are no longer built from the layers."""
        return bool(self.config.store) and (self.config.storeMode or "keep").lower() == "keep"

    def _shape(self, t: Table) -> list:
        return [[[c.name, c.dataType.simpleString()] for c in t.columns], t.key]

    def _reopen(self, t: Table) -> bool:
        mark = Path(self.config.store, f"{t.name}.json")
        if not mark.exists():
            return False
        held = json.loads(mark.read_text())
        if held["shape"] != self._shape(t):
            raise LakeError(f"the store {self.config.store} holds {t.name} with other columns or another key; delete it to start again")
        t.frozen, t.writes.rows, t.writes.tombs = held["table"], held["rows"], held["tombs"]
        if held["identity"] is not None:
            self.identities.setdefault(t.name.lower(), held["identity"])
        used = {Path(p).name for p in (t.frozen, t.writes.rows, t.writes.tombs) if p}
        for old in Path(self.config.store, t.name).iterdir():
            if old.name not in used:
                shutil.rmtree(old, ignore_errors=True)
        return True

    def keep(self, t: Table) -> None:
        """Stores a table's write state beside its rows; one atomic rename makes it the table's state."""
        held = {"shape": self._shape(t), "table": t.frozen, "identity": self.identities.get(t.name.lower())}
        for kind, path in (("rows", t.writes.rows), ("tombs", t.writes.tombs)):
            held[kind] = f"{self.config.store}/{t.name}/{kind}-{uuid.uuid4().hex[:12]}" if path else None
            if path:
                state.load(self.spark, path).write.option("compression", "zstd").parquet(held[kind])
        temp = Path(self.config.store, f".{t.name}.tmp")
        temp.write_text(json.dumps(held))
        os.replace(temp, Path(self.config.store, f"{t.name}.json"))

    def _plain(self, t: Table, defaults: bool = True) -> DataFrame:
        branches = self.branches(t, self.spark) or [Branch(self.spark.createDataFrame([], T.StructType(t.columns)), 0)]
        return merge(branches, t.columns, t.key, defaults=self.read_defaults(t) if defaults else None)

    def _signature(self, t: Table) -> list:
        return [[seq, *found] for seq, s in t.sources for p in s.paths for found in files.walk(p)] + [[c.name, c.dataType.simpleString()] for c in t.columns] + [t.key]

    def _cached(self, t: Table, spark: SparkSession) -> DataFrame | None:
        """The merged read layers as Parquet, named by their content; stale copies go."""
        if len(t.sources) < 2 or not t.key:
            return None
        name = hashlib.sha256(json.dumps(self._signature(t)).encode()).hexdigest()[:20]
        folder = f"{self.config.cache}/{t.name}"
        if not os.path.exists(f"{folder}/{name}/_SUCCESS"):
            # a copy that readers may still hold stays until the one after next is made
            for old in sorted((x for x in Path(folder).glob("*") if x.is_dir()), key=os.path.getmtime)[:-1]:
                shutil.rmtree(old, ignore_errors=True)
            _write_sorted(self._plain(t), t, f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    # ---- declared code
    def _functions(self) -> None:
        """Scalar functions, created until no more can be (they may call each other)."""
        self.function_sql: list[str] = []
        rest = dict(self.schema.functions)
        while rest:
            done = []
            for name, (params, kind, text) in rest.items():
                r = Renderer(Context(functions=set(map(str.lower, self.schema.functions)), parameters={"@" + p.lower(): f"`{p}`" for p, _ in params}))
                sql = f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'`{p}` {k}' for p, k in params)}) RETURNS {kind} RETURN CAST({r.expr(Parser(text).expr())} AS {kind})"
                try:
                    self.spark.sql(sql)
                except Exception as e:
                    why = e
                    continue
                self.function_sql.append(sql)
                done.append(name)
            if not done:
                log.warning("functions %s: %s", ", ".join(rest), why)
                return
            for n in done:
                del rest[n]

    def _views(self) -> None:
        for name, text in self.schema.views.items():
            if name.lower() in self.tables:
                log.warning("%s: files win over the view of that name", name)
                continue
            import re

            body = re.sub(r"(?is)^\s*CREATE\s+VIEW\s+\S+\s+AS\s+", "", text)
            self.views[name.lower()] = (name, body)

    def _reference(self, r: Reference) -> Reference | None:
        child, parent = self.tables.get(r.table.lower()), self.tables.get(r.target.lower())
        if child is None or parent is None or [k.lower() for k in r.target_columns] != [k.lower() for k in parent.key]:
            log.warning("reference %s does not point at a key; skipped", r.name)
            return None
        if r.on_delete != "restrict" and not (child.key and child.writable):
            log.warning("reference %s: %s %s, so it refuses instead", r.name, child.name, "is read-only" if child.key else "has no key")
            return replace(r, on_delete="restrict")
        if r.on_delete in ("null", "default") and {c.lower() for c in r.columns} & {k.lower() for k in child.key}:
            log.warning("reference %s would change a key, so it refuses instead", r.name)
            return replace(r, on_delete="restrict")
        return r

    def _acyclic(self, references: list[Reference]) -> list[Reference]:
        """References whose cascade would come back to its own table refuse instead."""
        down: dict[str, set[str]] = {}
        for r in references:
            if r.on_delete == "cascade":
                down.setdefault(r.target.lower(), set()).add(r.table.lower())

        def reaches(a: str, b: str) -> bool:
            seen, todo = set(), [a]
            while todo:
                x = todo.pop()
                if x == b:
                    return True
                if x not in seen:
                    seen.add(x)
                    todo += down.get(x, ())
            return False

        out = []
        for r in references:
            if r.on_delete == "cascade" and reaches(r.table.lower(), r.target.lower()):
                log.warning("reference %s is part of a cycle, so it refuses instead", r.name)
                r = replace(r, on_delete="restrict")
            out.append(r)
        return out

    # ---- facts
    def describe(self) -> list[str]:
        """A line for each table; rows are counted of seed files only."""
        out = []
        for t in self.tables.values():
            seeds = [L._loaded(p, t.key[0] if len(t.key) == 1 else None)[0] for _, s in t.sources if s.format != "parquet" for p in s.paths]
            rows = f"{sum(map(len, seeds))} rows, " if seeds and all(s.format != "parquet" for _, s in t.sources) else ""
            out.append(f"{t.name} <- {', '.join(p for _, s in t.sources for p in s.paths)} ({rows}{len(t.columns)} columns: {', '.join(c.name for c in t.columns)})")
        return out

    def constraints(self) -> list[tuple[str, str, list[str]]]:
        out = [(t.name, "primary key", t.key) for t in self.tables.values() if t.key]
        out += [(t.name, "unique", u) for t in self.tables.values() if t.declared for u in t.declared.uniques]
        return out + [(r.table, f"references {r.target}", r.columns) for r in self.references]

    # ---- sessions, persistence
    def session(self, user: str = "admin", **variables):
        from stratalake.plans.session import Session

        return Session(self, user, variables)

    def persist(self, t: Table, delta: bool = False) -> None:
        """Writes the table's own rows and tombstones as one more layer file each; an empty table has no file.

        With delta, rows that the layers hold as they are, and tombstones of keys that they lack, are left out.
        """
        c = self.config
        if not c.write:
            return
        kind = t.format or c.writeFormat
        for path, version, columns, key in ((f"{c.write}/{t.name}.{kind}", t.writes.rows, None, t.keyed_by if kind != "parquet" else None), (f"{c.write}/.deleted/{t.name}.{kind}", t.writes.tombs, t.key, None)):
            df = state.load(self.spark, version) if version else None
            if df is not None and delta and t.key:
                base = self._plain(replace(t, writes=Writes(), virtual=[], filter=None))
                names = columns or [x.name for x in t.columns]
                base = base.select(*[F.col(f"`{n}`").alias(f"__{i}") for i, n in enumerate(names)])
                df = df.join(base, [F.col(f"`{n}`").eqNullSafe(F.col(f"__{i}")) for i, n in enumerate(names)], "left_semi" if columns else "left_anti")
            if df is None or not df.limit(1).count():
                if os.path.isdir(path):
                    shutil.rmtree(path)
                elif os.path.exists(path):
                    os.remove(path)
                continue
            L.write_file(df.select(*columns) if columns else df, path, kind, key)

    def stop(self) -> None:
        """Flushes what a materialized lake still holds; a kept store holds it already."""
        if self.config.materialize and not self.keeps:
            for t in self.tables.values():
                if t.version:
                    self.persist(t, delta=True)

    # ---- bake
    def _own(self, t: Table) -> DataFrame:
        """The merged rows, with defaults filled in key columns only (collapsed tables hold theirs already)."""
        branches = self.branches(t, self.spark) or [Branch(self.spark.createDataFrame([], T.StructType(t.columns)), 0)]
        schema = T.StructType(t.columns)
        write = Branch(state.load(self.spark, t.writes.rows, schema), 1 << 20, True) if t.writes.rows else None
        tombs = state.load(self.spark, t.writes.tombs) if t.writes.tombs else None
        keys = {k.lower() for k in t.key}
        defaults = {} if t.frozen else {c: v for c, v in self.read_defaults(t).items() if c.lower() in keys}
        return merge(branches, t.columns, t.key, tombstones=tombs, write=write, defaults=defaults)

    def bake(self, target: str) -> None:
        """The stack as one layer: a Parquet table each (partitioned as its sources are).

        Declared defaults are left to whoever reads the baked layer, but for key columns.
        """
        target = files.plain(target)
        if not files.remote(target) and any(Path(target).resolve().is_relative_to(Path(x).resolve()) for x in self.config.layers if not files.remote(x)):
            raise LakeError(f"{target} lies inside a layer")
        if files.is_dir(target):
            strays = [n for n, _, _, _ in files.listing(target) if not n.startswith(".") and n.lower() not in self.tables]
            if strays:
                log.warning("%s also holds %s, which this bake does not write", target, ", ".join(strays))
        for t in self.tables.values():
            if t.filter or any("getvariable" in e.lower() for _, e in t.virtual):
                raise LakeError(f"{t.name} depends on the session and cannot be baked")
            df = self._own(t).select(*[c.name for c in t.columns])
            w = df.write.mode("overwrite").option("compression", "zstd")
            (w.partitionBy(*t.partitions) if t.partitions else w).parquet(f"{target}/{t.name}")

    def bake_database(self, target: str) -> None:
        """Collapsed tables and all that was declared, for `base`."""
        self.bake(f"{target}/tables")
        tables = {t.name: {"columns": [[c.name, c.dataType.simpleString()] for c in t.columns], "key": t.key, "identity": t.declared.identity if t.declared else None, "defaults": t.declared.defaults if t.declared else {}, "uniques": t.declared.uniques if t.declared else []} for t in self.tables.values()}
        data = {"version": 1, "tables": tables, "references": [vars(r) for r in self.references], "views": {n: b for n, b in self.views.values()}, "functions": self.schema.functions}
        os.makedirs(target, exist_ok=True)
        temp = Path(target, ".manifest.tmp")
        temp.write_text(json.dumps(data))
        os.replace(temp, Path(target, "manifest.json"))


def _schema_from(m: dict) -> Schema:
    if m.get("version") != 1:
        raise LakeError(f"base version {m.get('version')} is not read")
    tables = {n.lower(): Declared(n, [tuple(c) for c in t["columns"]], t["key"], t["identity"], t["defaults"], t["uniques"]) for n, t in m["tables"].items()}
    return Schema(tables, [Reference(**r) for r in m["references"]], m["views"], {n: ([tuple(p) for p in f[0]], f[1], f[2]) for n, f in m["functions"].items()})


def _write_sorted(df: DataFrame, t: Table, path: str) -> None:
    """Sorted by key inside each file, so that row-group statistics prune key lookups."""
    (df.sortWithinPartitions(*t.key) if t.key else df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def replace_type(c: T.StructField, from_: list[T.StructField]) -> T.StructField:
    return next((x for x in from_ if x.name.lower() == c.name.lower()), c)


def _fit(df: DataFrame, columns: list[T.StructField]) -> DataFrame:
    have = {n.lower(): n for n in df.columns}
    return df.select(*[(F.col(f"`{have[c.name.lower()]}`") if c.name.lower() in have else F.lit(None)).cast(c.dataType).alias(c.name) for c in columns])


def repr_sql(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _bind(text: str, variables: dict | None) -> str:
    import re

    return re.sub(r"(?i)getvariable\(\s*'([^']*)'\s*\)", lambda m: repr_sql((variables or {}).get(m[1])), text)


__all__ = ["Lake", "LakeError", "Table", "TSqlError", "Writes"]
