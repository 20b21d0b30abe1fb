"""The merged read of a table: branches, union by name, tombstones, filter, shadowing, virtual columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Branch:
    """One layer's rows of a table and its height in the stack."""

    df: DataFrame
    seq: int
    parquet: bool = False


def published(branches: list[Branch], top_extra: DataFrame | None = None) -> list[T.StructField]:
    """Columns of a stack, lowest branch first: the topmost layer's order, then what lower ones add.

    A column has the type of the topmost Parquet branch that holds it, else of the topmost one.
    """
    order: dict[str, str] = {}
    kind: dict[str, tuple[bool, T.DataType]] = {}
    for b in reversed(branches):
        for f in b.df.schema:
            if f.name in ("_file", "_seq"):
                continue
            k = f.name.lower()
            order.setdefault(k, f.name)
            if k not in kind or b.parquet and not kind[k][0]:
                kind[k] = (b.parquet, f.dataType)
    return [T.StructField(n, kind[k][1]) for k, n in order.items()]


def branch(b: Branch, columns: list[T.StructField], defaults: dict[str, Column] | None = None) -> DataFrame:
    have = {f.name.lower(): f for f in b.df.schema}
    out: list[Column] = []
    for c in columns:
        f = have.get(c.name.lower())
        col = F.lit(None).cast(c.dataType) if f is None else F.col(f"`{f.name}`")
        if f is not None and f.dataType != c.dataType:
            col = col.cast(c.dataType)
        if defaults and c.name.lower() in defaults:
            col = F.coalesce(col, defaults[c.name.lower()].cast(c.dataType))
        out.append(col.alias(c.name))
    file = F.col("_file") if "_file" in have else F.lit(None).cast("string")
    return b.df.select(*out, file.alias("_file"), F.lit(b.seq).alias("_seq"))


def merge(
    branches: list[Branch],
    columns: list[T.StructField],
    key: list[str],
    *,
    tombstones: DataFrame | None = None,
    write: Branch | None = None,
    filter_: str | None = None,
    virtual: list[tuple[str, str]] = (),
    defaults: dict[str, Column] | None = None,
) -> DataFrame:
    """The table over its read branches and, once there are writes, its write branch.

    With a key and more than one branch the topmost row of each key stands: a filter on
    a key column still reaches the scans through the window. One branch alone keeps its
    rows as they are, even where a key repeats in it.
    """
    names = [c.name for c in columns]
    read = None
    for b in branches:
        part = branch(b, columns, defaults)
        read = part if read is None else read.unionByName(part)
    if tombstones is not None and read is not None:
        t = tombstones.select(*[F.col(f"`{k}`").alias(f"__t{i}") for i, k in enumerate(key)])
        on = None
        for i, k in enumerate(key):
            c = read[k].eqNullSafe(t[f"__t{i}"])
            on = c if on is None else on & c
        read = read.join(t, on, "left_anti")
    total = len(branches)
    if write is not None:
        part = branch(write, columns)
        read = part if read is None else read.unionByName(part)
        total += 1
    if filter_:
        read = read.filter(filter_)
    if key and total > 1:
        w = Window.partitionBy(*[F.col(f"`{k}`") for k in key]).orderBy(F.desc("_seq"))
        read = read.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    for name, expression in virtual:
        read = read.withColumn(name, F.expr(expression))
    return read.select(*[F.col(f"`{n}`") for n in [*names, *[v for v, _ in virtual if v.lower() not in {n.lower() for n in names}]]])
