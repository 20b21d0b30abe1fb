"""Declared schemas: tables, keys, uniques, references, defaults, views and functions.

Read from a model package (a zip with model.xml) or given as plain data.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from dataclasses import dataclass, field


@dataclass
class Declared:
    name: str
    columns: list[tuple[str, str]] = field(default_factory=list)  # (name, Spark type)
    key: list[str] = field(default_factory=list)
    identity: str | None = None
    defaults: dict[str, str] = field(default_factory=dict)  # T-SQL expressions
    uniques: list[list[str]] = field(default_factory=list)


@dataclass
class Reference:
    name: str
    table: str
    columns: list[str]
    target: str
    target_columns: list[str]
    on_delete: str = "restrict"  # restrict, cascade, null, default


@dataclass
class Schema:
    tables: dict[str, Declared] = field(default_factory=dict)
    references: list[Reference] = field(default_factory=list)
    views: dict[str, str] = field(default_factory=dict)
    functions: dict[str, tuple[list[tuple[str, str]], str, str]] = field(default_factory=dict)  # parameters, type, expression


def _last(name: str) -> str:
    return re.findall(r"\[((?:[^\]]|\]\])*)\]", name)[-1].replace("]]", "]")


def _owner(name: str) -> str:
    return re.findall(r"\[((?:[^\]]|\]\])*)\]", name)[-2].replace("]]", "]")


class _Model:
    def __init__(self, root: ET.Element):
        self.elements = [e for e in root.iter() if e.tag.endswith("Element")]

    def of(self, kind: str):
        return [e for e in self.elements if e.get("Type") == kind]

    @staticmethod
    def prop(e: ET.Element, name: str) -> str | None:
        for p in e:
            if p.tag.endswith("Property") and p.get("Name") == name:
                return p.get("Value") if p.get("Value") is not None else "".join(v.text or "" for v in p if v.tag.endswith("Value"))
        return None

    @staticmethod
    def inner(e: ET.Element, relation: str) -> list[ET.Element]:
        return [x for r in e if r.tag.endswith("Relationship") and r.get("Name") == relation for entry in r for x in entry]

    def refs(self, e: ET.Element, relation: str) -> list[str]:
        return [x.get("Name") for x in self.inner(e, relation) if x.tag.endswith("References")]

    def type(self, e: ET.Element) -> str:
        from stratalake.functions.types import spark_type

        spec = self.inner(e, "TypeSpecifier") or self.inner(e, "Type")
        for s in spec:
            if s.tag.endswith("References"):
                return spark_type(_last(s.get("Name")))
            name = _last(self.refs(s, "Type")[0])
            p, sc = self.prop(s, "Precision"), self.prop(s, "Scale")
            return spark_type(name, [p, sc or "0"] if p and name in ("decimal", "numeric") else [])
        return "STRING"


def read_package(path: str) -> Schema:
    with zipfile.ZipFile(path) as z, z.open("model.xml") as f:
        m = _Model(ET.parse(f).getroot())
    out = Schema()
    for e in m.of("SqlTable"):
        t = Declared(_last(e.get("Name")))
        for c in m.inner(e, "Columns"):
            if c.get("Type") != "SqlSimpleColumn":
                continue
            name = _last(c.get("Name"))
            t.columns.append((name, m.type(c)))
            if m.prop(c, "IsIdentity") == "True":
                t.identity = name
        out.tables[t.name.lower()] = t
    table = lambda e: out.tables.get(_last(m.refs(e, "DefiningTable")[0]).lower())
    specs = lambda e: [_last(m.refs(s, "Column")[0]) for s in m.inner(e, "ColumnSpecifications")]
    for e in m.of("SqlPrimaryKeyConstraint"):
        if t := table(e):
            t.key = specs(e)
    for e in m.of("SqlUniqueConstraint"):
        if t := table(e):
            t.uniques.append(specs(e))
    for e in m.of("SqlIndex"):
        if m.prop(e, "IsUnique") == "True" and (t := out.tables.get(_last(m.refs(e, "IndexedObject")[0]).lower())):
            t.uniques.append(specs(e))
    for e in m.of("SqlDefaultConstraint"):
        if t := table(e):
            t.defaults[_last(m.refs(e, "ForColumn")[0]).lower()] = m.prop(e, "DefaultExpressionScript") or "NULL"
    actions = {"1": "cascade", "2": "null", "3": "default"}
    for e in m.of("SqlForeignKeyConstraint"):
        out.references.append(Reference(_last(e.get("Name") or "[fk]"), _last(m.refs(e, "DefiningTable")[0]), [_last(x) for x in m.refs(e, "Columns")], _last(m.refs(e, "ForeignTable")[0]), [_last(x) for x in m.refs(e, "ForeignColumns")], actions.get(m.prop(e, "OnDeleteAction") or "0", "restrict")))
    for e in m.of("SqlView"):
        out.views[_last(e.get("Name"))] = m.prop(e, "QueryScript") or ""
    for e in m.of("SqlScalarFunction"):
        body = next((m.prop(x, "BodyScript") for x in e.iter() if x.tag.endswith("Element") and m.prop(x, "BodyScript")), None)
        found = re.fullmatch(r"(?is)\s*(?:BEGIN\s+)?RETURN\b(.*?);?\s*(?:END)?\s*;?\s*", body or "")
        if found:
            params = [(_last(p.get("Name")).lstrip("@"), m.type(p)) for p in m.inner(e, "Parameters")]
            out.functions[_last(e.get("Name"))] = (params, m.type(e), found[1].strip())
    return out
