"""Trees to Spark SQL.

What depends on an operand's type (sums of integers, decimal division, rounding casts,
bit arithmetic, styles) asks the analyzer for the type of the rendered expression over
the rendered FROM clause; that is an analysis, never a job.
"""

from __future__ import annotations

from collections.abc import Callable

from stratalake.functions import dates
from stratalake.functions.types import cast_to, is_decimal, is_integral, is_number, spark_type
from stratalake.plans.tsql.lexer import TSqlError
from stratalake.plans.tsql.parser import Node

#: Functions whose result is text, which makes `+` a concatenation.
TEXT = {"substring", "upper", "lower", "ltrim", "rtrim", "trim", "concat", "replace", "left", "right", "reverse", "datename", "string_agg", "space", "replicate"}
RANKS = {"row_number", "rank", "dense_rank", "ntile"}


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Context:
    """What a session knows: names, parameters, variables and the analyzer."""

    def __init__(self, type_of: Callable[[str, str], str | None] = lambda sql, scope: None, count: Callable[[str], int] | None = None, values: dict | None = None, functions: set[str] = frozenset(), temp: Callable[[str], str] = lambda n: n, parameters: dict | None = None):
        self.type_of, self.count, self.values, self.functions, self.temp, self.parameters = type_of, count, values or {}, functions, temp, parameters or {}


class Renderer:
    def __init__(self, context: Context | None = None):
        self.c = context or Context()
        self.scopes: list[str] = [""]
        self.prefix = ""

    # ---- queries
    def query(self, q: Node) -> str:
        before = self.prefix
        ctes = ""
        if q.ctes:
            parts = []
            for c in q.ctes:
                parts.append(f"{quote(c.name)}{'(' + ', '.join(map(quote, c.columns)) + ')' if c.columns else ''} AS ({self.query(c.query)})")
                self.prefix = f"WITH {', '.join(parts)} " if not before else before
            ctes = f"WITH {', '.join(parts)} "
        body = q.body
        if body.kind == "select":
            sql = self.select(body, q)
        else:
            sql = self.body(body)
            sql += self.tail(q, body)
        self.prefix = before
        return ctes + sql

    def tail(self, q: Node, body: Node) -> str:
        sql = ""
        if q.order:
            sql += " ORDER BY " + self.order(q.order)
        if q.fetch is not None:
            sql += f" LIMIT {self.expr(q.fetch)}"
        if q.offset is not None:
            sql += f" OFFSET {self.expr(q.offset)}"
        return sql

    def order(self, items: list) -> str:
        return ", ".join(f"{self.expr(e)} {'DESC' if d else 'ASC'} NULLS LAST" for e, d in items)

    def body(self, b: Node) -> str:
        if b.kind == "select":
            return self.select(b, None)
        if b.kind == "nested":
            return f"({self.query(b.query)})"
        if b.kind == "values":
            return "VALUES " + ", ".join("(" + ", ".join(self.expr(e) for e in row) + ")" for row in b.rows)
        return f"{self.side(b.left)} {b.op} {self.side(b.right)}"

    def side(self, b: Node) -> str:
        return f"({self.body(b)})" if b.kind == "setop" or b.kind == "select" and b.top else self.body(b)

    def select(self, s: Node, q: Node | None) -> str:
        source = self.source(s.source) if s.source else ""
        self.scopes.append(source)
        items = ", ".join(self.item(i) for i in s.items)
        percent = s.top and s.top.percent
        sql = ("SELECT DISTINCT " if s.distinct else "SELECT ") + items
        if source:
            sql += f" FROM {source}"
        if s.where is not None:
            sql += f" WHERE {self.truth(s.where)}"
        if s.group:
            sql += " GROUP BY " + ", ".join(self.expr(e) for e in s.group)
        if s.having is not None:
            sql += f" HAVING {self.truth(s.having)}"
        plain = self.prefix + sql
        if q is not None:
            if s.top and q.order:
                sql += " ORDER BY " + self.order(q.order)
            elif not s.top:
                sql += self.tail(q, s)
        if percent:
            if not self.c.count:
                raise TSqlError("TOP PERCENT needs a session")
            n = self.c.count(plain)
            share = self.c.count(f"SELECT CAST({self.expr(s.top.n)} * 1000000 AS BIGINT)", value=True) / 1_000_000
            sql += f" LIMIT {-int(-n * share // 100)}"
        elif s.top:
            sql += f" LIMIT {self.expr(s.top.n)}"
        self.scopes.pop()
        return sql

    def item(self, i: Node) -> str:
        sql = self.expr(i.expr)
        name = i.alias
        if name is None and i.expr.kind == "column":
            return sql
        if name is None and i.expr.kind == "call":
            name = i.expr.path[-1].lower()
        return sql if name is None else f"{sql} AS {quote(name)}"

    # ---- sources
    def table(self, path: list[str]) -> str:
        name = path[-1]
        if name.startswith("##"):
            raise TSqlError("global temporary tables are not supported")
        return quote(self.c.temp(name))

    def source(self, s: Node) -> str:
        if s.kind == "table":
            return self.table(s.path) + f" AS {quote(s.alias or s.path[-1])}"
        if s.kind == "group":
            return f"({self.source(s.source)})"
        if s.kind == "derived":
            columns = "(" + ", ".join(map(quote, s.columns)) + ")" if s.columns else ""
            return f"({self.query(s.query)})" + (f" AS {quote(s.alias)}{columns}" if s.alias else "")
        if s.kind == "join":
            right = self.source(s.right)
            if s.right.kind == "join":
                right = f"({right})"
            left = self.source(s.left)
            if s.type == "CROSS":
                return f"{left} CROSS JOIN {right}"
            self.scopes.append(f"{left} CROSS JOIN {right}")
            on = self.truth(s.on)
            self.scopes.pop()
            return f"{left} {s.type} JOIN {right} ON {on}"
        if s.kind == "function_source":
            return self.function_source(s)
        if s.kind == "openjson":
            return self.openjson(s)
        raise TSqlError(f"unsupported source {s.kind}")

    def function_source(self, s: Node) -> str:
        kind = {"read_parquet": "parquet", "read_json": "json", "read_json_auto": "json"}.get(s.name.lower())
        alias = f" AS {quote(s.alias)}" if s.alias else ""
        if kind and len(s.args) == 1 and s.args[0].kind == "string":
            return f"{kind}.{quote(s.args[0].value)}{alias}"
        return f"{s.name}({', '.join(self.expr(a) for a in s.args)}){alias}"

    def openjson(self, s: Node) -> str:
        doc = self.expr(s.doc)
        if s.path is not None:
            doc = f"get_json_object({doc}, {self.expr(s.path)})"
        alias = quote(s.alias or "openjson")
        if s.columns is None:
            kind = "CASE WHEN t = 'VOID' THEN 0 WHEN t LIKE 'STRING%' THEN 1 WHEN t LIKE 'BOOLEAN%' THEN 3 WHEN t LIKE 'ARRAY%' THEN 4 WHEN t LIKE 'OBJECT%' THEN 5 ELSE 2 END"
            rows = f"SELECT coalesce(key, CAST(pos AS STRING)) AS `key`, to_json(value) AS `value`, {kind} AS `type` FROM (SELECT pos, key, value, schema_of_variant(value) AS t FROM variant_explode(parse_json({doc})))"
            return f"LATERAL ({rows}) AS {alias}"
        cols = []
        for name, (kind, args), path in s.columns:
            value = "e" if path == "$" else f"get_json_object(e, {text(path or '$.' + name)})"
            cols.append(f"CAST({value} AS {spark_type(kind, args)}) AS {quote(name)}")
        items = f"CASE WHEN ltrim({doc}) LIKE '[%' THEN from_json({doc}, 'array<string>') ELSE array({doc}) END"
        return f"LATERAL (SELECT {', '.join(cols)} FROM explode({items}) AS x(e)) AS {alias}"

    # ---- expressions
    def type_of(self, sql: str) -> str | None:
        scope = self.scopes[-1]
        return self.c.type_of(self.prefix, f"SELECT {sql} AS x" + (f" FROM {scope}" if scope else ""))

    def truth(self, e: Node) -> str:
        return self.expr(e)

    def expr(self, e: Node) -> str:
        return getattr(self, "e_" + e.kind)(e)

    def e_number(self, e):
        return e.value

    def e_string(self, e):
        return text(e.value)

    def e_hex(self, e):
        return f"X'{e.value if len(e.value) % 2 == 0 else '0' + e.value}'"

    def e_literal(self, e):
        return e.value

    def e_default(self, e):
        return "DEFAULT"

    def e_star(self, e):
        return f"{quote(e.path[-1])}.*" if e.path else "*"

    def e_column(self, e):
        return ".".join(map(quote, e.path[-2:]))

    def e_paren(self, e):
        return f"({self.expr(e.expr)})"

    def e_param(self, e):
        name = e.name
        if name.startswith("@@"):
            if name.lower() not in self.c.values:
                raise TSqlError(f"unknown variable {name}", 137)
            v = self.c.values[name.lower()]
            return "NULL" if v is None else text(v) if isinstance(v, str) else str(v)
        if name.lower() not in self.c.parameters:
            raise TSqlError(f"must declare the scalar variable {name}", 137)
        return self.c.parameters[name.lower()]

    def e_scalar(self, e):
        return f"({self.query(e.query)})"

    def e_exists(self, e):
        return f"EXISTS ({self.query(e.query)})"

    def e_not(self, e):
        return f"NOT ({self.expr(e.expr)})"

    def e_isnull(self, e):
        return f"{self.expr(e.expr)} IS {'NOT ' * e.negated}NULL"

    def e_in(self, e):
        inner = self.query(e.query) if e.query else ", ".join(map(self.expr, e.values))
        return f"{self.expr(e.expr)} {'NOT ' * e.negated}IN ({inner})"

    def e_between(self, e):
        return f"{self.expr(e.expr)} {'NOT ' * e.negated}BETWEEN {self.expr(e.low)} AND {self.expr(e.high)}"

    def e_like(self, e):
        # without ESCAPE no character escapes; a control character that no pattern holds says so
        escape = self.expr(e.escape) if e.escape is not None else "'\x01'"
        return f"{self.expr(e.expr)} {'NOT ' * e.negated}LIKE {self.expr(e.pattern)} ESCAPE {escape}"

    def e_case(self, e):
        subject = f" {self.expr(e.subject)}" if e.subject is not None else ""
        whens = " ".join(f"WHEN {self.expr(c)} THEN {self.expr(v)}" for c, v in e.whens)
        return f"CASE{subject} {whens}{f' ELSE {self.expr(e.other)}' if e.other is not None else ''} END"

    def e_unary(self, e):
        return f"({e.op} {self.expr(e.expr)})"

    def textual(self, e: Node) -> bool:
        if e.kind == "string":
            return True
        if e.kind == "paren":
            return self.textual(e.expr)
        if e.kind in ("cast", "convert"):
            return spark_type(*e.type) == "STRING"
        if e.kind == "call":
            return e.path[-1].lower() in TEXT
        return e.kind == "binary" and e.op in ("+", "||") and (self.textual(e.left) or self.textual(e.right))

    def e_binary(self, e):
        op = e.op
        if op in ("AND", "OR"):
            return f"({self.expr(e.left)} {op} {self.expr(e.right)})"
        left, right = self.expr(e.left), self.expr(e.right)
        if op == "||" or op == "+" and (self.textual(e.left) or self.textual(e.right)):
            return f"({left} || {right})"
        if op in ("=", "<>", "<", "<=", ">", ">="):
            if "number" in (e.left.kind, e.right.kind):
                left, right = self.bit(e.left, left), self.bit(e.right, right)
            return f"({left} {op} {right})"
        left, right = self.bit(e.left, left), self.bit(e.right, right)
        if op == "/":
            return self.divide(left, right)
        if op == "%" and not (e.right.kind == "number" and float(e.right.value)):
            return f"({left} % nullif({right}, 0))"
        return f"({left} {op} {right})"

    def bit(self, e: Node, sql: str) -> str:
        """A BIT operand counts as an integer."""
        if e.kind in ("number", "string"):
            return sql
        return f"CAST({sql} AS INT)" if self.type_of(sql) == "boolean" else sql

    def divide(self, a: str, b: str) -> str:
        """True division; a zero divisor gives infinities or NaN."""
        a, b = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
        return f"(CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN double('Infinity') WHEN {a} < 0 THEN double('-Infinity') WHEN {a} = 0 THEN double('NaN') END ELSE {a} / {b} END)"

    def e_cast(self, e):
        sql, target = self.expr(e.expr), spark_type(*e.type)
        source = self.type_of(sql) if target in ("SMALLINT", "INT", "BIGINT") else None
        if e.type[0].lower() == "uniqueidentifier":
            return f"lower(CAST({sql} AS STRING))"
        return cast_to(sql, target, source, e.attempt)

    def e_convert(self, e):
        if e.style is None:
            return self.e_cast(e)
        if e.style.kind != "number":
            raise TSqlError("a style must be a number", 281)
        sql = self.expr(e.expr)
        return dates.convert(spark_type(*e.type), sql, int(e.style.value), self.type_of(sql))

    def e_call(self, e):
        name, args = e.path[-1].lower(), e.args
        if e.over is not None or name in AGGREGATES:
            return self.aggregate(e, name)
        fixed = getattr(self, "f_" + name, None)
        if fixed:
            return fixed(*args)
        if len(e.path) > 1 and name not in self.c.functions:
            raise TSqlError(f"unknown function {'.'.join(e.path)}", 195)
        if name in UNKNOWN:
            raise TSqlError(f"{name} is not a recognized built-in function name", 195)
        return f"{e.path[-1]}({', '.join(map(self.expr, args))})"

    def aggregate(self, e: Node, name: str) -> str:
        star = len(e.args) == 1 and e.args[0].kind == "star"
        inner = "*" if star else ", ".join(map(self.expr, e.args))
        distinct = "DISTINCT " if e.distinct else ""
        target, spark_name = None, {"count_big": "count", "stdev": "stddev_samp", "stdevp": "stddev_pop", "var": "var_samp", "varp": "var_pop"}.get(name, name)
        if name == "count":
            target = "INT"
        elif name in RANKS:
            target = "BIGINT"
        elif name in ("sum", "avg") and e.args:
            t = self.type_of(inner)
            if t and name == "sum" and (is_integral(t) or t == "boolean"):
                inner = f"CAST({f'CAST({inner} AS INT)' if t == 'boolean' else inner} AS DECIMAL(38,0))"
                target = "DECIMAL(38,0)"
            elif t and is_decimal(t):
                if name == "avg":
                    inner = f"CAST({inner} AS DOUBLE)"
                else:
                    target = f"DECIMAL(38,{t[8:-1].split(',')[1].strip()})"
        sql = f"{spark_name}({distinct}{inner})"
        if e.over is not None:
            parts = []
            if e.over.partition:
                parts.append("PARTITION BY " + ", ".join(map(self.expr, e.over.partition)))
            if e.over.order:
                parts.append("ORDER BY " + self.order(e.over.order))
            sql += f" OVER ({' '.join(parts)})"
        return f"CAST({sql} AS {target})" if target else sql

    # ---- functions
    def word(self, e: Node) -> str:
        if e.kind != "column" or len(e.path) != 1:
            raise TSqlError("expected a date part")
        return e.path[0]

    def f_isnull(self, a, b):
        return f"coalesce({self.expr(a)}, {self.expr(b)})"

    def f_len(self, s):
        return f"length(rtrim({self.expr(s)}))"

    def f_iif(self, c, a, b):
        return f"CASE WHEN {self.truth(c)} THEN {self.expr(a)} ELSE {self.expr(b)} END"

    def f_charindex(self, needle, hay, start=None):
        if start is None:
            return f"instr({self.expr(hay)}, {self.expr(needle)})"
        return f"locate({self.expr(needle)}, {self.expr(hay)}, {self.expr(start)})"

    def f_ceiling(self, x):
        return f"ceil({self.expr(x)})"

    def f_square(self, x):
        return f"power({self.expr(x)}, 2)"

    def f_newid(self):
        return "uuid()"

    def f_concat(self, *args):
        return f"concat_ws('', {', '.join(f'CAST({self.expr(a)} AS STRING)' for a in args)})"

    def f_substring(self, s, start, n):
        a, k = self.expr(start), self.expr(n)
        if start.kind == "number" and int(float(start.value)) > 0:
            return f"substring({self.expr(s)}, {a}, {k})"
        return f"substring({self.expr(s)}, greatest({a}, 1), greatest({k} + least({a} - 1, 0), 0))"

    def f_left(self, s, n):
        s, k = self.expr(s), self.expr(n)
        return f"left({s}, CASE WHEN {k} < 0 THEN greatest(length({s}) + {k}, 0) ELSE {k} END)" if n.kind != "number" else f"left({s}, {k})"

    def f_right(self, s, n):
        s, k = self.expr(s), self.expr(n)
        return f"right({s}, CASE WHEN {k} < 0 THEN greatest(length({s}) + {k}, 0) ELSE {k} END)" if n.kind != "number" else f"right({s}, {k})"

    def f_getdate(self):
        return "localtimestamp()"

    f_sysdatetime = f_getdate

    def f_getutcdate(self):
        return "CAST(to_utc_timestamp(current_timestamp(), current_timezone()) AS TIMESTAMP_NTZ)"

    f_sysutcdatetime = f_getutcdate

    def f_datepart(self, p, d):
        return dates.datepart(self.word(p), self.expr(d))

    f_datename = f_datepart

    def f_datediff(self, p, a, b):
        return dates.datediff(self.word(p), self.expr(a), self.expr(b))

    f_datediff_big = f_datediff

    def f_dateadd(self, p, n, d):
        return dates.dateadd(self.word(p), self.expr(n), self.expr(d))

    def f_datefromparts(self, y, m, d):
        return f"make_date({self.expr(y)}, {self.expr(m)}, {self.expr(d)})"

    def stamp(self, y, m, d, h, mi, seconds):
        return f"make_timestamp_ntz({', '.join(map(self.expr, (y, m, d, h, mi)))}, {seconds})"

    def seconds(self, s, fraction, scale: str):
        return f"CAST({self.expr(s)} + CAST({self.expr(fraction)} AS DECIMAL(18,9)) / power(10, {scale}) AS DECIMAL(16,6))"

    def f_datetimefromparts(self, y, m, d, h, mi, s, ms):
        return self.stamp(y, m, d, h, mi, self.seconds(s, ms, "3"))

    def f_datetime2fromparts(self, y, m, d, h, mi, s, fraction, precision):
        return self.stamp(y, m, d, h, mi, self.seconds(s, fraction, self.expr(precision)))

    def f_smalldatetimefromparts(self, y, m, d, h, mi):
        return self.stamp(y, m, d, h, mi, "0")

    def f_timefromparts(self, h, mi, s, fraction, precision):
        return f"make_time({self.expr(h)}, {self.expr(mi)}, {self.seconds(s, fraction, self.expr(precision))})"

    def f_datetimeoffsetfromparts(self, y, m, d, h, mi, s, fraction, oh, om, precision):
        at = f"make_timestamp({', '.join(map(self.expr, (y, m, d, h, mi)))}, {self.seconds(s, fraction, self.expr(precision))}, 'UTC')"
        return f"({at} - make_dt_interval(0, {self.expr(oh)}, {self.expr(om)}, 0))"

    def f_suser_sname(self, *_):
        return text(self.c.values.get("user", "admin"))

    f_suser_name = f_user_name = f_original_login = f_suser_sname

    def f_scope_identity(self):
        v = self.c.values.get("@@identity")
        return "CAST(NULL AS DECIMAL(38,0))" if v is None else f"CAST({v} AS DECIMAL(38,0))"

    def f_ident_current(self, name):
        v = self.c.values.get("ident_current", {}).get(name.value.split(".")[-1].strip("[]").lower())
        return "CAST(NULL AS DECIMAL(38,0))" if v is None else f"CAST({v} AS DECIMAL(38,0))"

    def f_getvariable(self, name):
        v = self.c.values.get("variables", {}).get(name.value)
        return "CAST(NULL AS STRING)" if v is None else text(str(v))


AGGREGATES = {"count", "count_big", "sum", "min", "max", "avg", "stdev", "stdevp", "var", "varp", "string_agg"}
UNKNOWN = {"stuff", "str"}
__all__ = ["Context", "Renderer", "is_number", "quote", "text"]
