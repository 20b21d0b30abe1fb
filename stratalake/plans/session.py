"""Sessions: statements in, DataFrames out; writes with their rules; transactions.

A write first computes the affected rows as DataFrames (keys, new values), stores them
as a new scratch version, checks every rule on them, and only then replaces the table's
write state. Nothing is visible before all checks passed, and immutable versions make a
statement atomic.
"""

from __future__ import annotations

import math
import re
from dataclasses import replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions import host
from stratalake.operators import state
from stratalake.plans import door
from stratalake.plans.lake import Lake, LakeError, Table, Writes, _bind, repr_sql
from stratalake.plans.tsql.lexer import TSqlError, tokens
from stratalake.plans.tsql.parser import Node, Parser, parse
from stratalake.plans.tsql.render import Context, Renderer, quote

# fixed values: procedures that are granted without doing anything
GRANTED = {"sp_getapplock", "sp_releaseapplock"}

# fixed values: settings that clients ask for on connecting
SETTINGS = {"server_version": "16.0", "server_encoding": "UTF8", "client_encoding": "UTF8", "standard_conforming_strings": "on", "integer_datetimes": "on", "timezone": "UTC", "transaction_isolation": "read committed", "default_transaction_isolation": "read committed"}


class Result:
    """Rows of a statement, or how many rows it changed."""

    def __init__(self, df: DataFrame | None = None, affected: int | None = None):
        self.df, self.affected = df, affected


class Session:
    def __init__(self, lake: Lake, user: str = "admin", variables: dict | None = None):
        self.lake, self.user = lake, user
        self.spark = lake.spark.newSession()
        for k, v in (("spark.sql.timeType.enabled", "true"), ("spark.sql.parser.escapedStringLiterals", "true")):
            self.spark.conf.set(k, v)
        host.register(self.spark)
        for sql in [*door.SQL_FUNCTIONS, *lake.function_sql]:
            self.q(sql)
        self.variables = {**lake.config.sessionVariables, "user": user, **(variables or {})}
        self.first = dict(self.variables)
        self.values: dict = {"@@identity": None, "@@rowcount": 0, "@@trancount": 0, "@@spid": id(self) % 32767, "@@version": "stratalake", "@@servername": "stratalake", "@@language": "us_english", "user": user}
        self.assigned: dict[str, object] = {}
        self.temps: dict[str, str] = {}
        self.pending: dict[str, Writes] | None = None
        self.holds_turn = False
        self.seen: dict[str, tuple] = {}
        self.starts: dict[str, int] = {}
        self.types: dict[tuple, str | None] = {}

    def q(self, sql: str, **given) -> DataFrame:
        return self.spark.sql(door.literals(sql), **given)

    # ---- names
    def writes(self, t: Table) -> Writes:
        return (self.pending or {}).get(t.name.lower(), t.writes)

    def publish(self, text: str) -> None:
        """Registers the tables and views that a statement names, where they changed since."""
        words = {w.text.lower() for w in tokens(text) if w.kind in ("word", "name")}
        todo, done = [w for w in words if w in self.lake.tables or w in self.lake.views], set()
        while todo:
            w = todo.pop()
            if w in done:
                continue
            done.add(w)
            if w in self.lake.tables:
                t = self.lake.tables[w]
                mark = (self.lake.generation, t.version, vars(self.writes(t)).copy(), dict(self.variables))
                if self.seen.get(w) != mark:
                    self.lake.frame(w, self.spark, self.writes(t), self.variables).createOrReplaceTempView(quote(t.name))
                    self.seen[w] = mark
                    self.types.clear()
            else:
                inner = {x.text.lower() for x in tokens(self.lake.views[w][1]) if x.kind in ("word", "name")}
                todo += [x for x in inner if x in self.lake.tables]
                for x in inner & set(self.lake.views) - done:
                    self.view(x)
                    done.add(x)
                self.publish(" ".join(quote(x).replace("`", '"') for x in inner if x in self.lake.tables))
                self.view(w)

    def view(self, name: str) -> None:
        shown, body = self.lake.views[name]
        self.publish(body)
        self.q(self.renderer().query(Parser(body).query(Parser(body).ctes() if body.lstrip().upper().startswith("WITH") else []))).createOrReplaceTempView(quote(shown))

    def analyzed(self, prefix: str, sql: str) -> str | None:
        k = (prefix, sql)
        if k not in self.types:
            try:
                self.types[k] = self.q(prefix + sql).schema[0].dataType.simpleString()
            except Exception:  # correlated names cannot be analyzed alone
                self.types[k] = None
        return self.types[k]

    def counted(self, sql: str, value: bool = False) -> int:
        return self.q(sql if value else f"SELECT count(*) FROM ({sql})").first()[0]

    def renderer(self, params: dict | None = None) -> Renderer:
        given = {("@" + k.lstrip("@")).lower(): repr_sql(v) if not hasattr(v, "isoformat") else f"TIMESTAMP_NTZ'{v}'" for k, v in {**self.assigned, **(params or {})}.items()}
        values = {**self.values, "variables": self.variables, "ident_current": self.lake.identities}
        return Renderer(Context(self.analyzed, self.counted, values, set(map(str.lower, self.lake.schema.functions)), lambda n: self.temps.get(n.lower(), n) if n.startswith("#") else n, given))

    # ---- doors
    def tsql(self, text: str, params: dict | None = None) -> DataFrame | None:
        """Runs a batch; the rows of its last statement that returns any."""
        out = None
        for r in self.batch(text, params):
            out = r.df if r.df is not None else out
        return out

    def batch(self, text: str, params: dict | None = None) -> list[Result]:
        statements = parse(text)
        if any(s.kind == "query" for s in statements) or statements:
            self.publish(text)
        return [self.run(s, text, params) for s in statements]

    def sql(self, text: str, args: dict | None = None) -> DataFrame | None:
        """Spark SQL over the published tables; INSERT, UPDATE, DELETE and MERGE go the way of T-SQL."""
        text, returning = door.rewrite(text)
        verb = re.match(r"\s*(?:/\*.*?\*/\s*)*([A-Za-z_]+)", text)
        verb = verb[1].upper() if verb else ""
        if verb in ("INSERT", "UPDATE", "DELETE", "MERGE", "BEGIN", "COMMIT", "ROLLBACK"):
            if verb in ("BEGIN", "COMMIT", "ROLLBACK") and not re.search(r"(?i)tran", text):
                text = re.sub(r"(?i)^(\s*\w+).*", r"\1 TRAN", text.strip(), flags=re.S)
            if returning:
                return self.returning(text, returning, args)
            return self.tsql(text, args)
        if m := re.fullmatch(r"(?is)\s*COPY\s+(.+?)\s+TO\s+'([^']+)'\s*(?:\((.*?)\))?\s*;?\s*", text):
            return self.copy(m[1], m[2], m[3] or "", args)
        if m := re.fullmatch(r"(?is)\s*SET\s+(?:VARIABLE\s+)?(\w+)\s*(?:=|TO)\s*'?(.*?)'?\s*;?\s*", text):
            self.variables[m[1]] = m[2]
            return None
        if re.fullmatch(r"(?is)\s*CALL\s+(?:\w+_)?reload\s*\(\s*\)\s*;?\s*", text):
            self.lake.reload()
            self.seen.clear()
            return None
        if verb in ("CLOSE", "UNLISTEN", "DEALLOCATE"):
            return None
        if verb == "DISCARD":
            for name in list(self.temps):
                self.spark.catalog.dropTempView(self.temps.pop(name))
            return None
        if m := re.fullmatch(r"(?is)\s*RESET\s+(\w+)\s*;?\s*", text):
            for k in list(self.variables) if m[1].upper() == "ALL" else [m[1]]:
                if k in self.first:
                    self.variables[k] = self.first[k]
                else:
                    self.variables.pop(k, None)
            return None
        if m := re.fullmatch(r"(?is)\s*SHOW\s+(TRANSACTION\s+ISOLATION\s+LEVEL|TIME\s+ZONE|\w+)\s*;?\s*", text):
            name = {"transaction isolation level": "transaction_isolation", "time zone": "timezone"}.get(" ".join(m[1].lower().split()), m[1])
            if name in self.variables or name.lower() in SETTINGS:
                value = self.variables.get(name, SETTINGS.get(name.lower()))
                return self.spark.createDataFrame([(None if value is None else str(value),)], T.StructType([T.StructField(name.lower(), T.StringType())]))
        if m := re.fullmatch(r"(?is)\s*SUMMARIZE\s+(.*?);?\s*", text):
            self.publish(m[1])
            q = m[1] if re.match(r"(?i)\s*(select|with)\b", m[1]) else f"SELECT * FROM {m[1]}"
            return self.q(_local_names(q, self.lake)).summary()
        self.publish(text)
        return self.q(_bind(_local_names(text, self.lake), self.variables), args=args)

    def returning(self, text: str, columns: str, args: dict | None) -> DataFrame | None:
        """A write with RETURNING: its OUTPUT clause, under the other name."""
        (s,) = parse(text)
        side = "DELETED" if s.kind == "delete" else "INSERTED"
        t, _ = self.target(s)
        names = [(c.name, c.name) for c in t.columns] if columns.strip() == "*" else [((x := re.split(r"(?i)\s+AS\s+", c.strip()))[0].strip('`"'), x[-1].strip('`"')) for c in columns.split(",")]
        s.output = [Node("output", side=side, column=c.split(".")[-1], alias=a.split(".")[-1]) for c, a in names]
        self.publish(text)
        return self.run(s, text, args).df

    def copy(self, what: str, path: str, options: str, args: dict | None) -> DataFrame:
        """COPY query or table TO a folder, as Parquet, CSV or JSON lines; the number of rows."""
        kind = re.search(r"(?i)FORMAT\s+'?(\w+)", options)
        kind = kind[1].lower() if kind else path.rsplit(".", 1)[-1].lower()
        if kind not in ("parquet", "csv", "json"):
            raise LakeError(f"COPY TO knows parquet, csv and json, not {kind}", "0A000")
        inner = what.strip()
        df = self.sql(inner[1:-1] if inner.startswith("(") else f"SELECT * FROM {inner}", args)
        seen = Observation()
        w = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
        (w.option("header", "true") if kind == "csv" else w).format(kind).save(path)
        return self.spark.createDataFrame([(int(seen.get["n"]),)], "Count bigint")

    def describe(self, text: str, params: dict | None = None) -> T.StructType:
        """The columns that a query would answer with, without running it; none for other statements."""
        self.publish(text)
        queries = [s for s in parse(text) if s.kind == "query"]
        return self.q(self.renderer(params).query(queries[-1].query)).schema if queries else T.StructType()

    def explain(self, text: str) -> DataFrame:
        """The steps of a statement: rendered SQL of queries, named checks and steps of writes."""
        steps = []
        self.publish(text)
        for s in parse(text):
            if s.kind == "query":
                sql = self.renderer().query(s.query)
                plan = self.q(sql)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
                steps += [("query", sql), ("plan", plan)]
            elif s.kind in ("insert", "update", "delete", "merge"):
                t = self.target(s)[0]
                rules = [("check", f"no row of {r.table} refers to a deleted {t.name}") for r in self.lake.references if r.target.lower() == t.name.lower() and s.kind == "delete" and r.on_delete == "restrict"]
                if s.kind != "delete" and t.key and self.lake.config.checkKeys:
                    rules.append(("check", f"keys {', '.join(t.key)} stay unique"))
                steps += [*rules, ("step", f"{s.kind} {t.name}")]
            else:
                steps.append(("step", s.kind))
        return self.spark.createDataFrame(steps, "step string, statement string")

    # ---- statements
    def run(self, s: Node, text: str, params: dict | None) -> Result:
        handler = getattr(self, "s_" + s.kind)
        if s.kind in ("insert", "update", "delete", "merge"):
            r = self.write(lambda: (self.publish(text), handler(s, params))[1])
            self.publish(text)
        else:
            r = handler(s, params)
        if r.affected is not None:
            self.values["@@rowcount"] = r.affected
        return r

    def write(self, work):
        """Runs a write statement. Outside a transaction no other write comes between what it reads and what it stores."""
        alone = self.pending is None
        if alone:
            self.take_turn()
            self.lake.lock.acquire()
        try:
            # what the statement reads is at least this new; a commit compares with it
            self.starts = {name: t.version for name, t in self.lake.tables.items()}
            return work()
        finally:
            if alone:
                self.lake.lock.release()
                self.give_turn()

    def s_query(self, s: Node, params) -> Result:
        q, body = s.query, s.query.body
        if body.kind == "select":
            assigns = [i for i in body.items if i.assign]
            if assigns and len(assigns) != len(body.items):
                raise TSqlError("a SELECT that assigns variables cannot return rows as well", 141)
            if body.into:
                name, body.into = body.into, None
                return self.into(name, q, params)
            if assigns:
                names = [i.assign for i in assigns]
                for k, i in enumerate(assigns):
                    i.alias, i.assign = f"v{k}", None
                rows = self.q(self.renderer(params).query(q))
                last = rows.tail(1)
                if last:
                    self.assigned.update(zip(names, last[0], strict=True))
                return Result()
        return Result(self.q(self.renderer(params).query(q)))

    def into(self, name: str, q: Node, params) -> Result:
        if not name.startswith("#") or name.startswith("##"):
            raise TSqlError(f"SELECT INTO {name} is not supported; only temporary tables of the session")
        if name.lower() in self.temps:
            raise TSqlError(f"There is already an object named '{name}'", 2714)
        df = self.q(self.renderer(params).query(q))
        self.temp(name, df)
        return Result(affected=state.load(self.spark, self.temp_paths[name.lower()]).count())

    temp_paths: dict[str, str]

    def temp(self, name: str, df: DataFrame) -> None:
        if not hasattr(self, "_temps"):
            self._temps, self.temp_paths = True, {}
        view = "temp_" + re.sub(r"\W", "_", name[1:]).lower()
        self.temp_paths[name.lower()] = state.save(df, name)
        state.load(self.spark, self.temp_paths[name.lower()], df.schema).createOrReplaceTempView(view)
        self.temps[name.lower()] = view
        self.types.clear()

    def s_drop(self, s: Node, params) -> Result:
        view = self.temps.pop(s.name.lower(), None)
        if view is None and not s.exists:
            raise TSqlError(f"Cannot drop the table '{s.name}', because it does not exist", 3701)
        if view:
            self.spark.catalog.dropTempView(view)
        return Result()

    def s_set(self, s: Node, params) -> Result:
        return Result()

    def s_exec(self, s: Node, params) -> Result:
        if s.name.lower() in GRANTED:
            return Result(self.spark.createDataFrame([(0,)], "result int"))
        if s.name.lower() == "sp_tablecollations_100":
            if len(s.args) != 1:
                raise TSqlError("sp_tablecollations_100 takes the name of one table")
            t = self.lake.tables.get(s.args[0].split(".")[-1].strip("[]").lower())
            names = [*[c.name for c in t.columns], *[v for v, _ in t.virtual]] if t else []
            return Result(self.spark.createDataFrame([(i, n, None, None) for i, n in enumerate(names, 1)], "colid int, name string, tds_collation binary, collation_name string"))
        raise TSqlError(f"Could not find stored procedure '{s.name}'", 2812)

    # ---- transactions
    def s_begin(self, s: Node, params) -> Result:
        if self.values["@@trancount"] == 0:
            self.take_turn()
            self.pending = {}
        self.values["@@trancount"] += 1
        return Result()

    def s_save(self, s: Node, params) -> Result:
        return Result()

    def s_commit(self, s: Node, params) -> Result:
        if self.pending is None:
            raise TSqlError("The COMMIT has no corresponding BEGIN", 3902)
        self.values["@@trancount"] -= 1
        if self.values["@@trancount"] == 0:
            pending, self.pending = self.pending, None
            try:
                self.commit(pending)
            finally:
                self.give_turn()
        return Result()

    def s_rollback(self, s: Node, params) -> Result:
        if s.label:
            raise TSqlError(f"ROLLBACK to the savepoint {s.label} is not supported", 6401)
        if self.pending is None:
            raise TSqlError("The ROLLBACK has no corresponding BEGIN", 3903)
        self.pending, self.values["@@trancount"] = None, 0
        self.seen.clear()
        self.give_turn()
        return Result()

    def take_turn(self) -> None:
        if self.lake.config.serializeTransactions and not self.holds_turn:
            self.lake.turn.acquire()
            self.holds_turn = True

    def give_turn(self) -> None:
        if self.holds_turn:
            self.holds_turn = False
            self.lake.turn.release()

    def commit(self, changes: dict[str, Writes]) -> None:
        with self.lake.lock:
            for name, w in changes.items():
                t = self.lake.tables[name]
                if getattr(w, "base", t.version) != t.version:
                    raise LakeError(f"{t.name} was changed by another transaction", "40001", 3960)
            for name, w in changes.items():
                t = self.lake.tables[name]
                t.writes, t.version = Writes(w.rows, w.tombs), t.version + 1
                if self.lake.keeps:
                    self.lake.keep(t)
                elif not self.lake.config.materialize:
                    self.lake.persist(t)

    def apply(self, changes: dict[str, Writes]) -> None:
        for name, w in changes.items():
            w.base = getattr((self.pending or {}).get(name), "base", self.starts.get(name, self.lake.tables[name].version))
        if self.pending is not None:
            self.pending.update(changes)
        else:
            self.commit(changes)

    # ---- write targets
    def target(self, s: Node) -> tuple[Table, str]:
        """(table, the name that refers to it in the statement's FROM)."""
        path = s.table if s.kind in ("insert", "merge") else s.target
        name, source = path[-1], getattr(s, "source", None)
        found = []
        if s.kind in ("update", "delete") and source is not None:
            places = list(_tables(source))
            found = [p for p in places if (p.alias or "").lower() == name.lower()] or [p for p in places if p.path[-1].lower() == name.lower()]
            if len(found) > 1:
                raise TSqlError(f"the target {name} is ambiguous", 8154)
        real = found[0].path[-1] if found else name
        t = self.lake.tables.get(real.lower())
        if t is None:
            raise LakeError(f"Invalid object name '{real}'", "42P01", 208)
        if not t.writable:
            raise LakeError(f"{t.name} is read-only", "42501", 3906)
        return t, (found[0].alias or found[0].path[-1]) if found else name

    def need_key(self, t: Table, what: str) -> None:
        if not t.key:
            raise LakeError(f"{t.name} has no key, so {what} cannot find its rows", "0A000")

    def affected_frame(self, s: Node, t: Table, alias: str, items: list[tuple[str, str]], params, r: Renderer, distinct: bool) -> DataFrame:
        """The rows of a write: items over the target and its FROM tree, its WHERE, and TOP by key order."""
        source = getattr(s, "source", None)
        if source is None:
            tree = f"{quote(t.name)} AS {quote(alias)}"
        else:
            tree = r.source(source)
            if not any((p.alias or p.path[-1]).lower() == alias.lower() for p in _tables(source)):
                tree = f"{quote(t.name)} AS {quote(alias)} CROSS JOIN {tree}"
        r.scopes.append(tree)
        where = [f"{quote(alias)}.{quote(k)} IS NOT NULL" for k in t.key] if source is not None else []
        if s.where is not None:
            where.append(r.expr(s.where))
        sql = f"SELECT {'DISTINCT ' * distinct}{', '.join(f'{e} AS {quote(n)}' for n, e in items)} FROM {tree}" + (f" WHERE {' AND '.join(f'({w})' for w in where)}" if where else "")
        r.scopes.pop()
        if s.top:
            keys = ", ".join(f"{quote('_was_' + k)} NULLS LAST" for k in t.key)
            n = self.counted(f"SELECT CAST({r.expr(s.top.n)} AS DOUBLE)", value=True)
            if s.top.percent:
                n = math.ceil(self.counted(f"SELECT DISTINCT {', '.join(quote('_was_' + k) for k in t.key)} FROM ({sql})") * n / 100)
            sql = f"SELECT * FROM ({sql}) ORDER BY {keys} LIMIT {int(n)}"
        return self.q(sql)

    def pruned(self, s: Node, alias: str) -> Node | None:
        """The FROM tree of a write without outer joins of one table that nothing else reads.

        The rows that a write finds are distinct, so such a join neither adds nor removes any.
        """

        def reads(j: Node, t: Node) -> bool:
            name = (t.alias or t.path[-1]).lower()
            known = self.lake.tables.get(t.path[-1].lower())
            if name == alias.lower() or known is None:
                return True
            own = {c.name.lower() for c in known.columns} | {v.lower() for v, _ in known.virtual}
            for n in _nodes([s.source, s.where, getattr(s, "sets", None)], j.on):
                if n.kind == "star" or n.kind == "column" and (n.path[-2].lower() == name if len(n.path) > 1 else n.path[0].lower() in own):
                    return True
            return False

        def strip(x: Node) -> Node:
            if x.kind == "group":
                return Node("group", source=strip(x.source))
            if x.kind != "join":
                return x
            for kind, outer, inner in (("LEFT", x.right, x.left), ("RIGHT", x.left, x.right)):
                if x.type == kind and outer.kind == "table" and not reads(x, outer):
                    return strip(inner)
            return Node("join", type=x.type, left=strip(x.left), right=strip(x.right), on=x.on)

        joins = lambda x: sum(n.kind == "join" for n in _nodes(x))
        while s.source is not None and joins(after := strip(s.source)) < joins(s.source):
            s.source = after
        return s.source

    # ---- INSERT
    def s_insert(self, s: Node, params) -> Result:
        if s.table[-1].startswith("#"):
            return self.insert_temp(s, params)
        t, _ = self.target(s)
        if s.source is None:
            raise TSqlError("INSERT DEFAULT VALUES is not supported")
        columns = s.columns or [c.name for c in t.columns]
        body = s.source.body
        if body.kind == "values":
            r = self.renderer(params)
            for row in body.rows:
                if len(row) != len(columns):
                    raise TSqlError("the number of values does not match the column list", 213)
            defaults = [[repr(i) for i, e in enumerate(row) if e.kind == "default"] for row in body.rows]
            if any(defaults):
                rows = ["(" + ", ".join(self.default_sql(t, columns[i]) if e.kind == "default" else r.expr(e) for i, e in enumerate(row)) + ")" for row in body.rows]
                df = self.q("VALUES " + ", ".join(rows))
            else:
                df = self.q(r.query(s.source))
        else:
            df = self.q(self.renderer(params).query(s.source))
        if s.top:
            df = df.limit(int(self.counted(f"SELECT CAST({self.renderer(params).expr(s.top.n)} AS INT)", value=True)))
        return self.insert_rows(t, columns, df, s.output)

    def insert_temp(self, s: Node, params) -> Result:
        name = s.table[-1].lower()
        if name not in self.temps:
            raise TSqlError(f"Invalid object name '{name}'", 208)
        old = self.spark.table(self.temps[name])
        new = self.q(self.renderer(params).query(s.source)).toDF(*(s.columns or old.columns))
        self.temp(name, old.unionByName(new, allowMissingColumns=True))
        return Result(affected=new.count())

    def default_sql(self, t: Table, column: str) -> str:
        text = t.declared.defaults.get(column.lower()) if t.declared else None
        return self.renderer().expr(Parser(text).expr()) if text else "NULL"

    def insert_rows(self, t: Table, columns: list[str], df: DataFrame, output=None, check: bool = True) -> Result:
        virtual = {v.lower() for v, _ in t.virtual}
        for c in columns:
            if c.lower() in virtual:
                raise LakeError(f"{c} is a virtual column of {t.name} and cannot be written", "0A000")
            if t.column(c) is None:
                raise LakeError(f"Invalid column name '{c}'", "42703", 207)
        if len(df.columns) != len(columns):
            raise TSqlError("the number of values does not match the column list", 213)
        given = {c.lower(): f"c{i}" for i, c in enumerate(columns)}
        df = df.toDF(*[f"c{i}" for i in range(len(columns))])
        identity = t.declared.identity if t.declared else None
        fill_identity = identity and identity.lower() not in given
        out = []
        for c in t.columns:
            if c.name.lower() in given:
                col = F.col(given[c.name.lower()])
            elif fill_identity and c.name == identity:
                col = F.lit(None)
            else:
                col = F.expr(self.default_sql(t, c.name))
            out.append(_cast(df, col, c))
        df = df.select(*out)
        if fill_identity:
            df = self.number(t, identity, df)
        path, n = state.counted(df, t.name)
        schema = T.StructType(t.columns)
        new = state.load(self.spark, path, schema)
        if check and t.key and self.lake.config.checkKeys and (fill_identity or all(k.lower() in given for k in t.key)):
            self.check_keys(t, new)
        self.check_uniques(t, new, None)
        w = self.writes(t)
        old = state.load(self.spark, w.rows, schema) if w.rows else None
        if old is not None:
            if t.key:
                old = _anti(old, new.select(*t.key), t.key)
            path = state.save(old.unionByName(new), t.name)
        self.apply({t.name.lower(): Writes(path, w.tombs)})
        return Result(self.returned(t, output, inserted=new) if output else None, n)

    def number(self, t: Table, column: str, df: DataFrame) -> DataFrame:
        """Gives rows consecutive identities, partition by partition, from the lake's counter."""
        with self.lake.lock:
            k = t.name.lower()
            if k not in self.lake.identities:
                top = self.lake.frame(t.name, self.spark, self.writes(t), self.variables).agg(F.max(column)).first()[0]
                self.lake.identities[k] = int(top or 0)
            start = self.lake.identities[k]
            df = state.load(self.spark, state.save(df, t.name), df.schema).withColumn("_m", F.monotonically_increasing_id())
            df = state.load(self.spark, state.save(df, t.name), df.schema)
            part = F.shiftright("_m", 33)
            sizes = sorted(df.groupBy(part.alias("p")).count().collect())
            offsets, n = [], start
            for p, size in sizes:
                offsets.append((p, n))
                n += size
            self.lake.identities[k] = n
            self.values["@@identity"] = n if n > start else self.values["@@identity"]
        o = self.spark.createDataFrame(offsets or [(0, start)], "p bigint, o bigint")
        kind = t.column(column).dataType
        numbered = df.join(F.broadcast(o), part == F.col("p")).withColumn(column, (F.col("o") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).cast(kind))
        return numbered.select(*[c.name for c in t.columns])

    def bulk_insert(self, table: str, df: DataFrame) -> int:
        """Rows of a DataFrame of any session as one INSERT."""
        t = self.lake.tables[table.lower()]
        path = state.save(df, t.name + "-bulk")
        return self.write(lambda: self.insert_rows(t, df.columns, state.load(self.spark, path, df.schema))).affected

    # ---- checks
    def check_keys(self, t: Table, new: DataFrame, evicted: DataFrame | None = None) -> None:
        twice = new.groupBy(*t.key).count().filter("count > 1").select(*t.key)
        now = self.lake.frame(t.name, self.spark, self.writes(t), self.variables).select(*t.key)
        if evicted is not None:
            now = _anti(now, evicted, t.key)
        clash = _semi(new.select(*t.key), now, t.key).unionByName(twice).limit(1).collect()
        if clash:
            raise LakeError(f"Violation of PRIMARY KEY constraint: duplicate key in {t.name}: {tuple(clash[0])}", "23505", 2627)

    def check_uniques(self, t: Table, new: DataFrame, evicted: DataFrame | None) -> None:
        """Unique rules hold over materialized tables, where every column of the rule is present; nulls are distinct."""
        if not self.lake.config.materialize or not t.declared:
            return
        for rule in t.declared.uniques:
            names = [*rule, *[p for p in t.partitions if p not in rule]]
            now = self.lake.frame(t.name, self.spark, self.writes(t), self.variables)
            if evicted is not None:
                now = _anti(now, evicted, t.key)
            elif t.key:
                now = _anti(now, new.select(*t.key), t.key)
            both = now.select(*names).unionByName(new.select(*names))
            for n in rule:
                both = both.filter(F.col(n).isNotNull())
            if both.groupBy(*names).count().filter("count > 1").limit(1).count():
                raise LakeError(f"Violation of UNIQUE rule ({', '.join(rule)}) of {t.name}", "23505", 2627)

    # ---- UPDATE
    def s_update(self, s: Node, params) -> Result:
        if s.target[-1].startswith("#"):
            raise TSqlError("UPDATE of a temporary table is not supported")
        t, alias = self.target(s)
        self.need_key(t, "UPDATE")
        s.source = self.pruned(s, alias)
        r = self.renderer(params)
        sets = {}
        tree = f"{quote(t.name)} AS {quote(alias)}" if s.source is None else r.source(s.source)
        r.scopes.append(tree)
        for column, e in s.sets:
            c = t.column(column)
            if c is None:
                what = "virtual column" if column.lower() in {v.lower() for v, _ in t.virtual} else None
                raise LakeError(f"{column} is a {what} of {t.name} and cannot be written" if what else f"Invalid column name '{column}'", "0A000" if what else "42703", 207)
            sets[c.name] = self.default_sql(t, column) if e.kind == "default" else r.expr(e)
        r.scopes.pop()
        q = quote(alias)
        items = [(f"_was_{k}", f"{q}.{quote(k)}") for k in t.key]
        items += [(c.name, sets.get(c.name, f"{q}.{quote(c.name)}")) for c in t.columns]
        df = self.affected_frame(s, t, alias, items, params, r, distinct=s.source is not None)
        df = df.select(*[F.col(quote(f"_was_{k}")) for k in t.key], *[_cast(df, F.col(quote(c.name)), c) for c in t.columns])
        path, n = state.counted(df, t.name)
        df = state.load(self.spark, path, df.schema)
        was = [f"_was_{k}" for k in t.key]
        if s.source is not None and df.groupBy(*was).count().filter("count > 1").limit(1).count():
            raise LakeError(f"UPDATE of {t.name}: a row is given different values", "21000", 8672)
        moved = any(k in sets for k in t.key)
        old_keys = df.select(*[F.col(w).alias(k) for w, k in zip(was, t.key, strict=True)])
        new = df.select(*[c.name for c in t.columns])
        if moved and self.lake.config.checkKeys:
            self.check_keys(t, new, old_keys)
        self.check_uniques(t, new, old_keys)
        w = self.writes(t)
        # the first write of a table is its write state as it stands; its other columns are not read
        self.apply({t.name.lower(): self.replaced(t, old_keys, new, tomb=moved) if moved or w.rows else Writes(path, w.tombs)})
        return Result(self.returned(t, s.output, inserted=new) if s.output else None, n)

    def replaced(self, t: Table, gone: DataFrame | None, new: DataFrame | None, tomb: bool) -> Writes:
        """The write state without the keys `gone` and with the rows `new`; with tomb, the keys are hidden below as well."""
        w, schema = self.writes(t), T.StructType(t.columns)
        rows = state.load(self.spark, w.rows, schema) if w.rows else None
        if rows is not None and gone is not None:
            rows = _anti(rows, gone, t.key)
        if new is not None:
            rows = new if rows is None else rows.unionByName(new)
        tombs = state.load(self.spark, w.tombs) if w.tombs else None
        if tomb and gone is not None:
            tombs = gone.distinct() if tombs is None else tombs.unionByName(gone).distinct()
        return Writes(state.save(rows, t.name) if rows is not None else None, state.save(tombs, t.name + "-deleted") if tombs is not None else None)

    # ---- DELETE
    def s_delete(self, s: Node, params) -> Result:
        if s.target[-1].startswith("#"):
            return self.delete_temp(s, params)
        t, alias = self.target(s)
        self.need_key(t, "DELETE")
        s.source = self.pruned(s, alias)
        r = self.renderer(params)
        items = [(f"_was_{k}", f"{quote(alias)}.{quote(k)}") for k in t.key]
        df = self.affected_frame(s, t, alias, items, params, r, distinct=True)
        keys = df.toDF(*t.key)
        path, n = state.counted(keys, t.name)
        keys = state.load(self.spark, path, keys.schema)
        changes: dict[str, Writes] = {}
        self.removed(t, keys, changes)
        self.apply(changes)
        return Result(self.returned(t, s.output, deleted=keys) if s.output else None, n)

    def delete_temp(self, s: Node, params) -> Result:
        name = s.target[-1].lower()
        if name not in self.temps:
            raise TSqlError(f"Invalid object name '{name}'", 208)
        r, alias = self.renderer(params), s.target[-1]
        old = self.spark.table(self.temps[name]).withColumn("_row", F.monotonically_increasing_id())
        path = state.save(old, name)
        view = self.temps[name] + "_rows"
        state.load(self.spark, path, old.schema).createOrReplaceTempView(view)
        shown, self.temps[name] = self.temps[name], view
        try:
            tree = r.source(s.source) if s.source is not None else f"{quote(view)} AS {quote(alias)}"
            gone = self.q(f"SELECT DISTINCT {quote(alias)}._row FROM {tree}" + (f" WHERE {r.expr(s.where)}" if s.where is not None else ""))
            rest = state.load(self.spark, path, old.schema).join(gone, "_row", "left_anti").drop("_row")
            n = gone.count()
            self.temp(name, rest)
        finally:
            if self.temps[name] == view:
                self.temps[name] = shown
        return Result(affected=n)

    def removed(self, t: Table, keys: DataFrame, changes: dict[str, Writes]) -> None:
        """Deletes keys and what the references make of their children, level by level; every check comes before anything is stored."""
        current = lambda x: self.lake.frame(x.name, self.spark, changes.get(x.name.lower(), self.writes(x)), self.variables)
        todo = [(t, keys)]
        while todo:
            t, keys = todo.pop(0)
            with _Overlay(self, changes):
                changes[t.name.lower()] = self.replaced(t, keys, None, tomb=True)
            for ref in [r for r in self.lake.references if r.target.lower() == t.name.lower()]:
                child = self.lake.tables[ref.table.lower()]
                pairs = list(zip(ref.columns, t.key, strict=True))
                hit = current(child).join(keys.select(*[F.col(k).alias(f"__p{i}") for i, (_, k) in enumerate(pairs)]), [F.col(quote(c)) == F.col(f"__p{i}") for i, (c, _) in enumerate(pairs)], "left_semi")
                if ref.on_delete == "restrict":
                    if hit.limit(1).count():
                        raise LakeError(f"The DELETE statement conflicted with the REFERENCE constraint {ref.name}: {child.name} refers to {t.name}", "23503", 547)
                    continue
                path, n = state.counted(hit.select(*[c.name for c in child.columns]), child.name)
                if not n:
                    continue
                hit = state.load(self.spark, path, T.StructType(child.columns))
                if ref.on_delete == "cascade":
                    todo.append((child, hit.select(*child.key)))
                else:
                    names = {c.lower() for c in ref.columns}
                    value = lambda c: F.expr(self.default_sql(child, c.name)) if ref.on_delete == "default" else F.lit(None)  # noqa: B023, E731
                    new = hit.select(*[(value(c) if c.name.lower() in names else F.col(quote(c.name))).cast(c.dataType).alias(c.name) for c in child.columns])
                    with _Overlay(self, changes):
                        changes[child.name.lower()] = self.replaced(child, hit.select(*child.key), new, tomb=False)

    # ---- MERGE
    def s_merge(self, s: Node, params) -> Result:
        alias = s.alias or s.table[-1]
        if s.clause.kind == "update":
            source = Node("join", type="INNER", left=Node("table", path=s.table, alias=alias), right=s.source, on=s.on)
            return self.s_update(Node("update", target=[alias], sets=s.clause.sets, source=source, where=None, output=s.output, top=None), params)
        items = [Node("item", expr=e, alias=f"c{i}", assign=None) for i, e in enumerate(s.clause.values)]
        select = Node("select", distinct=False, top=None, items=items, into=None, source=s.source, where=None, group=[], having=None)
        q = Node("q", ctes=[], body=select, order=[], offset=None, fetch=None)
        return self.s_insert(Node("insert", table=s.table, columns=s.clause.columns, source=q, output=s.output, top=None), params)

    def returned(self, t: Table, output: list[Node], inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
        out = []
        for o in output:
            if o.side == "DELETED" and deleted is None:
                raise TSqlError("OUTPUT of DELETED is not supported here")
            df = deleted if deleted is not None else inserted
            found = next((c for c in df.columns if c.lower() == o.column.lower()), None)
            if found is None:
                raise LakeError(f"OUTPUT of {o.column}: a delete returns key columns only" if deleted is not None else f"Invalid column name '{o.column}'", "42703", 207)
            out.append(F.col(quote(found)).alias(o.alias))
        return (deleted if deleted is not None else inserted).select(*out)


class _Overlay:
    """Shows changes of the running statement to `Session.writes`."""

    def __init__(self, session: Session, changes: dict[str, Writes]):
        self.session, self.changes = session, changes

    def __enter__(self):
        self.before = self.session.pending
        self.session.pending = {**(self.before or {}), **self.changes}

    def __exit__(self, *_):
        self.session.pending = self.before


def _nodes(x, without: Node | None = None):
    """Every node of a tree but those below `without`."""
    if isinstance(x, Node):
        if x is without:
            return
        yield x
        x = list(vars(x).values())
    if isinstance(x, (list, tuple)):
        for v in x:
            yield from _nodes(v, without)


def _tables(s: Node):
    if s.kind == "table":
        yield s
    elif s.kind == "join":
        yield from _tables(s.left)
        yield from _tables(s.right)
    elif s.kind == "group":
        yield from _tables(s.source)


def _on(left: DataFrame, right: DataFrame, key: list[str]):
    r = right.select(*[F.col(quote(k)).alias(f"__k{i}") for i, k in enumerate(key)])
    return r, [left[k].eqNullSafe(r[f"__k{i}"]) for i, k in enumerate(key)]


def _anti(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    r, on = _on(df, keys, key)
    return df.join(r, on, "left_anti")


def _semi(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    r, on = _on(df, keys, key)
    return df.join(r, on, "left_semi")


def _cast(df: DataFrame, col, c: T.StructField):
    """To the column's type, with the dialect's rounding to integers."""
    if isinstance(c.dataType, (T.ShortType, T.IntegerType, T.LongType)):
        kind = df.select(col.alias("x")).schema[0].dataType
        if isinstance(kind, T.DecimalType):
            col = F.round(col)
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            col = F.rint(col)
    return col.cast(c.dataType).alias(c.name)


def _local_names(text: str, lake: Lake) -> str:
    """Strips the lake's schema (and dbo) before a published name, outside quotes and comments."""
    toks, out, last = tokens(text.replace("`", '"')), [], 0
    for i, t in enumerate(toks[:-2]):
        if t.kind in ("word", "name") and t.text.lower() in (lake.config.schema.lower(), "dbo") and toks[i + 1].text == "." and toks[i + 2].text.lower() in {*lake.tables, *lake.views}:
            out.append(text[last : t.at])
            last = toks[i + 2].at
    return "".join([*out, text[last:]])


__all__ = ["Result", "Session", "replace"]
