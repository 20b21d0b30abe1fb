"""A recursive-descent parser of the T-SQL subset. Trees are `Node`s: a kind and fields."""

from __future__ import annotations

import logging

from stratalake.plans.tsql.lexer import Token, TSqlError, tokens

log = logging.getLogger("stratalake")


class Node:
    def __init__(self, kind: str, **fields):
        self.kind = kind
        self.__dict__.update(fields)

    def __repr__(self):
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items() if k != 'kind')})"


#: Words that end an implicit alias.
RESERVED = set(
    """SELECT FROM WHERE GROUP HAVING ORDER UNION EXCEPT INTERSECT ON JOIN INNER LEFT RIGHT FULL CROSS OUTER AS AND OR NOT IN IS NULL
    LIKE BETWEEN EXISTS CASE WHEN THEN ELSE END SET VALUES INTO WITH OFFSET FETCH TOP DISTINCT ALL INSERT UPDATE DELETE MERGE USING OUTPUT
    BEGIN COMMIT ROLLBACK SAVE EXEC EXECUTE DROP DECLARE IF WHILE CREATE ALTER PRINT RETURN OPTION FOR ESCAPE BY DEFAULT OVER LOOP HASH REMOTE""".split()
)


class Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.i = text, tokens(text), 0

    # ---- cursor
    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def word(self, *words: str) -> bool:
        """Whether the next tokens are these words."""
        return all(self.ahead(k).upper == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.word(*words):
            self.i += len(words)
            return True
        return False

    def op(self, text: str) -> bool:
        if self.tok.kind == "op" and self.tok.text == text:
            self.i += 1
            return True
        return False

    def is_op(self, text: str, n: int = 0) -> bool:
        return self.ahead(n).kind == "op" and self.ahead(n).text == text

    def need(self, *words: str) -> None:
        if not self.take(*words):
            self.fail(f"expected {' '.join(words)}")

    def need_op(self, text: str) -> None:
        if not self.op(text):
            self.fail(f"expected {text!r}")

    def fail(self, what: str):
        found = self.tok.text or "end of text"
        raise TSqlError(f"{what}, found {found!r} at position {self.tok.at}")

    def refuse(self, what: str):
        raise TSqlError(f"{what} at position {self.tok.at}")

    def name(self) -> str:
        t = self.tok
        if t.kind == "name" or t.kind == "word" and t.upper not in RESERVED:
            self.i += 1
            return t.text
        self.fail("expected a name")

    def dotted(self) -> list[str]:
        out = [self.name()]
        while self.op("."):
            out.append("dbo" if self.is_op(".") else self.name())
        return out

    # ---- statements
    def batch(self) -> list[Node]:
        out = []
        while self.tok.kind != "end":
            if self.op(";"):
                continue
            out.append(self.statement())
        return out

    def statement(self) -> Node:
        w = self.tok.upper
        if w in ("SELECT", "WITH", "VALUES") or self.is_op("("):
            with_ = self.ctes() if w == "WITH" else []
            if self.word("INSERT") or self.word("UPDATE") or self.word("DELETE") or self.word("MERGE"):
                self.refuse("a WITH clause before a write is not supported")
            return Node("query", query=self.query(with_))
        method = {"INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete, "MERGE": self.merge, "SET": self.set_, "EXEC": self.exec_, "EXECUTE": self.exec_, "DROP": self.drop}.get(w)
        if method:
            self.i += 1
            return method()
        if w in ("BEGIN", "COMMIT", "ROLLBACK", "SAVE") and (self.ahead().upper in ("TRAN", "TRANSACTION", "WORK") or w in ("COMMIT", "ROLLBACK")):
            self.i += 1
            self.take("TRAN") or self.take("TRANSACTION") or self.take("WORK")
            label = self.name() if self.tok.kind in ("word", "name", "param") and self.tok.upper not in RESERVED else None
            return Node(w.lower(), label=label)
        self.refuse(f"unsupported statement {self.tok.text}")

    def insert(self) -> Node:
        top = self.top()
        self.take("INTO")
        table, columns = self.dotted(), None
        if self.is_op("(") and self.ahead().upper not in ("SELECT", "WITH", "VALUES"):
            columns = self.names()
        output = self.output()
        if self.take("DEFAULT", "VALUES"):
            return Node("insert", table=table, columns=[], source=None, output=output, top=top)
        return Node("insert", table=table, columns=columns, source=self.query(self.ctes() if self.word("WITH") else []), output=output, top=top)

    def names(self) -> list[str]:
        self.need_op("(")
        out = [self.name()]
        while self.op(","):
            out.append(self.name())
        self.need_op(")")
        return out

    def output(self) -> list[Node] | None:
        if not self.take("OUTPUT"):
            return None
        items = []
        while True:
            side = self.tok.upper
            if side not in ("INSERTED", "DELETED"):
                self.refuse("OUTPUT returns columns of INSERTED or DELETED only")
            self.i += 1
            self.need_op(".")
            if self.is_op("*"):
                self.refuse("OUTPUT * is not supported")
            column = self.name()
            alias = self.name() if self.take("AS") or self.tok.kind in ("word", "name") and self.tok.upper not in RESERVED else column
            items.append(Node("output", side=side, column=column, alias=alias))
            if not self.op(","):
                break
        if self.word("INTO"):
            self.refuse("OUTPUT INTO is not supported")
        return items

    def assignments(self) -> list[tuple[str, Node]]:
        out = []
        while True:
            column = self.dotted()[-1]
            self.need_op("=")
            out.append((column, Node("default") if self.take("DEFAULT") else self.expr()))
            if not self.op(","):
                return out

    def update(self) -> Node:
        top, target = self.top(), self.dotted()
        self.hints()
        self.need("SET")
        sets, output = self.assignments(), self.output()
        source = self.from_() if self.take("FROM") else None
        return Node("update", target=target, sets=sets, source=source, where=self.expr() if self.take("WHERE") else None, output=output, top=top)

    def delete(self) -> Node:
        top = self.top()
        self.take("FROM")
        target = self.dotted()
        self.hints()
        output = self.output()
        source = self.from_() if self.take("FROM") or self.take("USING") else None
        return Node("delete", target=target, source=source, where=self.expr() if self.take("WHERE") else None, output=output, top=top)

    def merge(self) -> Node:
        self.take("INTO")
        table = self.dotted()
        self.hints()
        alias = self.alias()
        self.need("USING")
        source = self.primary_source()
        self.need("ON")
        on = self.expr()
        clauses = []
        while self.take("WHEN"):
            negated = self.take("NOT")
            self.need("MATCHED")
            if self.word("BY") or self.word("AND"):
                self.refuse(f"MERGE with WHEN {'NOT ' * negated}MATCHED {self.tok.upper} is not supported")
            self.need("THEN")
            if negated:
                self.need("INSERT")
                columns = self.names()
                self.need("VALUES")
                self.need_op("(")
                values = self.list()
                self.need_op(")")
                clauses.append(Node("insert", columns=columns, values=values))
            elif self.take("UPDATE"):
                self.need("SET")
                clauses.append(Node("update", sets=self.assignments()))
            else:
                self.refuse(f"MERGE with WHEN MATCHED THEN {self.tok.upper} is not supported")
        output = self.output()
        self.op(";")
        if len(clauses) != 1:
            self.refuse("MERGE takes exactly one WHEN clause here")
        never = on.kind == "binary" and on.op == "=" and all(x.kind == "number" for x in (on.left, on.right)) and on.left.value != on.right.value
        if clauses[0].kind == "insert" and not never:
            self.refuse("MERGE inserts only ON a condition that never holds (1 = 0)")
        return Node("merge", table=table, alias=alias, source=source, on=on, clause=clauses[0], output=output)

    def set_(self) -> Node:
        if self.tok.kind == "param":
            self.refuse("SET of a variable is not supported")
        words = []
        while self.tok.kind not in ("end",) and not self.is_op(";"):
            words.append(self.tok.text)
            self.i += 1
        return Node("set", words=words)

    def exec_(self) -> Node:
        if self.is_op("("):
            self.refuse("EXEC of a text is not supported")
        while self.op("."):  # empty parts before the name
            pass
        name, args = self.dotted()[-1], []
        while self.tok.kind not in ("end",) and not self.is_op(";"):
            args.append(self.tok.text)
            self.i += 1
        return Node("exec", name=name, args=args)

    def drop(self) -> Node:
        self.need("TABLE")
        exists = self.take("IF", "EXISTS")
        name = self.dotted()[-1]
        if not name.startswith("#") or name.startswith("##"):
            self.refuse(f"DROP TABLE of {name} is not supported; only temporary tables of the session can be dropped")
        return Node("drop", name=name, exists=exists)

    # ---- queries
    def ctes(self) -> list[Node]:
        self.need("WITH")
        out = []
        while True:
            name = self.name()
            columns = self.names() if self.is_op("(") else None
            self.need("AS")
            self.need_op("(")
            out.append(Node("cte", name=name, columns=columns, query=self.query(self.ctes() if self.word("WITH") else [])))
            self.need_op(")")
            if not self.op(","):
                return out

    def query(self, with_: list[Node] = ()) -> Node:
        q = Node("q", ctes=list(with_), body=self.union(), order=[], offset=None, fetch=None)
        if self.take("ORDER", "BY"):
            q.order = self.order()
        if self.take("OFFSET"):
            q.offset = self.expr()
            self.take("ROWS") or self.take("ROW")
            if self.take("FETCH"):
                self.take("NEXT") or self.take("FIRST")
                q.fetch = self.expr()
                self.take("ROWS") or self.take("ROW")
                self.need("ONLY")
        if q.fetch is not None and q.body.kind == "select" and q.body.top:
            self.refuse("TOP and FETCH cannot stand together")
        if self.take("OPTION"):
            self.parens()
        return q

    def parens(self) -> None:
        self.need_op("(")
        depth = 1
        while depth:
            if self.tok.kind == "end":
                self.fail("expected ')'")
            depth += self.is_op("(") - self.is_op(")")
            self.i += 1

    def order(self) -> list[tuple[Node, bool]]:
        out = []
        while True:
            e = self.expr()
            desc = self.take("DESC")
            self.take("ASC")
            out.append((e, desc))
            if not self.op(","):
                return out

    def union(self) -> Node:
        left = self.intersect()
        while self.word("UNION") or self.word("EXCEPT"):
            kind = self.tok.upper
            self.i += 1
            left = Node("setop", op=kind + " ALL" * self.take("ALL"), left=left, right=self.intersect())
        return left

    def intersect(self) -> Node:
        left = self.term_query()
        while self.take("INTERSECT"):
            left = Node("setop", op="INTERSECT" + " ALL" * self.take("ALL"), left=left, right=self.term_query())
        return left

    def term_query(self) -> Node:
        if self.op("("):
            q = self.query(self.ctes() if self.word("WITH") else [])
            self.need_op(")")
            return Node("nested", query=q)
        if self.take("VALUES"):
            rows = []
            while True:
                self.need_op("(")
                rows.append(self.list(default=True))
                self.need_op(")")
                if not self.op(","):
                    return Node("values", rows=rows)
        return self.select()

    def top(self) -> Node | None:
        if not self.take("TOP"):
            return None
        if self.op("("):
            n = self.expr()
            self.need_op(")")
        else:
            n = self.primary()
        percent = self.take("PERCENT")
        ties = self.take("WITH", "TIES")
        if ties:
            log.warning("TOP .. WITH TIES: the ties are ignored")
        return Node("top", n=n, percent=percent, ties=ties)

    def select(self) -> Node:
        self.need("SELECT")
        s = Node("select", distinct=self.take("DISTINCT"), top=None, items=[], into=None, source=None, where=None, group=[], having=None)
        self.take("ALL")
        s.top = self.top()
        while True:
            s.items.append(self.item())
            if not self.op(","):
                break
        if self.take("INTO"):
            s.into = self.dotted()[-1]
        if self.take("FROM"):
            s.source = self.from_()
        if self.take("WHERE"):
            s.where = self.expr()
        if self.take("GROUP", "BY"):
            if self.word("GROUPING"):
                self.refuse("GROUPING SETS is not supported")
            s.group = self.list()
        if self.take("HAVING"):
            s.having = self.expr()
        return s

    def item(self) -> Node:
        if self.op("*"):
            return Node("item", expr=Node("star", path=[]), alias=None, assign=None)
        if self.tok.kind == "param" and self.is_op("=", 1):
            name = self.tok.text
            self.i += 2
            return Node("item", expr=self.expr(), alias=None, assign=name)
        if self.tok.kind in ("word", "name") and self.tok.upper not in RESERVED and self.is_op("=", 1):
            alias = self.name()
            self.i += 1
            return Node("item", expr=self.expr(), alias=alias, assign=None)
        e = self.expr()
        alias = None
        if self.take("AS") or self.tok.kind == "string" or self.tok.kind in ("word", "name") and self.tok.upper not in RESERVED:
            if self.tok.kind == "string":
                alias = self.tok.text
                self.i += 1
            else:
                alias = self.name()
        return Node("item", expr=e, alias=alias, assign=None)

    def list(self, default: bool = False) -> list[Node]:
        one = lambda: Node("default") if default and self.take("DEFAULT") else self.expr()
        out = [one()]
        while self.op(","):
            out.append(one())
        return out

    # ---- sources
    def from_(self) -> Node:
        left = self.joined()
        while self.op(","):
            left = Node("join", type="CROSS", left=left, right=self.joined(), on=None)
        return left

    def joined(self) -> Node:
        left = self.primary_source()
        while True:
            j = self.join_type()
            if j is None:
                return left
            if j == "CROSS":
                left = Node("join", type=j, left=left, right=self.primary_source(), on=None)
                continue
            right = self.joined_right()
            self.need("ON")
            left = Node("join", type=j, left=left, right=right, on=self.expr())

    def joined_right(self) -> Node:
        """The right side of a join: more joins come before its ON if they bring their own."""
        right = self.primary_source()
        while self.starts_join():
            j = self.join_type()
            if j == "CROSS":
                right = Node("join", type=j, left=right, right=self.primary_source(), on=None)
                continue
            inner = self.joined_right()
            self.need("ON")
            right = Node("join", type=j, left=right, right=inner, on=self.expr())
        return right

    def starts_join(self) -> bool:
        return self.tok.upper in ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS")

    def join_type(self) -> str | None:
        if not self.starts_join():
            return None
        if self.take("CROSS"):
            if self.word("APPLY"):
                self.refuse("CROSS APPLY is not supported")
            self.need("JOIN")
            return "CROSS"
        kind = "INNER"
        if self.tok.upper in ("INNER", "LEFT", "RIGHT", "FULL"):
            kind = self.tok.upper
            self.i += 1
            self.take("OUTER")
        for hint in ("LOOP", "HASH", "MERGE", "REMOTE"):
            self.take(hint)
        self.need("JOIN")
        return kind

    def alias(self) -> str | None:
        if self.take("AS") or self.tok.kind in ("word", "name") and self.tok.upper not in RESERVED:
            return self.name()
        return None

    def hints(self) -> None:
        if self.word("WITH") and self.is_op("(", 1):
            self.i += 1
            self.parens()

    def primary_source(self) -> Node:
        if self.op("("):
            if self.tok.upper in ("SELECT", "WITH", "VALUES") or self.is_op("("):
                at = self.i
                try:
                    q = self.query(self.ctes() if self.word("WITH") else [])
                    self.need_op(")")
                except TSqlError:
                    if not self.toks[at].text == "(":
                        raise
                    self.i = at
                    inner = self.from_()
                    self.need_op(")")
                    return Node("group", source=inner)
                alias = self.alias()
                return Node("derived", query=q, alias=alias, columns=self.names() if self.is_op("(") else None)
            inner = self.from_()
            self.need_op(")")
            return Node("group", source=inner)
        if self.word("OPENJSON"):
            return self.openjson()
        path = self.dotted()
        if self.is_op("("):
            self.i += 1
            args = [] if self.is_op(")") else self.list()
            self.need_op(")")
            return Node("function_source", name=path[-1], args=args, alias=self.alias())
        self.hints()
        alias = self.alias()
        self.hints()
        return Node("table", path=path, alias=alias)

    def openjson(self) -> Node:
        self.i += 1
        self.need_op("(")
        doc = self.expr()
        path = self.expr() if self.op(",") else None
        self.need_op(")")
        columns = None
        if self.word("WITH") and self.is_op("(", 1):
            self.i += 2
            columns = []
            while True:
                name, kind = self.name(), self.type()
                at = None
                if self.tok.kind == "string":
                    at = self.tok.text
                    self.i += 1
                if self.word("AS"):
                    self.refuse("OPENJSON columns AS JSON are not supported")
                columns.append((name, kind, at))
                if not self.op(","):
                    break
            self.need_op(")")
        return Node("openjson", doc=doc, path=path, columns=columns, alias=self.alias())

    # ---- expressions
    def expr(self) -> Node:
        left = self.and_()
        while self.take("OR"):
            left = Node("binary", op="OR", left=left, right=self.and_())
        return left

    def and_(self) -> Node:
        left = self.not_()
        while self.take("AND"):
            left = Node("binary", op="AND", left=left, right=self.not_())
        return left

    def not_(self) -> Node:
        return Node("not", expr=self.not_()) if self.take("NOT") else self.comparison()

    def comparison(self) -> Node:
        left = self.additive()
        while True:
            if self.take("IS"):
                negated = self.take("NOT")
                self.need("NULL")
                left = Node("isnull", expr=left, negated=negated)
                continue
            negated = self.word("NOT") and self.ahead().upper in ("IN", "BETWEEN", "LIKE") and self.take("NOT")
            if self.take("IN"):
                self.need_op("(")
                if self.tok.upper in ("SELECT", "WITH", "VALUES"):
                    left = Node("in", expr=left, query=self.query(self.ctes() if self.word("WITH") else []), values=None, negated=negated)
                else:
                    left = Node("in", expr=left, query=None, values=self.list(), negated=negated)
                self.need_op(")")
            elif self.take("BETWEEN"):
                low = self.additive()
                self.need("AND")
                left = Node("between", expr=left, low=low, high=self.additive(), negated=negated)
            elif self.take("LIKE"):
                pattern = self.additive()
                left = Node("like", expr=left, pattern=pattern, escape=self.additive() if self.take("ESCAPE") else None, negated=negated)
            elif self.tok.kind == "op" and self.tok.text in ("=", "<>", "!=", "<", "<=", ">", ">="):
                op = self.tok.text
                self.i += 1
                left = Node("binary", op="<>" if op == "!=" else op, left=left, right=self.additive())
            else:
                return left

    def additive(self) -> Node:
        left = self.multiplicative()
        while self.tok.kind == "op" and self.tok.text in ("+", "-", "&", "|", "^", "||"):
            op = self.tok.text
            self.i += 1
            left = Node("binary", op=op, left=left, right=self.multiplicative())
        return left

    def multiplicative(self) -> Node:
        left = self.unary()
        while self.tok.kind == "op" and self.tok.text in ("*", "/", "%"):
            op = self.tok.text
            self.i += 1
            left = Node("binary", op=op, left=left, right=self.unary())
        return left

    def unary(self) -> Node:
        if self.tok.kind == "op" and self.tok.text in ("-", "+", "~"):
            op = self.tok.text
            self.i += 1
            return Node("unary", op=op, expr=self.unary())
        return self.primary()

    def primary(self) -> Node:
        t = self.tok
        if t.kind == "number":
            self.i += 1
            return Node("number", value=t.text)
        if t.kind == "string":
            self.i += 1
            return Node("string", value=t.text)
        if t.kind == "hex":
            self.i += 1
            return Node("hex", value=t.text)
        if t.kind == "param":
            self.i += 1
            return Node("param", name=t.text)
        if self.op("("):
            if self.tok.upper in ("SELECT", "WITH", "VALUES"):
                q = self.query(self.ctes() if self.word("WITH") else [])
                self.need_op(")")
                return Node("scalar", query=q)
            e = self.expr()
            self.need_op(")")
            return Node("paren", expr=e)
        w = t.upper
        if w in ("NULL", "TRUE", "FALSE"):
            self.i += 1
            return Node("literal", value=w)
        if w == "EXISTS":
            self.i += 1
            self.need_op("(")
            q = self.query(self.ctes() if self.word("WITH") else [])
            self.need_op(")")
            return Node("exists", query=q)
        if w == "CASE":
            return self.case()
        if w in ("CAST", "TRY_CAST") and self.is_op("(", 1):
            self.i += 2
            e = self.expr()
            self.need("AS")
            kind = self.type()
            self.need_op(")")
            return Node("cast", expr=e, type=kind, attempt=w == "TRY_CAST")
        if w in ("CONVERT", "TRY_CONVERT") and self.is_op("(", 1):
            self.i += 2
            kind = self.type()
            self.need_op(",")
            e = self.expr()
            style = self.expr() if self.op(",") else None
            self.need_op(")")
            return Node("convert", expr=e, type=kind, style=style, attempt=w == "TRY_CONVERT")
        if w in ("LEFT", "RIGHT") and self.is_op("(", 1):
            self.i += 1
            return self.call([t.text])
        path = self.dotted_or_star()
        if path[-1] == "*":
            return Node("star", path=path[:-1])
        if self.is_op("("):
            return self.call(path)
        return Node("column", path=path)

    def dotted_or_star(self) -> list[str]:
        out = [self.name()]
        while self.op("."):
            if self.op("*"):
                return [*out, "*"]
            out.append("dbo" if self.is_op(".") else self.name())
        return out

    def case(self) -> Node:
        self.need("CASE")
        subject = None if self.word("WHEN") else self.expr()
        whens = []
        while self.take("WHEN"):
            cond = self.expr()
            self.need("THEN")
            whens.append((cond, self.expr()))
        other = self.expr() if self.take("ELSE") else None
        self.need("END")
        return Node("case", subject=subject, whens=whens, other=other)

    def call(self, path: list[str]) -> Node:
        self.need_op("(")
        distinct = self.take("DISTINCT")
        self.take("ALL")
        if self.op("*"):
            args = [Node("star", path=[])]
        elif self.is_op(")"):
            args = []
        else:
            args = self.list()
        self.need_op(")")
        over = None
        if self.take("OVER"):
            self.need_op("(")
            over = Node("over", partition=[], order=[])
            if self.take("PARTITION", "BY"):
                over.partition = self.list()
            if self.take("ORDER", "BY"):
                over.order = self.order()
            if self.word("ROWS") or self.word("RANGE"):
                self.refuse("window frames are not supported")
            self.need_op(")")
        return Node("call", path=path, args=args, distinct=distinct, over=over)

    def type(self) -> tuple[str, list[str]]:
        name = self.name().lower()
        if name == "double" and self.take("PRECISION"):
            name = "float"
        args = []
        if self.op("("):
            while not self.op(")"):
                args.append(self.tok.text)
                self.i += 1
                self.op(",")
        return name, args


def parse(text: str) -> list[Node]:
    return Parser(text).batch()
