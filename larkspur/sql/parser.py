"""Statements of the MySQL dialect as syntax trees: a recursive-descent parser with precedence climbing for expressions."""

from __future__ import annotations

from larkspur.sql.lexer import SQLError, Token, tokenize
from larkspur.sql.nodes import Node

#: Words that end an expression or a table reference, so they are no aliases.
RESERVED = set(
    "SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT MINUS JOIN INNER LEFT RIGHT FULL CROSS NATURAL STRAIGHT_JOIN ON USING AS SET VALUES VALUE "
    "AND OR XOR NOT IN IS LIKE REGEXP RLIKE BETWEEN CASE WHEN THEN ELSE END DIV MOD COLLATE FOR LOCK USE IGNORE FORCE INTO WITH WINDOW OVER DISTINCT ALL ANY SOME EXISTS BY ASC DESC "
    "SEPARATOR PARTITION ROWS RANGE ESCAPE INTERVAL BINARY RETURNING".split()
)
#: Binding strength of infix operators, loosest first.
BINARY = {"OR": 1, "||": 1, "XOR": 2, "AND": 3, "&&": 3, "|": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "DIV": 11, "%": 11, "MOD": 11, "^": 12}
COMPARISONS = {"=", "<=>", ">=", ">", "<=", "<", "<>", "!="}
NOT_POWER, COMPARISON, UNARY = 4, 6, 13
UNITS = set("MICROSECOND SECOND MINUTE HOUR DAY WEEK MONTH QUARTER YEAR".split())
#: Functions that are written without parentheses.
BARE = set("CURRENT_TIMESTAMP CURRENT_DATE CURRENT_TIME LOCALTIME LOCALTIMESTAMP UTC_TIMESTAMP UTC_DATE UTC_TIME CURRENT_USER".split())


class Parser:
    def __init__(self, sql: str) -> None:
        self.sql, self.tokens, self.i, self.binds = sql, tokenize(sql), 0, 0

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.now
        self.i += t.kind != "end"
        return t

    def fail(self, wanted: str) -> SQLError:
        t = self.now
        return SQLError(f"expected {wanted} at position {t.at}, near {self.sql[t.at : t.at + 20]!r}" if t.kind != "end" else f"expected {wanted} at the end")

    def at(self, *words: str) -> bool:
        """Whether the next tokens are these words."""
        return all(self.ahead(n).upper == w for n, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def take_any(self, *words: str) -> str:
        return self.next().upper if self.now.upper in words else ""

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.fail(" ".join(words))

    def op(self, *ops: str) -> str:
        return self.next().text if self.now.kind == "op" and self.now.text in ops else ""

    def need_op(self, op: str) -> None:
        if not self.op(op):
            raise self.fail(repr(op))

    def name(self) -> str:
        t = self.now
        if t.kind == "name" or (t.kind == "word" and (t.upper not in RESERVED or t.upper in ("VALUE", "MOD", "PARTITION"))):
            return self.next().text
        raise self.fail("a name")

    def any_name(self) -> str:
        if self.now.kind in ("word", "name"):
            return self.next().text
        raise self.fail("a name")

    def table_name(self) -> Node:
        a = self.name()
        return Node("name", db=a, name=self.any_name()) if self.op(".") else Node("name", db=None, name=a)

    def names(self) -> list[str]:
        self.need_op("(")
        out = [self.name()]
        while self.op(","):
            out.append(self.name())
        self.need_op(")")
        return out

    def listed(self, item):
        out = [item()]
        while self.op(","):
            out.append(item())
        return out

    def rest(self) -> None:
        self.i = len(self.tokens) - 1

    # expressions

    def expr(self, power: int = 0) -> Node:
        if self.now.upper == "NOT" and power <= NOT_POWER:
            self.next()
            left = Node("not", x=self.expr(NOT_POWER))
        else:
            left = self.unary()
        while True:
            t = self.now
            word = t.text if t.kind == "op" else t.upper
            if word in BINARY and BINARY[word] > power:
                self.next()
                left = Node("binary", op={"&&": "AND", "||": "OR", "MOD": "%"}.get(word, word), a=left, b=self.expr(BINARY[word]))
            elif power < COMPARISON and (found := self.comparison(left)):
                left = found
            else:
                return left

    def comparison(self, left: Node) -> Node | None:
        if self.now.kind == "op" and self.now.text in COMPARISONS:
            op = self.next().text.replace("!=", "<>")
            if how := self.take_any("ANY", "SOME", "ALL"):
                self.need_op("(")
                q = self.query()
                self.need_op(")")
                return Node("quantified", op=op, how="ALL" if how == "ALL" else "ANY", x=left, query=q)
            return Node("compare", op=op, a=left, b=self.expr(COMPARISON))
        if self.at("IS"):
            self.next()
            no = self.take("NOT")
            what = self.take_any("NULL", "TRUE", "FALSE", "UNKNOWN")
            if not what:
                raise self.fail("NULL, TRUE or FALSE")
            return Node("is", x=left, what="NULL" if what == "UNKNOWN" else what, no=no)
        no = self.at("NOT") and self.ahead().upper in ("IN", "LIKE", "REGEXP", "RLIKE", "BETWEEN")
        if no:
            self.next()
        if self.take("IN"):
            if self.now.kind == "list":
                return Node("in", x=left, items=[Node("bind", key=self.next().text, many=True)], no=no)
            self.need_op("(")
            if self.at("SELECT") or self.at("WITH") or self.at("VALUES"):
                q = self.query()
                self.need_op(")")
                return Node("in_query", x=left, query=q, no=no)
            items = self.listed(self.expr)
            self.need_op(")")
            return Node("in", x=left, items=items, no=no)
        if self.take("LIKE"):
            pattern = self.expr(COMPARISON)
            return Node("like", x=left, pattern=pattern, escape=self.expr(COMPARISON) if self.take("ESCAPE") else None, no=no)
        if self.take("REGEXP") or self.take("RLIKE"):
            return Node("regexp", x=left, pattern=self.expr(COMPARISON), no=no)
        if self.take("BETWEEN"):
            low = self.expr(COMPARISON)
            self.need("AND")
            return Node("between", x=left, low=low, high=self.expr(COMPARISON), no=no)
        return None

    def unary(self) -> Node:
        if op := self.op("-", "+", "~", "!"):
            x = self.expr(UNARY)
            if op == "-" and x.kind == "number" and not x.text.startswith("-"):
                return Node("number", text="-" + x.text)
            return x if op == "+" else Node("not", x=x) if op == "!" else Node("unary", op=op, x=x)
        if self.now.upper == "BINARY" and not (self.ahead().kind == "op" and self.ahead().text in ",)"):
            self.next()
            return Node("binary_of", x=self.expr(UNARY))
        x = self.primary()
        while True:
            if op := self.op("->", "->>"):
                x = Node("json", op=op, x=x, path=self.primary())
            elif self.take("COLLATE"):
                x = Node("collate", x=x, name=self.any_name())
            else:
                return x

    def primary(self) -> Node:
        t = self.now
        if t.kind in ("number", "hex", "bit"):
            self.next()
            return Node(t.kind, text=t.text)
        if t.kind == "string":
            self.next()
            while self.now.kind == "string":
                t = Token("string", t.text + self.next().text, t.at)
            return Node("string", text=t.text)
        if t.kind == "bind":
            self.next()
            if t.text == "?":
                self.binds += 1
                return Node("bind", key=self.binds - 1, many=False)
            return Node("bind", key=t.text, many=False)
        if t.kind == "variable":
            self.next()
            return Node("variable", name=t.text)
        if self.op("("):
            if self.at("SELECT") or self.at("WITH"):
                q = self.query()
                self.need_op(")")
                return Node("subquery", query=q)
            items = self.listed(self.expr)
            self.need_op(")")
            return items[0] if len(items) == 1 else Node("row", items=items)
        if self.op("*"):
            return Node("star", table=None)
        if t.kind in ("word", "name"):
            return self.word()
        raise self.fail("an expression")

    def word(self) -> Node:
        t, w = self.now, self.now.upper
        opens = self.ahead().kind == "op" and self.ahead().text == "("
        if w in ("NULL", "TRUE", "FALSE"):
            self.next()
            return Node("literal", text=w)
        if w in ("DATE", "TIME", "TIMESTAMP") and self.ahead().kind == "string":
            self.next()
            return Node("typed", type=w, text=self.next().text)
        if w in ("_BINARY", "_UTF8", "_UTF8MB4", "_LATIN1") and self.ahead().kind == "string":
            self.next()
            x = Node("string", text=self.next().text)
            return Node("binary_of", x=x) if w == "_BINARY" else x
        if w == "CASE":
            return self.case()
        if w == "EXISTS" and opens:
            self.i += 2
            q = self.query()
            self.need_op(")")
            return Node("exists", query=q)
        if w == "INTERVAL" and not (opens and False):
            self.next()
            n = self.expr(BINARY["+"])
            unit = self.next().upper
            if unit not in UNITS:
                raise self.fail("a unit of time")
            return Node("interval", n=n, unit=unit)
        if w in ("CAST", "CONVERT") and opens:
            self.i += 2
            x = self.expr()
            if w == "CONVERT" and self.take("USING"):
                charset = self.any_name()
                self.need_op(")")
                return Node("convert_using", x=x, charset=charset)
            if not (self.take("AS") if w == "CAST" else self.op(",")):
                raise self.fail("a type")
            kind = self.type_name()
            self.need_op(")")
            return Node("cast", x=x, type=kind)
        if w == "MATCH" and opens:
            self.next()
            self.need_op("(")
            cols = self.listed(self.column)
            self.need_op(")")
            self.need("AGAINST")
            self.need_op("(")
            against, mode = self.expr(COMPARISON), []
            while not self.op(")"):
                mode.append(self.next().upper)
            return Node("match", columns=cols, against=against, mode=" ".join(mode))
        if w == "DEFAULT":
            self.next()
            column = None
            if self.op("("):
                column = self.name()
                self.need_op(")")
            return Node("default", column=column)
        if w == "VALUES" and opens:
            self.i += 2
            c = self.name()
            self.need_op(")")
            return Node("values_of", column=c)
        if w in BARE and not opens:
            self.next()
            return Node("call", name=w, args=[], distinct=False)
        if opens and t.kind == "word" and (w not in RESERVED or w in ("LEFT", "RIGHT", "MOD", "IF", "REPLACE")):
            return self.call()
        if t.kind == "word" and w in RESERVED and w not in ("VALUE", "MOD"):
            raise self.fail("an expression")
        return self.column()

    def column(self) -> Node:
        parts = [self.name()]
        while self.op("."):
            if self.op("*"):
                return Node("star", table=parts)
            parts.append(self.any_name())
        if len(parts) > 1 and self.now.kind == "op" and self.now.text == "(":
            return self.call(".".join(parts))
        return Node("column", parts=parts)

    def case(self) -> Node:
        self.need("CASE")
        x = None if self.at("WHEN") else self.expr()
        whens = []
        while self.take("WHEN"):
            c = self.expr()
            self.need("THEN")
            whens.append((c, self.expr()))
        other = self.expr() if self.take("ELSE") else None
        self.need("END")
        if not whens:
            raise self.fail("WHEN")
        return Node("case", x=x, whens=whens, other=other)

    def call(self, name: str | None = None) -> Node:
        name = name or self.next().text
        self.need_op("(")
        w = name.upper()
        if w in ("SUBSTRING", "SUBSTR"):
            args = [self.expr()]
            if self.take("FROM"):
                args.append(self.expr())
                if self.take("FOR"):
                    args.append(self.expr())
            else:
                while self.op(","):
                    args.append(self.expr())
            self.need_op(")")
            return Node("call", name=w, args=args, distinct=False)
        if w == "TRIM" and self.now.upper in ("BOTH", "LEADING", "TRAILING"):
            how = self.next().upper
            what = Node("string", text=" ") if self.at("FROM") else self.expr()
            self.need("FROM")
            x = self.expr()
            self.need_op(")")
            return Node("trim", how=how, what=what, x=x)
        if w == "EXTRACT":
            unit = self.next().upper
            self.need("FROM")
            x = self.expr()
            self.need_op(")")
            return Node("call", name=unit, args=[x], distinct=False)
        distinct = self.take("DISTINCT")
        args = [] if self.now.kind == "op" and self.now.text == ")" else self.listed(self.expr)
        order, separator = [], None
        if w == "GROUP_CONCAT":
            if self.take("ORDER", "BY"):
                order = self.listed(self.order_item)
            if self.take("SEPARATOR"):
                separator = self.next().text
        self.need_op(")")
        x = Node("call", name=w, args=args, distinct=distinct, order=order, separator=separator)
        if self.take("OVER"):
            return Node("over", x=x, window=self.window())
        return x

    def window(self) -> Node:
        if self.now.kind != "op":
            return Node("window", base=self.name(), partition=[], order=[], frame=None)
        self.need_op("(")
        partition = self.listed(self.expr) if self.take("PARTITION", "BY") else []
        order = self.listed(self.order_item) if self.take("ORDER", "BY") else []
        frame = None
        if unit := self.take_any("ROWS", "RANGE"):
            if self.take("BETWEEN"):
                low = self.bound()
                self.need("AND")
                frame = (unit, low, self.bound())
            else:
                frame = (unit, self.bound(), "CURRENT ROW")
        self.need_op(")")
        return Node("window", base=None, partition=partition, order=order, frame=frame)

    def bound(self) -> str:
        if self.take("CURRENT", "ROW"):
            return "CURRENT ROW"
        n = "UNBOUNDED" if self.take("UNBOUNDED") else self.next().text
        side = self.take_any("PRECEDING", "FOLLOWING")
        if not side:
            raise self.fail("PRECEDING or FOLLOWING")
        return f"{n} {side}"

    def type_name(self) -> Node:
        name = self.any_name().upper()
        if name == "DOUBLE":
            self.take("PRECISION")
        if name in ("SIGNED", "UNSIGNED"):
            self.take("INTEGER")
        args = []
        if self.op("("):
            args = self.listed(lambda: self.next().text)
            self.need_op(")")
        flags, charset, collate = set(), None, None
        while True:
            if f := self.take_any("UNSIGNED", "ZEROFILL", "BINARY"):
                flags.add(f)
            elif self.take("CHARACTER", "SET") or self.take("CHARSET"):
                charset = self.next().text
            elif self.take("COLLATE"):
                collate = self.next().text
            else:
                return Node("type", name=name, args=args, flags=sorted(flags), charset=charset, collate=collate)

    def order_item(self) -> tuple[Node, str, str | None]:
        x = self.expr()
        way = self.take_any("ASC", "DESC") or "ASC"
        nulls = ("FIRST" if self.take("FIRST") else self.need("LAST") or "LAST") if self.take("NULLS") else None
        return x, way, nulls

    # queries

    def query(self) -> Node:
        """A select or set operation with its WITH, ORDER BY, LIMIT and lock."""
        ctes, recursive = [], False
        if self.take("WITH"):
            recursive = self.take("RECURSIVE")
            ctes = self.listed(self.cte)
        body = self.set_operation()
        order, limit, lock = self.tail()
        if ctes or order or limit or lock:
            if body.kind == "select" and not body.get("closed") and not (body.order or body.limit):
                body = Node("select", **body.parts | {"order": order, "limit": limit, "lock": lock})
            elif order or limit:
                body = Node("ordered", query=body, order=order, limit=limit)
            if ctes:
                body = Node("with", ctes=ctes, recursive=recursive, query=body)
        return body

    def cte(self) -> tuple[str, list[str], Node]:
        name = self.name()
        columns = self.names() if self.now.kind == "op" and self.now.text == "(" else []
        self.need("AS")
        self.need_op("(")
        q = self.query()
        self.need_op(")")
        return name, columns, q

    def tail(self) -> tuple[list, tuple | None, str | None]:
        order = self.listed(self.order_item) if self.take("ORDER", "BY") else []
        limit = None
        if self.take("LIMIT"):
            n = self.primary()
            limit = (n, None)
            if self.op(","):
                limit = (self.primary(), n)
            elif self.take("OFFSET"):
                limit = (n, self.primary())
        lock = "FOR UPDATE" if self.take("FOR", "UPDATE") else "LOCK IN SHARE MODE" if self.take("LOCK", "IN", "SHARE", "MODE") else None
        return order, limit, lock

    def set_operation(self) -> Node:
        left = self.set_term()
        while op := self.take_any("UNION", "EXCEPT", "MINUS"):
            how = self.take_any("ALL", "DISTINCT") or "DISTINCT"
            left = Node("setop", op="EXCEPT" if op == "MINUS" else op, all=how == "ALL", a=left, b=self.set_term())
        return left

    def set_term(self) -> Node:
        left = self.select_term()
        while self.take("INTERSECT"):
            how = self.take_any("ALL", "DISTINCT") or "DISTINCT"
            left = Node("setop", op="INTERSECT", all=how == "ALL", a=left, b=self.select_term())
        return left

    def select_term(self) -> Node:
        if self.op("("):
            q = self.query()
            self.need_op(")")
            return Node("closed", query=q)
        return self.select()

    def select(self) -> Node:
        self.need("SELECT")
        distinct, hints = False, []
        while w := self.take_any("DISTINCT", "DISTINCTROW", "ALL", "SQL_CACHE", "SQL_NO_CACHE", "STRAIGHT_JOIN", "SQL_CALC_FOUND_ROWS", "HIGH_PRIORITY", "SQL_SMALL_RESULT", "SQL_BIG_RESULT", "SQL_BUFFER_RESULT"):
            distinct |= w.startswith("DISTINCT")
            hints += [w] * (w not in ("DISTINCT", "DISTINCTROW", "ALL"))
        items = self.listed(self.select_item)
        tables = self.listed(self.table_ref) if self.take("FROM") else []
        where = self.expr() if self.take("WHERE") else None
        group, rollup = [], False
        if self.take("GROUP", "BY"):
            group = self.listed(self.expr)
            rollup = self.take("WITH", "ROLLUP")
        having = self.expr() if self.take("HAVING") else None
        windows = []
        if self.take("WINDOW"):
            windows = self.listed(self.named_window)
        return Node("select", distinct=distinct, hints=hints, items=items, tables=tables, where=where, group=group, rollup=rollup, having=having, windows=windows, order=[], limit=None, lock=None)

    def named_window(self) -> tuple[str, Node]:
        name = self.name()
        self.need("AS")
        return name, self.window()

    def select_item(self) -> tuple[Node, str | None]:
        if self.op("*"):
            return Node("star", table=None), None
        x = self.expr()
        return x, self.alias()

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.next().text if self.now.kind == "string" else self.any_name()
        if self.now.kind in ("name", "string") or (self.now.kind == "word" and self.now.upper not in RESERVED):
            return self.next().text
        return None

    def table_ref(self) -> Node:
        left = self.table_factor()
        while True:
            natural = self.take("NATURAL")
            if self.take("STRAIGHT_JOIN"):
                how = "STRAIGHT"
            elif self.take("CROSS", "JOIN"):
                how = "CROSS"
            elif self.take("INNER", "JOIN") or self.take("JOIN"):
                how = "INNER"
            elif self.now.upper in ("LEFT", "RIGHT", "FULL") and self.ahead().upper in ("JOIN", "OUTER", "SEMI", "ANTI"):
                how = self.next().upper
                how += f" {x}" if (x := self.take_any("SEMI", "ANTI")) else "" * self.take("OUTER")
                self.need("JOIN")
            elif natural:
                raise self.fail("JOIN")
            else:
                return left
            right = self.table_factor()
            on = self.expr() if self.take("ON") else None
            using = self.names() if on is None and self.take("USING") else None
            left = Node("join", how=how, natural=natural, a=left, b=right, on=on, using=using)

    def table_factor(self) -> Node:
        lateral = self.take("LATERAL")
        if self.op("("):
            if self.at("SELECT") or self.at("WITH") or (self.now.kind == "op" and self.now.text == "("):
                start = self.i
                try:
                    q = self.query()
                    self.need_op(")")
                    alias = self.alias()
                    columns = self.names() if self.now.kind == "op" and self.now.text == "(" else []
                    return Node("derived", query=q, alias=alias, columns=columns, lateral=lateral)
                except SQLError:
                    self.i = start
            refs = self.listed(self.table_ref)
            self.need_op(")")
            return Node("tables", refs=refs)
        name = self.table_name()
        partitions = self.names() if self.at("PARTITION") and self.ahead().text == "(" and self.take("PARTITION") else []
        alias, hints = self.alias(), []
        while self.now.upper in ("USE", "IGNORE", "FORCE") and self.ahead().upper in ("INDEX", "KEY"):
            how = self.next().upper
            self.next()
            if self.take("FOR"):
                while not (self.now.kind == "op" and self.now.text == "("):
                    self.next()
            self.need_op("(")
            keys = []
            while not self.op(")"):
                keys.append(self.next().text)
            hints.append((how, [k for k in keys if k != ","]))
        return Node("table", name=name, alias=alias, partitions=partitions, hints=hints)

    # statements

    def statement(self) -> Node:
        first = self.now.upper
        handler = getattr(self, f"do_{first.lower()}", None)
        if self.at("SELECT") or self.at("WITH") or (self.now.kind == "op" and self.now.text == "("):
            x = self.query()
        elif handler:
            self.next()
            x = handler()
        else:
            raise self.fail("a statement")
        self.op(";")
        if self.now.kind != "end":
            raise self.fail("the end of the statement")
        return x

    def where_tail(self) -> dict:
        where = self.expr() if self.take("WHERE") else None
        order, limit, _ = self.tail()
        return {"where": where, "order": order, "limit": limit}

    def assignments(self) -> list[tuple[Node, Node]]:
        def one() -> tuple[Node, Node]:
            c = self.column()
            if not self.op("=", ":="):
                raise self.fail("=")
            return c, self.expr()

        return self.listed(one)

    def do_insert(self, kind: str = "insert") -> Node:
        while self.take_any("LOW_PRIORITY", "DELAYED", "HIGH_PRIORITY"):
            pass
        ignore = self.take("IGNORE")
        self.take("INTO")
        table = self.table_name()
        columns, rows, query = [], None, None
        if self.take("SET"):
            pairs = self.assignments()
            columns, rows = [c.parts["parts"][-1] for c, _ in pairs], [[x for _, x in pairs]]
        else:
            if self.now.kind == "op" and self.now.text == "(" and self.ahead().upper not in ("SELECT", "WITH"):
                if self.ahead().text == ")":
                    self.i += 2
                else:
                    columns = self.names()
            if self.take("VALUES") or self.take("VALUE"):
                rows = self.listed(self.value_row)
            else:
                query = self.query()
        update = self.assignments() if self.take("ON", "DUPLICATE", "KEY", "UPDATE") else []
        return Node(kind, table=table, columns=columns, rows=rows, query=query, ignore=ignore, update=update)

    def value_row(self) -> list[Node]:
        self.need_op("(")
        row = [] if self.now.text == ")" else self.listed(self.expr)
        self.need_op(")")
        return row

    def do_replace(self) -> Node:
        return self.do_insert("replace")

    def do_update(self) -> Node:
        self.take("LOW_PRIORITY")
        ignore = self.take("IGNORE")
        tables = self.listed(self.table_ref)
        self.need("SET")
        return Node("update", tables=tables, ignore=ignore, set=self.assignments(), **self.where_tail())

    def do_delete(self) -> Node:
        while self.take_any("LOW_PRIORITY", "QUICK", "IGNORE"):
            pass
        if self.take("FROM"):
            targets = self.listed(self.delete_target)
            if self.take("USING"):
                return Node("delete", targets=targets, tables=self.listed(self.table_ref), **self.where_tail())
            alias = self.alias() if len(targets) == 1 else None
            tables = [Node("table", name=targets[0], alias=alias, partitions=[], hints=[])]
            return Node("delete", targets=[Node("name", db=None, name=alias) if alias else targets[0]], tables=tables, **self.where_tail())
        targets = self.listed(self.delete_target)
        self.need("FROM")
        return Node("delete", targets=targets, tables=self.listed(self.table_ref), **self.where_tail())

    def delete_target(self) -> Node:
        t = self.table_name()
        if self.op("."):
            self.need_op("*")
        return t

    def exists_flag(self, *words: str) -> bool:
        return self.take(*words)

    def do_create(self) -> Node:
        replace = self.take("OR", "REPLACE")
        self.take("TEMPORARY")
        if self.take("DATABASE") or self.take("SCHEMA"):
            quiet = self.take("IF", "NOT", "EXISTS")
            name = self.name()
            self.rest()
            return Node("create_database", name=name, quiet=quiet)
        if self.take("TABLE"):
            quiet = self.take("IF", "NOT", "EXISTS")
            table = self.table_name()
            if self.take("LIKE"):
                return Node("create_like", table=table, like=self.table_name(), quiet=quiet)
            columns, keys, checks = [], [], []
            if self.now.kind == "op" and not (self.ahead().upper in ("SELECT", "WITH")):
                self.need_op("(")
                self.listed(lambda: self.table_element(columns, keys, checks))
                self.need_op(")")
            options, query = {}, None
            while self.now.kind != "end" and self.now.text != ";":
                if self.take("AS") or self.at("SELECT") or self.at("WITH"):
                    query = self.query()
                    break
                if self.op(","):
                    continue
                word = self.next().text.upper()
                word = f"{word} {self.next().text.upper()}" if word in ("DEFAULT", "CHARACTER") else word
                self.op("=")
                options[word] = self.next().text
            return Node("create_table", table=table, columns=columns, keys=keys, checks=checks, options=options, query=query, quiet=quiet)
        if self.take("VIEW"):
            name = self.table_name()
            columns = self.names() if self.now.kind == "op" else []
            self.need("AS")
            return Node("create_view", name=name, columns=columns, query=self.query(), replace=replace)
        kind = self.take_any("UNIQUE", "FULLTEXT", "SPATIAL")
        if self.take("INDEX"):
            name = self.name()
            if self.take("USING"):
                self.next()
            self.need("ON")
            table = self.table_name()
            return Node("create_index", name=name, table=table, columns=self.key_columns(), unique=kind == "UNIQUE")
        raise self.fail("TABLE, DATABASE, VIEW or INDEX")

    def key_columns(self) -> list[str]:
        def one() -> str:
            n = self.name()
            if self.op("("):
                self.next()
                self.need_op(")")
            self.take_any("ASC", "DESC")
            return n

        self.need_op("(")
        out = self.listed(one)
        self.need_op(")")
        return out

    def table_element(self, columns: list, keys: list, checks: list) -> None:
        name = None
        if self.take("CONSTRAINT"):
            name = self.name() if self.now.upper not in ("PRIMARY", "UNIQUE", "FOREIGN", "CHECK") else None
        if self.take("PRIMARY", "KEY"):
            keys.append(("PRIMARY", "PRIMARY", self.key_columns()))
        elif self.take("FOREIGN", "KEY"):
            cols = self.key_columns()
            self.need("REFERENCES")
            other = self.table_name()
            keys.append(("FOREIGN", name or f"fk_{'_'.join(cols)}", cols, other, self.key_columns(), self.reference_actions()))
        elif self.take("CHECK"):
            self.need_op("(")
            checks.append(self.expr())
            self.need_op(")")
        elif self.now.upper in ("UNIQUE", "FULLTEXT", "SPATIAL", "INDEX", "KEY") and self.ahead().kind in ("word", "name", "op"):
            kind = self.take_any("UNIQUE", "FULLTEXT", "SPATIAL") or "INDEX"
            self.take_any("INDEX", "KEY")
            name = name or (self.name() if self.now.kind != "op" else None)
            cols = self.key_columns()
            if self.take("USING"):
                self.next()
            keys.append((kind, name or cols[0], cols))
        else:
            columns.append(self.column_definition())

    def reference_actions(self) -> dict:
        out = {}
        while self.take("ON"):
            event = self.next().upper
            action = self.next().upper
            out[event] = action + (f" {self.next().upper}" if action in ("SET", "NO") else "")
        return out

    def column_definition(self) -> Node:
        name, kind = self.name(), self.type_name()
        out = {"null": True, "default": None, "on_update": None, "auto": False, "key": None, "comment": "", "check": None}
        while True:
            if self.take("NOT", "NULL"):
                out["null"] = False
            elif self.take("NULL"):
                pass
            elif self.take("DEFAULT"):
                out["default"] = self.expr(COMPARISON)
            elif self.take("ON", "UPDATE"):
                out["on_update"] = self.expr(COMPARISON)
            elif self.take("AUTO_INCREMENT"):
                out["auto"] = True
            elif self.take("PRIMARY", "KEY") or self.take("PRIMARY"):
                out["key"], out["null"] = "PRI", False
            elif self.take("UNIQUE"):
                self.take("KEY")
                out["key"] = "UNI"
            elif self.take("KEY"):
                out["key"] = "PRI"
            elif self.take("COMMENT"):
                out["comment"] = self.next().text
            elif self.take("CHECK"):
                self.need_op("(")
                out["check"] = self.expr()
                self.need_op(")")
            elif self.take("REFERENCES"):
                self.table_name()
                self.key_columns()
                self.reference_actions()
            else:
                return Node("column_def", name=name, type=kind, **out)

    def do_drop(self) -> Node:
        if self.take("DATABASE") or self.take("SCHEMA"):
            quiet = self.take("IF", "EXISTS")
            return Node("drop_database", name=self.name(), quiet=quiet)
        if what := self.take_any("TABLE", "VIEW"):
            quiet = self.take("IF", "EXISTS")
            tables = self.listed(self.table_name)
            self.take_any("RESTRICT", "CASCADE")
            return Node("drop_table", tables=tables, quiet=quiet, view=what == "VIEW")
        self.need("INDEX")
        name = self.name()
        self.need("ON")
        return Node("drop_index", name=name, table=self.table_name())

    def do_alter(self) -> Node:
        if self.take("VIEW"):
            name = self.table_name()
            columns = self.names() if self.now.kind == "op" else []
            self.need("AS")
            return Node("create_view", name=name, columns=columns, query=self.query(), replace=True)
        self.take("IGNORE")
        self.need("TABLE")
        table = self.table_name()
        return Node("alter", table=table, actions=self.listed(self.alter_action))

    def alter_action(self) -> tuple:
        if self.take("ADD"):
            if self.now.upper in ("INDEX", "KEY", "UNIQUE", "PRIMARY", "FULLTEXT", "CONSTRAINT", "FOREIGN", "CHECK"):
                keys, checks = [], []
                self.table_element([], keys, checks)
                return "add_key", keys, checks
            self.take("COLUMN")
            c = self.column_definition()
            place = "FIRST" if self.take("FIRST") else self.name() if self.take("AFTER") else None
            return "add", c, place
        if self.take("DROP"):
            if self.take("PRIMARY", "KEY"):
                return "drop_key", "PRIMARY"
            if self.take("INDEX") or self.take("KEY"):
                return "drop_key", self.name()
            self.take("COLUMN")
            return "drop", self.name()
        if self.take("MODIFY"):
            self.take("COLUMN")
            c = self.column_definition()
            return "change", c.name, c
        if self.take("CHANGE"):
            self.take("COLUMN")
            old = self.name()
            return "change", old, self.column_definition()
        if self.take("RENAME"):
            if self.take("COLUMN"):
                old = self.name()
                self.need("TO")
                return "rename_column", old, self.name()
            self.take_any("TO", "AS")
            return "rename", self.table_name()
        if self.take("ALTER"):
            self.take("COLUMN")
            c = self.name()
            if self.take("SET", "DEFAULT"):
                return "default", c, self.expr()
            self.need("DROP", "DEFAULT")
            return "default", c, None
        raise self.fail("ADD, DROP, MODIFY, CHANGE or RENAME")

    def do_rename(self) -> Node:
        self.need("TABLE")

        def one() -> tuple[Node, Node]:
            a = self.table_name()
            self.need("TO")
            return a, self.table_name()

        return Node("rename", pairs=self.listed(one))

    def do_truncate(self) -> Node:
        self.take("TABLE")
        return Node("truncate", table=self.table_name())

    def do_use(self) -> Node:
        return Node("use", name=self.name())

    def do_set(self) -> Node:
        if self.take("NAMES"):
            return Node("set_names", charset=self.next().text, collate=self.next().text if self.take("COLLATE") else None)
        if self.take("CHARACTER", "SET") or self.take("CHARSET"):
            return Node("set_names", charset=self.next().text, collate=None)
        start = self.i
        scope = self.take_any("SESSION", "GLOBAL", "LOCAL")
        if self.take("TRANSACTION"):
            modes = []
            while self.now.kind != "end" and self.now.text != ";":
                modes.append(self.next().text.upper())
            return Node("set_transaction", scope=scope or "SESSION", modes=" ".join(modes))
        self.i = start

        def one() -> tuple[str, str, Node]:
            scope = self.take_any("SESSION", "GLOBAL", "LOCAL")
            name = self.next().text
            name = f"{name}.{self.next().text}" if self.op(".") else name
            if not self.op("=", ":="):
                raise self.fail("=")
            value = Node("string", text=self.next().text) if self.now.upper in ("ON", "OFF", "DEFAULT", "BINARY") and self.ahead().text in (",", ";", "") else self.expr()
            return scope, name, value

        return Node("set", items=self.listed(one))

    def do_show(self) -> Node:
        scope = self.take_any("GLOBAL", "SESSION", "LOCAL")
        full = self.take("EXTENDED") | self.take("FULL")
        what = self.next().upper
        parts = {"scope": scope, "full": full, "what": what, "table": None, "db": None, "like": None, "where": None}
        if what == "CHARACTER":
            self.need("SET")
            parts["what"] = "CHARSET"
        elif what == "CREATE":
            parts["what"] = f"CREATE {self.next().upper}"
            self.take("IF", "NOT", "EXISTS")
            parts["table"] = self.table_name()
        elif what in ("INDEX", "INDEXES", "KEYS", "COLUMNS", "FIELDS"):
            if not (self.take("FROM") or self.take("IN")):
                raise self.fail("FROM")
            parts["table"] = self.table_name()
        elif what == "TABLE":
            self.need("STATUS")
            parts["what"] = "TABLE STATUS"
        if self.take("FROM") or self.take("IN"):
            parts["db"] = self.name()
        if self.take("LIKE"):
            parts["like"] = self.next().text
        elif self.take("WHERE"):
            parts["where"] = self.expr()
        elif self.take("LIMIT"):
            self.rest()
        return Node("show", **parts)

    def do_describe(self) -> Node:
        self.take_any("EXTENDED", "FORMATTED")
        if self.op(".") or self.now.upper in ("SELECT", "INSERT", "UPDATE", "DELETE", "REPLACE", "WITH"):
            return Node("explain", statement=self.statement())
        if self.now.upper == "FORMAT":
            self.i += 3
            return Node("explain", statement=self.statement())
        table = self.table_name()
        return Node("show", scope="", full=False, what="COLUMNS", table=table, db=None, like=self.next().text if self.now.kind in ("string", "word", "name") else None, where=None)

    do_desc = do_explain = do_describe

    def do_begin(self) -> Node:
        self.take("WORK")
        return Node("begin")

    def do_start(self) -> Node:
        self.need("TRANSACTION")
        self.rest()
        return Node("begin")

    def do_commit(self) -> Node:
        self.take("WORK")
        return Node("commit")

    def do_rollback(self) -> Node:
        self.take("WORK")
        if self.take("TO"):
            self.take("SAVEPOINT")
            return Node("rollback", to=self.name())
        return Node("rollback", to=None)

    def do_savepoint(self) -> Node:
        return Node("savepoint", name=self.name())

    def do_release(self) -> Node:
        self.need("SAVEPOINT")
        return Node("release", name=self.name())

    def do_analyze(self) -> Node:
        self.take_any("LOCAL", "NO_WRITE_TO_BINLOG")
        self.need("TABLE")
        return Node("analyze", tables=self.listed(self.table_name))

    def do_optimize(self) -> Node:
        self.rest()
        return Node("noop")

    do_repair = do_flush = do_lock = do_unlock = do_optimize


def parse(sql: str) -> Node:
    """The syntax tree of one statement."""
    return Parser(sql).statement()


def parse_expression(sql: str) -> Node:
    p = Parser(sql)
    x = p.expr()
    if p.now.kind != "end":
        raise p.fail("the end of the expression")
    return x
