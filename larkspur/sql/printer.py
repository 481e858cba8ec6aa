"""Syntax trees as text: Spark SQL to run, or the dialect's own form."""

from __future__ import annotations

from collections.abc import Callable

from larkspur.functions import registry
from larkspur.sql.lexer import SQLError
from larkspur.sql.nodes import Node
from larkspur.types import cast_type


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(s: str) -> str:
    out = s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\0", "\\0")
    return f"'{out}'"


class Names:
    """What an environment knows: tables, variables, session functions. The default knows nothing but Spark's own tables."""

    def table(self, db: str | None, name: str) -> str:
        return f"{quote(db)}.{quote(name)}" if db else quote(name)

    def variable(self, name: str) -> str:
        raise SQLError(f"unknown system variable {name}")

    def function(self, name: str) -> str | None:
        return None


class SparkPrinter:
    """Spark SQL text of queries and expressions."""

    def __init__(self, names: Names | None = None, values_of: Callable[[str], str] | None = None) -> None:
        self.names, self.values_of, self.ctes = names or Names(), values_of, []

    def expr(self, x: Node) -> str:
        return getattr(self, f"x_{x.kind}")(x)

    def list(self, xs) -> str:
        return ", ".join(map(self.expr, xs))

    # expressions

    def x_number(self, x):
        t = x.text
        if t.lstrip("-").isdigit() and abs(int(t)) >= 2**63:
            return f"CAST('{t}' AS DECIMAL(38,0))"
        return f"({t})" if t.startswith("-") else t + ("0" if t.endswith(".") else "")

    def x_string(self, x):
        return literal(x.text)

    def x_hex(self, x):
        return f"x'{x.text if len(x.text) % 2 == 0 else '0' + x.text}'"

    def x_bit(self, x):
        return str(int(x.text or "0", 2))

    def x_literal(self, x):
        return x.text

    def x_typed(self, x):
        return f"TIMESTAMP_NTZ {literal(x.text)}" if x.type == "TIMESTAMP" else f"DATE {literal(x.text)}" if x.type == "DATE" else literal(x.text)

    def x_bind(self, x):
        raise SQLError("a parameter has no value")

    def x_variable(self, x):
        return self.names.variable(x.name)

    def x_column(self, x):
        parts = x.parts["parts"]
        return ".".join(map(quote, parts[-2:]))

    def x_star(self, x):
        return f"{quote(x.table[-1])}.*" if x.table else "*"

    def x_row(self, x):
        return f"({self.list(x.items)})"

    def x_subquery(self, x):
        return f"({self.query(x.query)})"

    def x_exists(self, x):
        return f"EXISTS ({self.query(x.query)})"

    def x_not(self, x):
        return f"(NOT {self.truth(x.x)})"

    def truth(self, x: Node) -> str:
        return self.expr(x) if x.kind in ("compare", "not", "is", "in", "in_query", "like", "regexp", "between", "exists", "quantified", "literal", "column") or (x.kind == "binary" and x.op in ("AND", "OR", "XOR", "||")) else f"CAST({self.expr(x)} AS BOOLEAN)" if x.kind == "number" else self.expr(x)

    def x_unary(self, x):
        return f"({x.op}{self.expr(x.x)})"

    def x_binary(self, x):
        op = x.op
        if op in ("AND", "OR", "||"):
            return f"({self.truth(x.a)} {'OR' if op == '||' else op} {self.truth(x.b)})"
        a, b = self.expr(x.a), self.expr(x.b)
        if op == "XOR":
            return f"({self.truth(x.a)} <> {self.truth(x.b)})"
        if op == "/":
            return f"try_divide({a}, {b})"
        if op == "%":
            return f"try_mod({a}, {b})"
        if op == "DIV":
            return f"CAST(({a}) div nullif({b}, 0) AS BIGINT)"
        return f"({a} {op} {b})"

    def x_compare(self, x):
        return f"({self.expr(x.a)} {x.op} {self.expr(x.b)})"

    def x_is(self, x):
        return f"({self.expr(x.x)} IS {'NOT ' * x.no}{x.what})"

    def x_in(self, x):
        return f"({self.expr(x.x)} {'NOT ' * x.no}IN ({self.list(x.items)}))"

    def x_in_query(self, x):
        return f"({self.expr(x.x)} {'NOT ' * x.no}IN ({self.query(x.query)}))"

    def x_like(self, x):
        escape = f" ESCAPE {self.expr(x.escape)}" if x.escape else ""
        return f"({self.expr(x.x)} {'NOT ' * x.no}LIKE {self.expr(x.pattern)}{escape})"

    def x_regexp(self, x):
        return f"({'NOT ' * x.no}({self.expr(x.x)} RLIKE {self.expr(x.pattern)}))"

    def x_between(self, x):
        return f"({self.expr(x.x)} {'NOT ' * x.no}BETWEEN {self.expr(x.low)} AND {self.expr(x.high)})"

    def x_quantified(self, x):
        """ANY and ALL by what the set's count, non-null count, least and greatest say."""
        if x.op == "=" and x.how == "ANY":
            return f"({self.expr(x.x)} IN ({self.query(x.query)}))"
        if x.op == "<>" and x.how == "ALL":
            return f"({self.expr(x.x)} NOT IN ({self.query(x.query)}))"
        v = self.expr(x.x)
        s = f"(SELECT named_struct('n', count(*), 'nn', count(s), 'hi', max(s), 'lo', min(s)) FROM ({self.query(x.query)}) AS q(s))"
        if x.how == "ALL":
            fails = {"=": f"({v} <> {s}.lo OR {v} <> {s}.hi)", ">": f"{v} <= {s}.hi", ">=": f"{v} < {s}.hi", "<": f"{v} >= {s}.lo", "<=": f"{v} > {s}.lo", "<=>": "false"}[x.op]
            return f"(CASE WHEN {s}.n = 0 THEN true WHEN ({v}) IS NULL THEN NULL WHEN {fails} THEN false WHEN {s}.nn < {s}.n THEN NULL ELSE true END)"
        holds = {"<>": f"({v} <> {s}.lo OR {v} <> {s}.hi)", ">": f"{v} > {s}.lo", ">=": f"{v} >= {s}.lo", "<": f"{v} < {s}.hi", "<=": f"{v} <= {s}.hi", "<=>": "false"}[x.op]
        return f"(CASE WHEN {s}.n = 0 THEN false WHEN {holds} THEN true WHEN ({v}) IS NULL OR {s}.nn < {s}.n THEN NULL ELSE false END)"

    def x_case(self, x):
        whens = " ".join(f"WHEN {self.expr(c)} THEN {self.expr(v)}" for c, v in x.whens)
        return f"CASE {self.expr(x.x) + ' ' if x.x else ''}{whens}{' ELSE ' + self.expr(x.other) if x.other else ''} END"

    def x_json(self, x):
        return f"get_json_object({self.expr(x.x)}, {self.expr(x.path)})"

    def x_collate(self, x):
        known = "UTF8_LCASE" if x.name.lower().endswith("_ci") else "UTF8_BINARY" if x.name.lower().endswith(("_bin", "_cs")) or x.name.lower() == "binary" else x.name
        return f"({self.expr(x.x)} COLLATE {known})"

    def x_binary_of(self, x):
        return f"CAST(CAST({self.expr(x.x)} AS STRING) AS BINARY)"

    def x_interval(self, x):
        n, unit = self.expr(x.n), x.unit
        times = {"WEEK": (7, "DAY"), "QUARTER": (3, "MONTH")}.get(unit, (1, unit))
        if x.n.kind in ("number", "string") and x.n.text.lstrip("-").isdigit():
            k = int(x.n.text) * times[0]
            return f"INTERVAL '{k / 1e6:.6f}' SECOND" if unit == "MICROSECOND" else f"INTERVAL '{k}' {times[1]}"
        if times[1] in ("YEAR", "MONTH"):
            return f"(make_ym_interval({'0, ' * (times[1] == 'MONTH')}CAST({n} AS INT)) * {times[0]})"
        place = ["DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"].index(times[1])
        value = f"({n}) / 1e6" if place == 4 else n
        return f"(make_dt_interval({'0, ' * min(place, 3)}{value}) * {times[0]})"

    def x_cast(self, x):
        return f"try_cast({self.expr(x.x)} AS {cast_type(x.type.name, x.type.args)})"

    def x_convert_using(self, x):
        return f"CAST({self.expr(x.x)} AS STRING)"

    def x_default(self, x):
        raise SQLError("DEFAULT stands only for a value to be stored")

    def x_values_of(self, x):
        if not self.values_of:
            raise SQLError("VALUES() belongs in ON DUPLICATE KEY UPDATE")
        return self.values_of(x.column)

    def x_trim(self, x):
        return f"trim({x.how} {self.expr(x.what)} FROM {self.expr(x.x)})"

    def x_match(self, x):
        """How many of the distinct words looked for occur: an approximation of full-text relevance."""
        word = lambda s: f"array_distinct(filter(split(lower({s}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> ''))"
        return f"CAST(size(array_intersect({word('concat_ws(\" \", ' + self.list(x.columns) + ')')}, {word(self.expr(x.against))})) AS DOUBLE)"

    def x_call(self, x):
        name = x.name.upper()
        if name == "GROUP_CONCAT":
            return self.group_concat(x)
        if not x.args and (own := self.names.function(name)) is not None:
            return own
        if name == "COUNT" and x.distinct and len(x.args) > 1:
            return f"count(DISTINCT {self.list(x.args)})"
        if name == "TIMESTAMPDIFF":
            return registry.emit(name, [x.args[0].parts["parts"][0], *map(self.expr, x.args[1:])])
        args = [self.expr(a) for a in x.args]
        if name == "NTH_VALUE" and len(args) == 2:
            return f"nth_value({args[0]}, {args[1]})"
        return registry.emit(name, args, x.distinct)

    def group_concat(self, x) -> str:
        value = f"CAST({self.expr(x.args[0])} AS STRING)" if len(x.args) == 1 else f"concat({', '.join(f'CAST({self.expr(a)} AS STRING)' for a in x.args)})"
        sep = literal("," if x.separator is None else x.separator)
        order = f" WITHIN GROUP (ORDER BY {self.orders(x.order)})" if x.order else ""
        if x.distinct and len(x.order) == 1 and x.order[0][0] == x.args[0]:
            order = f" WITHIN GROUP (ORDER BY {value} {x.order[0][1]})"
        return f"listagg({'DISTINCT ' * x.distinct}{value}, {sep}){order}"

    def x_over(self, x):
        return f"{self.expr(x.x)} OVER {self.window(x.window)}"

    def window(self, w) -> str:
        if w.base:
            return quote(w.base)
        parts = []
        if w.partition:
            parts.append("PARTITION BY " + self.list(w.partition))
        if w.order:
            parts.append("ORDER BY " + self.orders(w.order))
        if w.frame:
            parts.append(f"{w.frame[0]} BETWEEN {w.frame[1]} AND {w.frame[2]}")
        return f"({' '.join(parts)})"

    def orders(self, order) -> str:
        return ", ".join(f"{self.expr(x)} {way}" + (f" NULLS {nulls}" if nulls else "") for x, way, nulls in order)

    # queries

    def query(self, q: Node) -> str:
        return getattr(self, f"q_{q.kind}")(q)

    def q_with(self, q):
        self.ctes.append({name.lower() for name, _, _ in q.ctes})
        ctes = ", ".join(f"{quote(n)}{'(' + ', '.join(map(quote, c)) + ')' if c else ''} AS ({self.query(x)})" for n, c, x in q.ctes)
        body = self.query(q.query)
        self.ctes.pop()
        return f"WITH {'RECURSIVE ' * q.recursive}{ctes} {body}"

    def q_closed(self, q):
        return f"({self.query(q.query)})"

    def q_setop(self, q):
        return f"{self.arm(q.a)} {q.op}{' ALL' * q.all} {self.arm(q.b)}"

    def arm(self, q) -> str:
        return self.query(q) if q.kind in ("select", "closed", "setop") else f"({self.query(q)})"

    def q_ordered(self, q):
        return f"{self.query(q.query)}{self.ending(q.order, q.limit)}"

    def ending(self, order, limit) -> str:
        out = f" ORDER BY {self.orders(order)}" if order else ""
        if limit:
            out += f" LIMIT {self.expr(limit[0])}" + (f" OFFSET {self.expr(limit[1])}" if limit[1] else "")
        return out

    def q_select(self, q):
        items = []
        grouped = {self.expr(g) for g in q.group} | {alias for x, alias in q.items if alias} if q.group else set()
        keys = [g.parts["parts"][-1].lower() for g in q.group if g.kind == "column"]
        ordinals = {int(g.text) for g in q.group if g.kind == "number" and g.text.isdigit()}
        for n, (x, alias) in enumerate(q.items, 1):
            s = self.expr(x)
            # columns outside GROUP BY: any value of the group, as the dialect's loose mode has it
            if q.group and x.kind == "column" and s not in grouped and x.parts["parts"][-1].lower() not in keys and (alias or "").lower() not in keys and n not in ordinals:
                s, alias = f"any_value({s})", alias or x.parts["parts"][-1]
            items.append(f"{s} AS {quote(alias)}" if alias else s)
        out = f"SELECT {'DISTINCT ' * q.distinct}{', '.join(items)}"
        tables = [t for t in q.tables if not (t.kind == "table" and t.name.name.lower() == "dual" and not t.name.db)]
        if tables:
            out += " FROM " + ", ".join(map(self.table, tables))
        if q.where:
            out += f" WHERE {self.truth(q.where)}"
        if q.group:
            out += f" GROUP BY {self.list(q.group)}{' WITH ROLLUP' * q.rollup}"
        if q.having:
            out += f" HAVING {self.truth(q.having)}"
        if q.windows:
            out += " WINDOW " + ", ".join(f"{quote(n)} AS {self.window(w)}" for n, w in q.windows)
        return out + self.ending(q.order, q.limit)

    def table(self, t: Node) -> str:
        if t.kind == "table":
            cte = not t.name.db and any(t.name.name.lower() in c for c in self.ctes)
            name = quote(t.name.name) if cte else self.names.table(t.name.db, t.name.name)
            alias = t.alias or t.name.name
            return f"{name} AS {quote(alias)}"
        if t.kind == "derived":
            columns = f"({', '.join(map(quote, t.columns))})" if t.columns else ""
            return f"{'LATERAL ' * t.lateral}({self.query(t.query)}){' AS ' + quote(t.alias) + columns if t.alias else ''}"
        if t.kind == "tables":
            return f"({self.table(t.refs[0])})" if len(t.refs) == 1 else "(" + " CROSS JOIN ".join(map(self.table, t.refs)) + ")"
        how = {"STRAIGHT": "INNER", "INNER": "INNER" if t.on or t.using or t.natural else "CROSS", "FULL": "FULL OUTER", "LEFT": "LEFT OUTER", "RIGHT": "RIGHT OUTER"}.get(t.how, t.how)
        if t.how == "STRAIGHT" and not (t.on or t.using):
            how = "CROSS"
        end = f" ON {self.truth(t.on)}" if t.on else f" USING ({', '.join(map(quote, t.using))})" if t.using else ""
        if t.how == "CROSS" and end:
            how = "INNER"
        return f"{self.table(t.a)} {'NATURAL ' * t.natural}{how} JOIN {self.table(t.b)}{end}"


class DialectPrinter(SparkPrinter):
    """The dialect's own text of a query, for logs, redaction and round trips."""

    def x_bind(self, x):
        return "::" + str(x.key) if x.many else "?" if isinstance(x.key, int) else f":{x.key}"

    def x_in(self, x):
        if x.items and x.items[0].kind == "bind" and x.items[0].many:
            return f"({self.expr(x.x)} {'NOT ' * x.no}IN {self.expr(x.items[0])})"
        return super().x_in(x)

    def x_number(self, x):
        return x.text

    def x_hex(self, x):
        return f"x'{x.text}'"

    def x_bit(self, x):
        return f"b'{x.text}'"

    def x_typed(self, x):
        return f"{x.type} {literal(x.text)}"

    def x_variable(self, x):
        return x.name

    def x_binary(self, x):
        return f"({self.expr(x.a)} {x.op} {self.expr(x.b)})"

    def x_not(self, x):
        return f"(NOT {self.expr(x.x)})"

    def truth(self, x):
        return self.expr(x)

    def x_quantified(self, x):
        return f"({self.expr(x.x)} {x.op} {x.how} ({self.query(x.query)}))"

    def x_json(self, x):
        return f"{self.expr(x.x)} {x.op} {self.expr(x.path)}"

    def x_collate(self, x):
        return f"({self.expr(x.x)} COLLATE {x.name})"

    def x_binary_of(self, x):
        return f"BINARY {self.expr(x.x)}"

    def x_interval(self, x):
        return f"INTERVAL {self.expr(x.n)} {x.unit}"

    def x_cast(self, x):
        return f"CAST({self.expr(x.x)} AS {self.type(x.type)})"

    def type(self, t) -> str:
        return t.name + (f"({','.join(t.args)})" if t.args else "")

    def x_convert_using(self, x):
        return f"CONVERT({self.expr(x.x)} USING {x.charset})"

    def x_default(self, x):
        return f"DEFAULT({quote(x.column)})" if x.column else "DEFAULT"

    def x_values_of(self, x):
        return f"VALUES({quote(x.column)})"

    def x_match(self, x):
        return f"MATCH ({self.list(x.columns)}) AGAINST ({self.expr(x.against)}{' ' + x.mode if x.mode else ''})"

    def x_call(self, x):
        inner = f"{'DISTINCT ' * x.distinct}{self.list(x.args)}"
        if x.get("order"):
            inner += f" ORDER BY {self.orders(x.order)}"
        if x.get("separator") is not None:
            inner += f" SEPARATOR {literal(x.separator)}"
        return f"{x.name}({inner})"

    def q_select(self, q):
        strict = Node("select", **q.parts | {"group": []})
        text = super().q_select(Node("select", **strict.parts | {"order": [], "limit": None, "having": None, "windows": []}))
        if q.group:
            text += f" GROUP BY {self.list(q.group)}{' WITH ROLLUP' * q.rollup}"
        if q.having:
            text += f" HAVING {self.expr(q.having)}"
        if q.windows:
            text += " WINDOW " + ", ".join(f"{quote(n)} AS {self.window(w)}" for n, w in q.windows)
        return text + self.ending(q.order, q.limit) + (f" {q.lock}" if q.lock else "")


def to_spark(node: Node, names: Names | None = None) -> str:
    return SparkPrinter(names).query(node)


def to_text(node: Node) -> str:
    """The dialect's text of a query or expression."""
    p = DialectPrinter()
    return p.query(node) if hasattr(p, f"q_{node.kind}") else p.expr(node)
