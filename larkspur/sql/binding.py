"""Parameters: binding, normalising literals to them, and redaction."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Sequence
from typing import Any

from larkspur.sql.lexer import SQLError
from larkspur.sql.nodes import Node
from larkspur.sql.parser import parse
from larkspur.sql.printer import to_text


def as_literal(v: Any) -> Node:
    """A Python value as a literal."""
    if v is None:
        return Node("literal", text="NULL")
    if isinstance(v, bool):
        return Node("literal", text=str(v).upper())
    if isinstance(v, (int, float, decimal.Decimal)):
        return Node("number", text=repr(v) if isinstance(v, float) else str(v))
    if isinstance(v, (bytes, bytearray)):
        return Node("hex", text=bytes(v).hex())
    if isinstance(v, datetime.datetime):
        return Node("typed", type="TIMESTAMP", text=v.isoformat(" "))
    if isinstance(v, datetime.date):
        return Node("typed", type="DATE", text=v.isoformat())
    return Node("string", text=str(v))


def bind(tree: Node, params: Sequence | dict | None) -> Node:
    """tree with its parameters' values: ? by position, :name by name, ::name by a list."""
    wanted = {x.key for x in tree.walk() if x.kind == "bind"}
    if not wanted:
        return tree
    values = dict(params) if isinstance(params, dict) else dict(enumerate(params or ()))
    if missing := wanted - values.keys():
        raise SQLError(f"no value for parameter {sorted(map(str, missing))[0]}")

    def put(x: Node) -> Node:
        if x.kind == "bind":
            return Node("many", items=[as_literal(v) for v in values[x.key]]) if x.many else as_literal(values[x.key])
        if x.kind == "in":
            items = [y for i in x.items for y in (i.items if i.kind == "many" else [i])]
            if not items:
                raise SQLError("a list parameter is empty")
            return Node("in", **x.parts | {"items": items})
        return x

    return tree.map(put)


def normalize(sql: str, prefix: str = "bv") -> tuple[str, dict[str, Any]]:
    """A query's text with named parameters for its literals (equal ones share a name), and their values."""
    values: dict[str, Any] = {}
    seen: dict[Node, str] = {}

    def name(x: Node) -> Node:
        if x not in seen:
            seen[x] = f"{prefix}{len(seen) + 1}"
            values[seen[x]] = x.text if x.kind == "string" else float(x.text) if any(c in x.text for c in ".eE") else int(x.text)
        return Node("bind", key=seen[x], many=False)

    def swap(x: Node) -> Node:
        return name(x) if x.kind in ("string", "number") else x

    return to_text(_keep_ordinals(parse(sql), swap)), values


def redact(sql: str) -> str:
    """A query's text without its values."""
    return to_text(_keep_ordinals(parse(sql), lambda x: Node("bind", key="redacted", many=False) if x.kind in ("string", "number", "hex", "bit", "typed") else x))


def _keep_ordinals(tree: Node, f) -> Node:
    """f on all nodes but the numbers in GROUP BY and ORDER BY, which name columns."""

    def hide(x: Node) -> Node:
        if x.kind != "select":
            return x
        plain = lambda k: Node("literal", text=k.text) if k.kind == "number" else k
        return Node("select", **x.parts | {"group": [plain(g) for g in x.group], "order": [(plain(k), w, n) for k, w, n in x.order]})

    return tree.map(hide).map(f)


def schema_only(tree: Node) -> Node:
    """A query that has a query's columns and no rows."""
    return Node("select", distinct=False, hints=[], items=[(Node("star", table=None), None)], tables=[Node("derived", query=tree, alias="q", columns=[], lateral=False)], where=Node("compare", op="<>", a=Node("number", text="1"), b=Node("number", text="1")), group=[], rollup=False, having=None, windows=[], order=[], limit=None, lock=None)


def classify(sql: str) -> str:
    """Kind of a statement by its first word: select, insert, update, delete, ddl, show, set, use, transaction, other."""
    from larkspur.sql.lexer import tokenize

    word = next((t.upper for t in tokenize(sql) if t.kind == "word"), "")
    kinds = {"SELECT": "select", "WITH": "select", "INSERT": "insert", "REPLACE": "replace", "UPDATE": "update", "DELETE": "delete", "SHOW": "show", "SET": "set", "USE": "use"}
    kinds |= dict.fromkeys(("CREATE", "ALTER", "DROP", "RENAME", "TRUNCATE", "ANALYZE"), "ddl") | dict.fromkeys(("BEGIN", "START", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE"), "transaction")
    return kinds.get(word, "other")


def is_change(sql: str) -> bool:
    return classify(sql) in ("insert", "replace", "update", "delete")
