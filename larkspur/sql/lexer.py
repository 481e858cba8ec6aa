"""Tokens of the MySQL dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SQLError(ValueError):
    """A statement that can't be read, or names what doesn't exist."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, name (quoted identifier), string, number, hex, bit, bind, list, variable, op, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


_OPS = ["<=>", "->>", "<<", ">>", "<=", ">=", "<>", "!=", ":=", "&&", "||", "->", *"+-*/%=<>!&|^~(),.;{}"]
_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}
_NUMBER = re.compile(r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_WORD = re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*")
_VARIABLE = re.compile(r"@@?(?:`[^`]*`|[\w$.]+)?(?:\.`[^`]*`)?")


def _quoted(sql: str, at: int) -> tuple[str, int]:
    """(value, end) of the string that starts at a quote; backslashes escape, doubled quotes stand for one."""
    quote, out, i = sql[at], [], at + 1
    while i < len(sql):
        c = sql[i]
        if c == "\\" and quote != "`":
            if i + 1 >= len(sql):
                break
            n = sql[i + 1]
            out.append("\\" + n if n in "%_" else _ESCAPES.get(n, n))
            i += 2
        elif c == quote:
            if sql[i + 1 : i + 2] != quote:
                return "".join(out), i + 1
            out.append(quote)
            i += 2
        else:
            out.append(c)
            i += 1
    raise SQLError(f"string that starts at position {at} has no end")


def tokenize(sql: str) -> list[Token]:
    """All tokens, an end token last. Comments go; the text of /*! ... */ stays."""
    out: list[Token] = []
    i, n, inside = 0, len(sql), 0
    while i < n:
        c = sql[i]
        if c.isspace():
            i += 1
        elif c == "#" or (sql.startswith("--", i) and (i + 2 >= n or sql[i + 2].isspace())):
            i = n if (j := sql.find("\n", i)) < 0 else j + 1
        elif sql.startswith("/*!", i):
            i += 3
            while i < n and sql[i].isdigit():
                i += 1
            inside += 1
        elif inside and sql.startswith("*/", i):
            i, inside = i + 2, inside - 1
        elif sql.startswith("/*", i):
            if (j := sql.find("*/", i + 2)) < 0:
                raise SQLError("comment has no end")
            i = j + 2
        elif c in "'\"":
            value, j = _quoted(sql, i)
            out.append(Token("string", value, i))
            i = j
        elif c == "`":
            value, j = _quoted(sql, i)
            out.append(Token("name", value, i))
            i = j
        elif c in "xX" and sql[i + 1 : i + 2] == "'" and (m := re.compile(r"[xX]'((?:[0-9a-fA-F]{2})*)'").match(sql, i)):
            out.append(Token("hex", m[1], i))
            i = m.end()
        elif c in "bB" and sql[i + 1 : i + 2] == "'" and (m := re.compile(r"[bB]'([01]*)'").match(sql, i)):
            out.append(Token("bit", m[1], i))
            i = m.end()
        elif m := re.compile(r"0x([0-9a-fA-F]+)\b").match(sql, i):
            out.append(Token("hex", m[1], i))
            i = m.end()
        elif m := re.compile(r"0b([01]+)\b").match(sql, i):
            out.append(Token("bit", m[1], i))
            i = m.end()
        elif (c.isdigit() or (c == "." and sql[i + 1 : i + 2].isdigit() and not (out and out[-1].kind in ("word", "name")))) and (m := _NUMBER.match(sql, i)):
            out.append(Token("number", m[0], i))
            i = m.end()
        elif m := _WORD.match(sql, i):
            out.append(Token("word", m[0], i))
            i = m.end()
        elif c == "@" and (m := _VARIABLE.match(sql, i)):
            out.append(Token("variable", m[0].replace("`", ""), i))
            i = m.end()
        elif c == "?":
            out.append(Token("bind", "?", i))
            i += 1
        elif c == ":" and (m := re.compile(r"(::?)([A-Za-z_]\w*)").match(sql, i)):
            out.append(Token("list" if m[1] == "::" else "bind", m[2], i))
            i = m.end()
        else:
            op = next((o for o in _OPS if sql.startswith(o, i)), None)
            if not op:
                raise SQLError(f"unexpected character {c!r} at position {i}")
            out.append(Token("op", op, i))
            i += len(op)
    out.append(Token("end", "", n))
    return out
