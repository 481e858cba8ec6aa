"""Databases and tables: schema, keys, and the current version of each table's rows."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from larkspur.sql.lexer import SQLError
from larkspur.sql.nodes import Node
from larkspur.variables import SYSTEM_DATABASES


@dataclass
class Column:
    name: str
    kind: str  # the dialect's type, as shown
    spark: str
    null: bool = True
    default: Node | None = None
    on_update: Node | None = None
    auto: bool = False
    comment: str = ""
    check: Node | None = None
    values: list[str] = field(default_factory=list)  # of ENUM and SET


@dataclass
class Key:
    name: str
    columns: list[str]
    kind: str = "INDEX"  # PRIMARY, UNIQUE, INDEX, FULLTEXT, SPATIAL, FOREIGN
    references: tuple[str, list[str], dict] | None = None

    @property
    def unique(self) -> bool:
        return self.kind in ("PRIMARY", "UNIQUE")


@dataclass
class Table:
    name: str
    columns: list[Column]
    rows: DataFrame
    keys: list[Key] = field(default_factory=list)
    checks: list[Node] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    next_auto: int = 1
    view: bool = False

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SQLError(f"unknown column {name} in {self.name}")

    @property
    def primary(self) -> Key | None:
        return next((k for k in self.keys if k.kind == "PRIMARY"), None)

    def copied(self) -> Table:
        """A record of its own, whose columns, keys, checks and options can be changed without touching this one's."""
        keys = [replace(k, columns=list(k.columns)) for k in self.keys]
        return replace(self, columns=[copy.copy(c) for c in self.columns], keys=keys, checks=list(self.checks), options=dict(self.options))

    def covers(self, key: Key, columns: list[str]) -> bool:
        """Whether an index holds all of the columns (with the primary key, which every index carries)."""
        held = {c.lower() for c in key.columns} | {c.lower() for c in (self.primary.columns if self.primary else [])}
        return {c.lower() for c in columns} <= held


class Catalog:
    def __init__(self) -> None:
        self.databases: dict[str, dict[str, Table]] = {"default": {}}

    def snapshot(self) -> dict[str, dict[str, Table]]:
        """Tables as they are; rows are immutable, so only the records of them are copied."""
        return {db: {n: t.copied() for n, t in tables.items()} for db, tables in self.databases.items()}

    def names(self) -> list[str]:
        return sorted({*SYSTEM_DATABASES, *self.databases})

    def database(self, db: str) -> dict[str, Table]:
        if db not in self.databases:
            raise SQLError(f"unknown database {db}")
        return self.databases[db]

    def find(self, db: str, name: str) -> Table | None:
        return next((t for n, t in self.databases.get(db, {}).items() if n.lower() == name.lower()), None)

    def table(self, db: str, name: str) -> Table:
        if not (t := self.find(db, name)):
            raise SQLError(f"table {db}.{name} does not exist")
        return t

    def create_database(self, name: str, quiet: bool) -> None:
        if name in self.names():
            if quiet:
                return
            raise SQLError(f"database {name} exists")
        if not name or len(name) > 64 or any(c in name for c in "/\\.\0"):
            raise SQLError(f"{name!r} is no database name")
        self.databases[name] = {}

    def drop_database(self, name: str, quiet: bool) -> None:
        if name in SYSTEM_DATABASES:
            raise SQLError(f"database {name} can't be dropped")
        if self.databases.pop(name, None) is None and not quiet:
            raise SQLError(f"unknown database {name}")
