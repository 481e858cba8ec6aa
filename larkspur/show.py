"""SHOW, DESCRIBE and INFORMATION_SCHEMA as DataFrames made of the catalog."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur import variables
from larkspur.catalog import Table
from larkspur.sql.lexer import SQLError
from larkspur.sql.nodes import Node
from larkspur.sql.printer import literal, quote

if TYPE_CHECKING:
    from larkspur.session import Session


def _frame(s: Session, rows: list[tuple], schema: str) -> DataFrame:
    return s.spark.createDataFrame(rows, schema)


def _strings(s: Session, rows: list[tuple], *columns: str) -> DataFrame:
    return _frame(s, [tuple(None if x is None else str(x) for x in r) for r in rows], ", ".join(f"{quote(c)} string" for c in columns))


def _filtered(s: Session, df: DataFrame, show: Node) -> DataFrame:
    if show.like is not None:
        return df.where(F.col(quote(df.columns[0])).ilike(show.like))
    if show.where is not None:
        return df.where(s.printer.truth(show.where))
    return df


def _key_of(t: Table, column: str) -> str:
    for kind, mark in (("PRIMARY", "PRI"), ("UNIQUE", "UNI")):
        if any(k.kind == kind and k.columns[0] == column for k in t.keys):
            return mark
    return "MUL" if any(k.columns[0] == column for k in t.keys) else "PRI" if t.primary and column in t.primary.columns else ""


def _default_text(s: Session, c) -> str | None:
    return None if c.default is None or c.default.kind == "literal" else s.text(c.default).strip("'")


def columns(s: Session, t: Table, full: bool = False) -> DataFrame:
    rows = [(c.name, c.kind, "YES" if c.null else "NO", _key_of(t, c.name), _default_text(s, c), "auto_increment" if c.auto else "") for c in t.columns]
    if not full:
        return _strings(s, rows, "Field", "Type", "Null", "Key", "Default", "Extra")
    rows = [(n, k, "utf8mb4_general_ci" if c.spark == "string" else None, *rest, "select,insert,update,references", c.comment) for (n, k, *rest), c in zip(rows, t.columns)]
    return _strings(s, rows, "Field", "Type", "Collation", "Null", "Key", "Default", "Extra", "Privileges", "Comment")


def create_table(s: Session, t: Table) -> str:
    parts = []
    for c in t.columns:
        default = f" DEFAULT {s.text(c.default)}" if c.default is not None else ""
        comment = f" COMMENT {literal(c.comment)}" if c.comment else ""
        parts.append(f"  {quote(c.name)} {c.kind}{'' if c.null else ' NOT NULL'}{default}{' AUTO_INCREMENT' * c.auto}{comment}")
    for k in t.keys:
        cols = ", ".join(map(quote, k.columns))
        if k.kind == "FOREIGN":
            other, theirs, acts = k.references
            parts.append(f"  CONSTRAINT {quote(k.name)} FOREIGN KEY ({cols}) REFERENCES {quote(other)} ({', '.join(map(quote, theirs))})" + "".join(f" ON {e} {a}" for e, a in acts.items()))
        else:
            parts.append(f"  PRIMARY KEY ({cols})" if k.kind == "PRIMARY" else f"  {'' if k.kind == 'INDEX' else k.kind + ' '}KEY {quote(k.name)} ({cols})")
    parts += [f"  CHECK {s.text(x)}" for x in t.checks]
    return f"CREATE TABLE {quote(t.name)} (\n" + ",\n".join(parts) + f"\n) ENGINE={t.options.get('ENGINE', 'InnoDB')} DEFAULT CHARSET=utf8mb4"


def indexes(s: Session, t: Table) -> DataFrame:
    rows = [(t.name, "0" if k.unique else "1", k.name, i, c, "A", None, None, None, "YES" if t.column(c).null else "", "BTREE", "", "") for k in t.keys if k.kind != "FOREIGN" for i, c in enumerate(k.columns, 1)]
    return _strings(s, rows, "Table", "Non_unique", "Key_name", "Seq_in_index", "Column_name", "Collation", "Cardinality", "Sub_part", "Packed", "Null", "Index_type", "Comment", "Index_comment")


def show(s: Session, x: Node) -> DataFrame:
    what, db = x.what, x.db or s.database
    if what == "VARIABLES":
        return _filtered(s, _strings(s, list(s.variables.all(x.scope).items()), "Variable_name", "Value"), x)
    if what == "STATUS":
        rows = variables.STATUS | (variables.STATUS_GLOBAL if x.scope == "GLOBAL" else variables.STATUS_SESSION)
        return _filtered(s, _strings(s, sorted(rows.items()), "Variable_name", "Value"), x)
    if what == "ENGINES":
        return _filtered(s, _strings(s, variables.ENGINES, "Engine", "Support", "Comment", "Transactions", "XA", "Savepoints"), x)
    if what == "CHARSET":
        return _filtered(s, _frame(s, variables.CHARSETS, "Charset string, Description string, `Default collation` string, Maxlen int"), x)
    if what == "COLLATION":
        return _filtered(s, _frame(s, variables.COLLATIONS, "Collation string, Charset string, Id int, Default string, Compiled string, Sortlen int, Pad_attribute string"), x)
    if what in ("DATABASES", "SCHEMAS"):
        return _filtered(s, _strings(s, [(n,) for n in s.catalog.names()], "Database"), x)
    if what == "TABLES":
        tables = sorted(s.catalog.database(db).values(), key=lambda t: t.name)
        rows = [(t.name, "VIEW" if t.view else "BASE TABLE") for t in tables]
        return _filtered(s, _strings(s, rows, f"Tables_in_{db}", "Table_type") if x.full else _strings(s, [r[:1] for r in rows], f"Tables_in_{db}"), x)
    if what == "TABLE STATUS":
        return _filtered(s, information_schema(s, "TABLES").where(F.col("TABLE_SCHEMA") == db).select(F.col("TABLE_NAME").alias("Name"), F.col("ENGINE").alias("Engine"), F.col("TABLE_ROWS").alias("Rows"), F.col("TABLE_COLLATION").alias("Collation")), x)
    if what in ("COLUMNS", "FIELDS"):
        name = Node("name", db=x.table.db or x.db, name=x.table.name)
        return _filtered(s, columns(s, s._find(name)[1], x.full), x)
    if what in ("INDEX", "INDEXES", "KEYS"):
        return _filtered(s, indexes(s, s._find(Node("name", db=x.table.db or x.db, name=x.table.name))[1]), x)
    if what == "CREATE TABLE":
        t = s._find(x.table)[1]
        return _strings(s, [(t.name, create_table(s, t))], "Table", "Create Table")
    if what == "CREATE DATABASE":
        return _strings(s, [(x.table.name, f"CREATE DATABASE {quote(x.table.name)} DEFAULT CHARACTER SET utf8mb4")], "Database", "Create Database")
    if what in ("WARNINGS", "ERRORS"):
        return _frame(s, [], "Level string, Code int, Message string")
    if what == "PROCESSLIST":
        return _strings(s, [("1", s.user, "localhost", s.database, "Query", "0", "executing", "SHOW PROCESSLIST")], "Id", "User", "Host", "db", "Command", "Time", "State", "Info")
    raise SQLError(f"SHOW {what} is not supported")


def _number(spark: str) -> tuple[int | None, int | None]:
    fixed = {"tinyint": (3, 0), "smallint": (5, 0), "int": (10, 0), "bigint": (19, 0), "float": (12, None), "double": (22, None)}
    if spark.startswith("decimal"):
        p, _, q = spark[8:-1].partition(",")
        return int(p), int(q)
    return fixed.get(spark, (None, None))


def information_schema(s: Session, name: str) -> DataFrame:
    name = name.upper()
    tables = [(db, t) for db, ts in sorted(s.catalog.databases.items()) for t in ts.values()]
    if name == "SCHEMATA":
        rows = [("def", n, "utf8mb4", "utf8mb4_general_ci", None) for n in s.catalog.names()]
        return _strings(s, rows, "CATALOG_NAME", "SCHEMA_NAME", "DEFAULT_CHARACTER_SET_NAME", "DEFAULT_COLLATION_NAME", "SQL_PATH")
    if name == "TABLES":
        rows = [("def", db, t.name, "VIEW" if t.view else "BASE TABLE", None if t.view else t.options.get("ENGINE", "InnoDB"), 10, "Dynamic", None, None, None, None, None, None, t.next_auto if any(c.auto for c in t.columns) else None, None, None, None, "utf8mb4_general_ci", None, "", t.options.get("COMMENT", "")) for db, t in tables]
        return _frame(s, rows, "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string, ENGINE string, VERSION int, ROW_FORMAT string, TABLE_ROWS long, AVG_ROW_LENGTH long, DATA_LENGTH long, MAX_DATA_LENGTH long, INDEX_LENGTH long, DATA_FREE long, AUTO_INCREMENT long, CREATE_TIME string, UPDATE_TIME string, CHECK_TIME string, TABLE_COLLATION string, CHECKSUM long, CREATE_OPTIONS string, TABLE_COMMENT string")
    if name == "COLUMNS":
        rows = []
        for db, t in tables:
            for i, c in enumerate(t.columns, 1):
                text = c.spark == "string"
                size = int(c.kind.split("(")[1].rstrip(")")) if text and "char(" in c.kind else 65535 if text else None
                rows.append(("def", db, t.name, c.name, i, _default_text(s, c), "YES" if c.null else "NO", c.kind.split("(")[0], size, size and size * 4, *_number(c.spark), 0 if c.spark.startswith("timestamp") else None, "utf8mb4" if text else None, "utf8mb4_general_ci" if text else None, c.kind, _key_of(t, c.name), "auto_increment" if c.auto else "", "select,insert,update,references", c.comment))
        return _frame(s, rows, "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, COLUMN_DEFAULT string, IS_NULLABLE string, DATA_TYPE string, CHARACTER_MAXIMUM_LENGTH long, CHARACTER_OCTET_LENGTH long, NUMERIC_PRECISION int, NUMERIC_SCALE int, DATETIME_PRECISION int, CHARACTER_SET_NAME string, COLLATION_NAME string, COLUMN_TYPE string, COLUMN_KEY string, EXTRA string, PRIVILEGES string, COLUMN_COMMENT string")
    if name == "STATISTICS":
        rows = [("def", db, t.name, 0 if k.unique else 1, db, k.name, i, c, "A", None, None, None, "YES" if t.column(c).null else "", "BTREE", "", "") for db, t in tables for k in t.keys if k.kind != "FOREIGN" for i, c in enumerate(k.columns, 1)]
        return _frame(s, rows, "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, NON_UNIQUE int, INDEX_SCHEMA string, INDEX_NAME string, SEQ_IN_INDEX int, COLUMN_NAME string, COLLATION string, CARDINALITY long, SUB_PART long, PACKED string, NULLABLE string, INDEX_TYPE string, COMMENT string, INDEX_COMMENT string")
    raise SQLError(f"unknown table information_schema.{name}")


def information_schema_view(s: Session, name: str) -> str:
    view = f"larkspur_{s.id}_information_schema_{name.lower()}"
    information_schema(s, name).createOrReplaceTempView(view)
    return quote(view)
