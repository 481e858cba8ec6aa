"""Sessions: statements of the dialect in, DataFrames and results out."""

from __future__ import annotations

import logging
import posixpath
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import show
from larkspur.catalog import Catalog, Column, Key, Table
from larkspur.functions import registry
from larkspur.operators import dml
from larkspur.sql.binding import bind
from larkspur.sql.lexer import SQLError
from larkspur.sql.nodes import Node
from larkspur.sql.parser import parse
from larkspur.sql.printer import Names, SparkPrinter, literal, quote
from larkspur.types import shown, spark_type
from larkspur.variables import Variables

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Result:
    """What a statement without rows did."""

    affected: int = 0
    last_insert_id: int = 0
    message: str = ""


class _SessionNames(Names):
    def __init__(self, session: Session) -> None:
        self.session = session

    def table(self, db: str | None, name: str) -> str:
        s = self.session
        if (db or s.database).lower() == "information_schema":
            return show.information_schema_view(s, name)
        t = s.catalog.find(db or s.database, name)
        return quote(s.view_of(db or s.database, t)) if t else super().table(db, name)

    def variable(self, name: str) -> str:
        return self.session.variable(name)

    def function(self, name: str) -> str | None:
        s = self.session
        found = {
            "DATABASE": s.database, "SCHEMA": s.database, "USER": f"{s.user}@localhost", "CURRENT_USER": f"{s.user}@localhost", "SESSION_USER": f"{s.user}@localhost",
            "SYSTEM_USER": f"{s.user}@localhost", "VERSION": s.variables.get("version"),
        }
        if name in found:
            return literal(found[name])
        return {"CONNECTION_ID": "1", "LAST_INSERT_ID": str(s.last_id), "ROW_COUNT": str(s.row_count)}.get(name)


class Session:
    """A connection: its database, variables, transactions and prepared statements over one catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, user: str = "root") -> None:
        self.spark, self.catalog, self.user = spark, catalog or Catalog(), user
        self.database, self.variables = "default", Variables()
        self.id, self.last_id, self.row_count, self.versions = uuid.uuid4().hex[:12], 0, 0, 0
        self.transaction: list[tuple[str | None, dict]] = []
        self.prepared: dict[str, tuple[Node, int]] = {}
        self._viewed: dict[str, DataFrame] = {}

    # tables

    def register(self, name: str, rows: DataFrame, db: str | None = None, primary: Sequence[str] = ()) -> Table:
        """A DataFrame as a table of the catalog."""
        columns = [Column(f.name, shown(f.dataType.simpleString()), f.dataType.simpleString(), f.nullable and f.name not in primary) for f in rows.schema.fields]
        t = Table(name, columns, rows, [Key("PRIMARY", list(primary), "PRIMARY")] if primary else [])
        self.catalog.database(db or self.database)[name] = t
        return t

    def register_parquet(self, folder: str, names: Sequence[str]) -> None:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))

    def view_of(self, db: str, t: Table) -> str:
        """Name of the temporary view that shows a table's current rows."""
        view = f"larkspur_{self.id}_{db}_{t.name}"
        if self._viewed.get(view) is not t.rows:
            t.rows.createOrReplaceTempView(view)
            self._viewed[view] = t.rows
        return view

    def _store(self, db: str, t: Table, rows: DataFrame) -> None:
        """rows as the table's next version, written to the warehouse, which drivers and executors share."""
        self.versions += 1
        base = self.spark.conf.get("spark.sql.warehouse.dir")
        path = posixpath.join(base, f"larkspur_{self.id}", db, t.name, f"v{self.versions}")
        rows.write.parquet(path)
        t.rows = self.spark.read.schema(rows.schema).parquet(path)

    def _find(self, name: Node) -> tuple[str, Table]:
        db = name.db or self.database
        return db, self.catalog.table(db, name.name)

    # values

    @property
    def printer(self) -> SparkPrinter:
        return SparkPrinter(_SessionNames(self))

    def text(self, x: Node) -> str:
        return self.printer.expr(x)

    def value(self, x: Node) -> str | None:
        """A constant expression's value as text."""
        if x.kind in ("string", "number"):
            return x.text
        if x.kind == "column":
            return ".".join(x.parts["parts"])
        v = self.spark.sql(f"SELECT {self.text(x)} AS v").first()["v"]
        return None if v is None else {True: "1", False: "0"}.get(v, str(v)) if isinstance(v, bool) else str(v)

    def variable(self, name: str) -> str:
        """SQL text of @@[scope.]system or @user variable."""
        if not name.startswith("@@"):
            v = self.variables.user.get(name[1:].lower())
            return "NULL" if v is None else literal(v)
        scope, _, var = name[2:].rpartition(".")
        try:
            v = self.variables.get(var, scope)
        except KeyError:
            raise SQLError(f"unknown system variable {var}") from None
        return v if v.isdigit() else literal(v)

    # statements

    def sql(self, text: str, params: Sequence | dict | None = None) -> DataFrame | Result:
        """Runs one statement. Queries give a lazy DataFrame."""
        return self.run(parse(text), params)

    def prepare(self, name: str, text: str) -> int:
        """Number of parameters of a statement kept under a name."""
        tree = parse(text)
        n = len({x.key for x in tree.walk() if x.kind == "bind"})
        self.prepared[name] = (tree, n)
        return n

    def execute(self, name: str, params: Sequence | dict = ()) -> DataFrame | Result:
        if name not in self.prepared:
            raise SQLError(f"no prepared statement {name}")
        return self.run(self.prepared[name][0], params)

    def close(self, name: str) -> None:
        self.prepared.pop(name, None)

    def run(self, tree: Node, params: Sequence | dict | None = None) -> DataFrame | Result:
        tree = bind(tree, params)
        handler = getattr(self, f"_{tree.kind}", None)
        if handler:
            out = handler(tree)
            if isinstance(out, Result):
                self.row_count, self.last_id = out.affected, out.last_insert_id or self.last_id
            return out
        return self.spark.sql(self.printer.query(tree))

    def explain(self, text: str) -> str:
        """Spark's formatted plan of a query."""
        df = self.sql(text)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    # queries beside SELECT

    def _show(self, s: Node) -> DataFrame:
        return show.show(self, s)

    def _explain(self, s: Node) -> DataFrame:
        plan = self.explain_tree(s.statement)
        return self.spark.createDataFrame([(line,) for line in plan.split("\n")], "plan string")

    def explain_tree(self, tree: Node) -> str:
        if tree.kind in ("insert", "replace", "update", "delete"):
            return tree.kind
        df = self.run(tree)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    # inserts

    def _rows_of(self, t: Table, s: Node) -> DataFrame:
        """The rows that an INSERT brings, complete and typed, with __n for their order."""
        names = [t.column(c).name for c in s.columns] or [c.name for c in t.columns]
        if s.rows is not None:
            lines = []
            for row in s.rows:
                if not row and not s.columns:
                    row = [Node("default", column=None)] * len(names)
                if len(row) != len(names):
                    raise SQLError("column count does not match value count")
                values = [self._default(t.column(x.column or n)) if x.kind == "default" else self.text(x) for n, x in zip(names, row)]
                lines.append(f"SELECT {len(lines)}L AS __n, {', '.join(f'{self._typed(v, t.column(n))} AS {quote(n)}' for n, v in zip(names, values))}")
            new = self.spark.sql(" UNION ALL ".join(lines))
        else:
            found = self.run(s.query)
            if len(found.columns) != len(names):
                raise SQLError("column count does not match value count")
            found = found.toDF(*names).withColumn("__n", F.monotonically_increasing_id())
            new = found.select("__n", *[F.expr(self._typed(quote(n), t.column(n))).alias(n) for n in names])
        for c in t.columns:
            if c.name not in names:
                new = new.withColumn(c.name, F.expr(self._typed("NULL" if c.auto else self._default(c), c)))
        return new.select("__n", *[c.name for c in t.columns])

    def _typed(self, v: str, c: Column) -> str:
        return f"CAST({v} AS {c.spark})" if c.spark != "interval day to second" else v

    def _default(self, c: Column) -> str:
        if c.default is not None:
            return self.text(c.default)
        if not c.null and not c.auto:
            raise SQLError(f"column {c.name} has no default value")
        return "NULL"

    def _numbered(self, t: Table, new: DataFrame, n: int) -> tuple[DataFrame, int, int]:
        """new with AUTO_INCREMENT filled, the first number given, and the next one."""
        auto = next((c.name for c in t.columns if c.auto), None)
        if not auto or not n:
            return new, 0, t.next_auto
        from pyspark.sql import Window

        step = int(self.variables.get("auto_increment_increment"))
        missing = F.col(auto).isNull() | (F.col(auto) == 0)
        given = F.row_number().over(Window.partitionBy(missing).orderBy("__n")) - 1
        kind = new.schema[auto].dataType
        new = new.withColumn(auto, F.when(missing, (F.lit(t.next_auto) + given * step).cast(kind)).otherwise(F.col(auto)))
        greatest, filled = new.agg(F.max(auto), F.lit(0)).first()[0], t.next_auto
        return new, filled, max(t.next_auto, int(greatest) + step if greatest is not None else 0)

    def _check(self, t: Table, rows: DataFrame) -> None:
        """Constraints that hold row by row, in one pass."""
        rules = [(f"column {c.name} can't be null", F.col(c.name).isNull()) for c in t.columns if not c.null and not c.auto]
        for c in t.columns:
            if c.values and c.kind.upper().startswith("ENUM"):
                rules.append((f"{c.name} is none of its values", F.col(c.name).isNotNull() & ~F.col(c.name).isin(c.values)))
            if c.values and c.kind.upper().startswith("SET"):
                rules.append((f"{c.name} holds an unknown value", F.size(F.array_except(F.split(c.name, ","), F.array(*map(F.lit, [*c.values, ""])))) > 0))
            if m := re.fullmatch(r"(?i)(?:var)?char\((\d+)\)", c.kind):
                rules.append((f"{c.name} is too long", F.char_length(c.name) > int(m[1])))
            if c.check is not None:
                rules.append((f"check on {c.name} fails", ~F.expr(self.text(c.check))))
        rules += [("a check fails", ~F.expr(self.text(x))) for x in t.checks]
        if rules:
            found = rows.agg(*[F.max(F.coalesce(bad, F.lit(False))).alias(f"r{i}") for i, (_, bad) in enumerate(rules)]).first()
            for i, (what, _) in enumerate(rules):
                if found[i]:
                    raise SQLError(what)

    def _insert(self, s: Node, replace: bool = False) -> Result:
        db, t = self._find(s.table)
        new = self._rows_of(t, s)
        n = new.count()
        new, first, next_auto = self._numbered(t, new, n)
        self._check(t, new)
        # rows are matched by the primary key before others
        keys = [k.columns for k in sorted(t.keys, key=lambda k: k.kind != "PRIMARY") if k.unique]
        plain = new.drop("__n")
        if replace:
            rows = dml.replace(t.rows, new, keys, "__n")
        elif s.update and keys:
            key = next(iter(keys))
            p = _UpsertPrinter(_SessionNames(self), values_of=lambda c: f"n.{quote(t.column(c).name)}")
            sets = {t.column(c.parts["parts"][-1]).name: F.expr(p.expr(x)) for c, x in s.update}
            rows = dml.upsert(t.rows, new, key, sets, "__n")
            for other in keys[1:]:
                if not dml.duplicates(rows, rows.limit(0), other).isEmpty():
                    raise SQLError(f"duplicate entry for key {', '.join(other)}")
        elif s.ignore:
            rows = dml.insert_ignore(t.rows, new, keys, "__n")
        else:
            for k in t.keys:
                if k.unique and not dml.duplicates(t.rows, plain, k.columns).isEmpty():
                    raise SQLError(f"duplicate entry for key {k.name}")
            rows = dml.insert(t.rows, plain)
        before = t.rows.count() if replace or s.ignore or s.update else 0
        self._store(db, t, rows)
        t.next_auto = next_auto
        affected = n
        if replace or s.ignore or s.update:
            added = t.rows.count() - before
            affected = added if s.ignore else added + 2 * (n - added) if s.update or replace else n
        return Result(affected, first)

    def _replace(self, s: Node) -> Result:
        return self._insert(s, replace=True)

    # updates and deletes

    def _condition(self, x: Node | None):
        return None if x is None else F.expr(self._scoped(x))

    def _scoped(self, x: Node) -> str:
        """Text of an expression over one table: columns lose their qualifier."""
        return self.printer.truth(x.map(lambda n: Node("column", parts=n.parts["parts"][-1:]) if n.kind == "column" else n))

    def _count_hit(self, t: Table, where: Node | None, limit: int | None) -> int:
        n = (t.rows if where is None else t.rows.where(self._scoped(where))).count()
        return n if limit is None else min(n, limit)

    def _order(self, order: list) -> list:
        return [getattr(F.expr(self._scoped(x)), way.lower())() for x, way, _ in order]

    def _with_subqueries(self, db: str, t: Table, s: Node) -> DataFrame:
        """t's rows with the truth of a condition that holds subqueries, which need a query of their own."""
        hit = self.printer.truth(s.where)
        alias = s.tables[0].alias or t.name
        return self.spark.sql(f"SELECT *, coalesce({hit}, false) AS __hit FROM {quote(self.view_of(db, t))} AS {quote(alias)}")

    def _update(self, s: Node) -> Result:
        if len(s.tables) != 1 or s.tables[0].kind != "table":
            return self._update_joined(s)
        db, t = self._find(s.tables[0].name)
        changed = {t.column(c.parts["parts"][-1]).name for c, _ in s.set}
        sets = {t.column(c.parts["parts"][-1]).name: F.expr(self._default(t.column(c.parts["parts"][-1])) if x.kind == "default" else self._scoped(x)) for c, x in s.set}
        sets |= {c.name: F.expr(self.text(c.on_update)) for c in t.columns if c.on_update is not None and c.name not in changed}
        limit = int(s.limit[0].text) if s.limit else None
        rows, where = t.rows, self._condition(s.where) if not _has_query(s.where) else F.col("__hit")
        if _has_query(s.where):
            rows = self._with_subqueries(db, t, s)
        hit = (rows if where is None else rows.where(where)).count()
        out = dml.update(rows, sets, where, self._order(s.order), limit).select(*[c.name for c in t.columns])
        self._check(t, out)
        for k in t.keys:
            if k.unique and changed & set(k.columns) and not dml.duplicates(out, out.limit(0), k.columns).isEmpty():
                raise SQLError(f"duplicate entry for key {k.name}")
        self._store(db, t, out)
        return Result(hit if limit is None else min(hit, limit))

    def _update_joined(self, s: Node) -> Result:
        """UPDATE of joined tables: the first match of each row sets its values."""
        targets: dict[str, list] = {}
        aliases = _aliases(s.tables)
        for c, x in s.set:
            parts = c.parts["parts"]
            owner = parts[-2] if len(parts) > 1 else next((a for a, n in aliases.items() if any(k.name.lower() == parts[-1].lower() for k in self._find(n)[1].columns)), None)
            targets.setdefault(owner, []).append((parts[-1], x))
        hit = 0
        for alias, sets in targets.items():
            db, t = self._find(aliases[alias])
            p = self.printer
            tables = ", ".join(map(p.table, s.tables)).replace(f"{quote(self.view_of(db, t))} AS {quote(alias)}", f"{quote(self._identified(db, t))} AS {quote(alias)}")
            where = f" WHERE {p.truth(s.where)}" if s.where else ""
            values = ", ".join(f"first({p.expr(x)}) AS {quote('__' + c)}" for c, x in sets)
            found = self.spark.sql(f"SELECT {quote(alias)}.__row AS __hit, {values} FROM {tables}{where} GROUP BY 1")
            base = self.spark.table(self._identified(db, t))
            x = base.join(found, base["__row"] == found["__hit"], "left")
            new = {t.column(c).name: c for c, _ in sets}
            out = x.select(*[F.when(F.col("__hit").isNotNull(), F.col("__" + new[c.name]).cast(c.spark)).otherwise(F.col(c.name)).alias(c.name) if c.name in new else F.col(c.name) for c in t.columns])
            hit += found.count()
            self._store(db, t, out)
        return Result(hit)

    def _identified(self, db: str, t: Table) -> str:
        """A view of a table's stored version with a number for each row."""
        view = self.view_of(db, t) + "_rows"
        t.rows.select("*", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).alias("__row")).createOrReplaceTempView(view)
        return view

    def _delete(self, s: Node) -> Result:
        if len(s.tables) == 1 and s.tables[0].kind == "table" and len(s.targets) == 1:
            db, t = self._find(s.tables[0].name)
            limit = int(s.limit[0].text) if s.limit else None
            rows, where = t.rows, self._condition(s.where) if not _has_query(s.where) else F.col("__hit")
            if _has_query(s.where):
                rows = self._with_subqueries(db, t, s)
            hit = (rows if where is None else rows.where(where)).count()
            self._store(db, t, dml.delete(rows, where, self._order(s.order), limit).select(*[c.name for c in t.columns]))
            return Result(hit if limit is None else min(hit, limit))
        aliases, hit, out = _aliases(s.tables), 0, []
        for target in s.targets:
            db, t = self._find(aliases.get(target.name, target))
            p, alias = self.printer, target.name if target.name in aliases else t.name
            tables = ", ".join(map(p.table, s.tables)).replace(f"{quote(self.view_of(db, t))} AS {quote(alias)}", f"{quote(self._identified(db, t))} AS {quote(alias)}")
            where = f" WHERE {p.truth(s.where)}" if s.where else ""
            found = self.spark.sql(f"SELECT DISTINCT {quote(alias)}.__row AS __hit FROM {tables}{where}")
            base = self.spark.table(self._identified(db, t))
            hit += found.count()
            out.append((db, t, dml.delete_matching(base, found, base["__row"] == found["__hit"]).drop("__row")))
        for db, t, rows in out:
            self._store(db, t, rows)
        return Result(hit)

    def _truncate(self, s: Node) -> Result:
        db, t = self._find(s.table)
        self._store(db, t, dml.truncate(t.rows))
        t.next_auto = 1
        return Result()

    # definitions

    def _column(self, c: Node) -> Column:
        kind = c.type.name + (f"({','.join(c.type.args)})" if c.type.args else "") + "".join(f" {f}" for f in c.type.flags)
        values = c.type.args if c.type.name in ("ENUM", "SET") else []
        return Column(c.name, kind.lower() if not values else kind, spark_type(c.type.name, c.type.args, c.type.flags).lower(), c.null, c.default, c.on_update, c.auto, c.comment, c.check, list(values))

    def _key(self, k: tuple) -> Key:
        return Key(k[1], k[2], k[0], (k[3].name, k[4], k[5]) if k[0] == "FOREIGN" else None)

    def _create_table(self, s: Node) -> Result:
        db, name = s.table.db or self.database, s.table.name
        tables = self.catalog.database(db)
        if self.catalog.find(db, name):
            if s.quiet:
                return Result()
            raise SQLError(f"table {name} exists")
        if s.query is not None and not s.columns:
            self._store(db, self.register(name, self.run(s.query), db), self.catalog.table(db, name).rows)
            return Result()
        columns = [self._column(c) for c in s.columns]
        if not columns:
            raise SQLError("a table needs a column")
        if len({c.name.lower() for c in columns}) < len(columns):
            raise SQLError("column names repeat")
        if sum(c.auto for c in columns) > 1:
            raise SQLError("only one column can be AUTO_INCREMENT")
        keys = [self._key(k) for k in s.keys]
        keys += [Key("PRIMARY", [c.name], "PRIMARY") if c.key == "PRI" else Key(c.name, [c.name], "UNIQUE") for c in s.columns if c.key]
        if sum(k.kind == "PRIMARY" for k in keys) > 1:
            raise SQLError("only one primary key")
        known = {c.name.lower() for c in columns}
        for k in keys:
            for n in k.columns:
                if n.lower() not in known:
                    raise SQLError(f"key column {n} does not exist")
            if k.kind == "PRIMARY":
                for c in columns:
                    c.null = c.null and c.name not in k.columns
        empty = self.spark.createDataFrame([], ", ".join(f"{quote(c.name)} {c.spark}" for c in columns))
        t = Table(name, columns, empty, keys, s.checks, s.options, int(s.options.get("AUTO_INCREMENT", 1)))
        tables[name] = t
        if s.query is not None:
            self._insert(Node("insert", table=s.table, columns=[], rows=None, query=s.query, ignore=False, update=[]))
        return Result()

    def _create_like(self, s: Node) -> Result:
        _, t = self._find(s.like)
        new = t.copied()
        new.name, new.rows, new.next_auto = s.table.name, t.rows.limit(0), 1
        self.catalog.database(s.table.db or self.database)[s.table.name] = new
        return Result()

    def _drop_table(self, s: Node) -> Result:
        for n in s.tables:
            db = n.db or self.database
            t = self.catalog.find(db, n.name)
            if t:
                del self.catalog.databases[db][t.name]
            elif not s.quiet:
                raise SQLError(f"table {n.name} does not exist")
        return Result()

    def _alter(self, s: Node) -> Result:
        db, t = self._find(s.table)
        for action, *args in s.actions:
            names = [c.name for c in t.columns]
            if action == "add":
                c = self._column(args[0])
                if c.name.lower() in map(str.lower, names):
                    raise SQLError(f"column {c.name} exists")
                at = 0 if args[1] == "FIRST" else names.index(t.column(args[1]).name) + 1 if args[1] else len(names)
                value = self.text(c.default) if c.default is not None else "NULL" if c.null else "''" if c.spark == "string" else "0"
                t.columns.insert(at, c)
                t.rows = t.rows.withColumn(c.name, F.expr(self._typed(value, c))).select(*[x.name for x in t.columns])
                if args[0].key:
                    t.keys.append(Key("PRIMARY", [c.name], "PRIMARY") if args[0].key == "PRI" else Key(c.name, [c.name], "UNIQUE"))
            elif action == "drop":
                c = t.column(args[0])
                t.columns.remove(c)
                t.rows = t.rows.drop(c.name)
                t.keys = [k for k in t.keys if c.name not in k.columns]
            elif action in ("change", "rename_column"):
                old = t.column(args[0])
                new = self._column(args[1]) if action == "change" else Column(**vars(old) | {"name": args[1]})
                t.rows = t.rows.select(*[F.col(x).cast(new.spark).alias(new.name) if x == old.name else F.col(x) for x in names])
                t.columns[names.index(old.name)] = new
                for k in t.keys:
                    k.columns = [new.name if x == old.name else x for x in k.columns]
            elif action == "rename":
                del self.catalog.databases[db][t.name]
                t.name = args[0].name
                self.catalog.database(args[0].db or db)[t.name] = t
            elif action == "add_key":
                t.keys += [self._key(k) for k in args[0]]
                t.checks += args[1]
            elif action == "drop_key":
                t.keys = [k for k in t.keys if k.name != args[0]]
            elif action == "default":
                t.column(args[0]).default = args[1]
        return Result()

    def _rename(self, s: Node) -> Result:
        for a, b in s.pairs:
            db, t = self._find(a)
            if self.catalog.find(b.db or self.database, b.name):
                raise SQLError(f"table {b.name} exists")
            del self.catalog.databases[db][t.name]
            t.name = b.name
            self.catalog.database(b.db or self.database)[b.name] = t
        return Result()

    def _create_index(self, s: Node) -> Result:
        _, t = self._find(s.table)
        for c in s.columns:
            t.column(c)
        t.keys.append(Key(s.name, s.columns, "UNIQUE" if s.unique else "INDEX"))
        return Result()

    def _drop_index(self, s: Node) -> Result:
        _, t = self._find(s.table)
        t.keys = [k for k in t.keys if k.name != s.name]
        return Result()

    def _create_view(self, s: Node) -> Result:
        rows = self.run(s.query)
        if self.catalog.find(s.name.db or self.database, s.name.name) and not s.replace:
            raise SQLError(f"{s.name.name} exists")
        self.register(s.name.name, rows.toDF(*s.columns) if s.columns else rows, s.name.db).view = True
        return Result()

    def _create_database(self, s: Node) -> Result:
        self.catalog.create_database(s.name, s.quiet)
        return Result(1)

    def _drop_database(self, s: Node) -> Result:
        self.catalog.drop_database(s.name, s.quiet)
        if self.database == s.name:
            self.database = "default"
        return Result()

    # session

    def _use(self, s: Node) -> Result:
        if s.name not in self.catalog.names():
            raise SQLError(f"unknown database {s.name}")
        self.database = s.name
        return Result(message=f"database changed to {s.name}")

    def _set(self, s: Node) -> Result:
        for scope, name, x in s.items:
            value = self.value(x)
            if name.startswith("@@"):
                left, _, name = name[2:].rpartition(".")
                scope = left or scope
            elif name.startswith("@"):
                self.variables.user[name[1:].lower()] = value
                continue
            self.variables.set(name, {"true": "ON", "false": "OFF"}.get((value or "").lower(), value), scope)
        return Result()

    def _set_names(self, s: Node) -> Result:
        for v in ("client", "connection", "results"):
            self.variables.set(f"character_set_{v}", s.charset)
        if s.collate:
            self.variables.set("collation_connection", s.collate)
        return Result()

    def _set_transaction(self, s: Node) -> Result:
        for level in ("READ UNCOMMITTED", "READ COMMITTED", "REPEATABLE READ", "SERIALIZABLE"):
            if level in s.modes:
                for v in ("tx_isolation", "transaction_isolation"):
                    self.variables.set(v, level.replace(" ", "-"), s.scope)
        for mode, v in (("READ ONLY", "1"), ("READ WRITE", "0")):
            if mode in s.modes:
                for n in ("tx_read_only", "transaction_read_only"):
                    self.variables.set(n, v, s.scope)
        return Result()

    # transactions: versions of tables are immutable, so a snapshot is the map of current ones

    def _begin(self, s: Node) -> Result:
        self.transaction = [(None, self.catalog.snapshot())]
        return Result()

    def _commit(self, s: Node) -> Result:
        self.transaction = []
        return Result()

    def _rollback(self, s: Node) -> Result:
        if s.to is None:
            if self.transaction:
                self.catalog.databases = self.transaction[0][1]
            self.transaction = []
            return Result()
        at = next((i for i in range(len(self.transaction) - 1, -1, -1) if self.transaction[i][0] == s.to), None)
        if at is None:
            raise SQLError(f"savepoint {s.to} does not exist")
        self.catalog.databases = self.transaction[at][1]
        self.transaction = self.transaction[: at + 1]
        self.transaction[at] = (s.to, self.catalog.snapshot())
        return Result()

    def _savepoint(self, s: Node) -> Result:
        if not self.transaction:
            self._begin(s)
        self.transaction = [x for x in self.transaction if x[0] != s.name] + [(s.name, self.catalog.snapshot())]
        return Result()

    def _release(self, s: Node) -> Result:
        if not any(n == s.name for n, _ in self.transaction):
            raise SQLError(f"savepoint {s.name} does not exist")
        self.transaction = [x for x in self.transaction if x[0] != s.name]
        return Result()

    def _analyze(self, s: Node) -> DataFrame:
        from larkspur.operators.statistics import column_stats

        out = None
        for n in s.tables:
            _, t = self._find(n)
            one = column_stats(t.rows).select(F.lit(t.name).alias("table_name"), "*")
            out = one if out is None else out.unionByName(one)
        return out

    def _noop(self, s: Node) -> Result:
        return Result()

    def register_function(self, name: str, f, returns: str) -> None:
        """A Python function under a name of the dialect; an extension, row by row in Arrow batches."""
        self.spark.udf.register(f"larkspur_{name.lower()}", F.udf(f, returns, useArrow=True))
        registry.EXTRA[name.upper()] = f"larkspur_{name.lower()}"


class _UpsertPrinter(SparkPrinter):
    """Columns in ON DUPLICATE KEY UPDATE are the old row's."""

    def x_column(self, x):
        return f"o.{quote(x.parts['parts'][-1])}"


def _has_query(x: Node | None) -> bool:
    return x is not None and any(n.kind in ("subquery", "exists", "in_query", "quantified") for n in x.walk())


def _aliases(tables: list) -> dict[str, Node]:
    return {n.alias or n.name.name: n.name for t in tables for n in t.walk() if n.kind == "table"}
