"""Changes of tables as new versions of them: old rows in, rows after the statement out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(a: str, b: str, key: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in key:
        on = on & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return on


def _last_of(new: DataFrame, key: Sequence[str], order: str | None, first: bool = False) -> DataFrame:
    """One row of new for each key, the last (or first) in order; rows with a null in the key all stay."""
    by = F.col(order) if order else F.monotonically_increasing_id()
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    w = Window.partitionBy(*key).orderBy(by.asc() if first else by.desc())
    return new.withColumn("__rank", F.row_number().over(w)).where((F.col("__rank") == 1) | ~whole).drop("__rank")


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def duplicates(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys (without nulls) that old and new would hold more than once."""
    both = old.select(*key).unionByName(new.select(*key)).dropna()
    return both.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[Sequence[str]], order: str | None = None) -> DataFrame:
    """Rows of new whose keys are free are added; of new rows with one key the first is."""
    extra = new
    for key in keys:
        extra = _last_of(extra, key, order, first=True)
        extra = extra.alias("n").join(old.alias("o"), _same("n", "o", key), "left_anti")
    return old.unionByName(extra.select(*old.columns))


def replace(old: DataFrame, new: DataFrame, keys: Sequence[Sequence[str]], order: str | None = None) -> DataFrame:
    """Rows of old that share a key with new ones go, then new ones are added; of new rows with one key the last is."""
    for key in keys:
        new = _last_of(new, key, order)
        old = old.alias("o").join(new.alias("n"), _same("o", "n", key), "left_anti")
    return old.unionByName(new.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], sets: dict[str, Column], order: str | None = None) -> DataFrame:
    """Rows of new with a free key are added; otherwise sets, in terms of o.column and n.column, change the old row.

    Several new rows of one key count as the last of them.
    """
    new = _last_of(new, key, order)
    changed = old.alias("o").join(new.withColumn("__hit", F.lit(True)).alias("n"), _same("o", "n", key), "left")
    cols = [F.when(F.col("n.__hit"), sets[c].cast(old.schema[c].dataType)).otherwise(F.col(f"o.{c}")).alias(c) if c in sets else F.col(f"o.{c}").alias(c) for c in old.columns]
    added = new.alias("n").join(old.alias("o"), _same("n", "o", key), "left_anti").select(*[f"n.{c}" for c in old.columns])
    return changed.select(*cols).unionByName(added)


def _chosen(df: DataFrame, condition: Column, order: Sequence[Column], limit: int | None) -> tuple[DataFrame, Column]:
    """df and whether a row is among the first `limit` that meet the condition."""
    hit = F.coalesce(condition, F.lit(False))
    if limit is None:
        return df, hit
    w = Window.partitionBy("__hit").orderBy(*(order or [F.monotonically_increasing_id()]))
    return df.withColumn("__hit", hit).withColumn("__at", F.row_number().over(w)), F.col("__hit") & (F.col("__at") <= limit)


def update(df: DataFrame, sets: dict[str, Column], condition: Column | None = None, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """Rows that meet the condition (all without one) with new values, cast to the columns' types; the rest as they are."""
    x, hit = _chosen(df, F.lit(True) if condition is None else condition, order, limit)
    return x.select(*[F.when(hit, sets[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in df.columns])


def delete(df: DataFrame, condition: Column | None = None, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """df without the rows that meet the condition (all without one)."""
    x, hit = _chosen(df, F.lit(True) if condition is None else condition, order, limit)
    return x.where(~hit).select(*df.columns)


def delete_matching(df: DataFrame, other: DataFrame, on: Column | str | Sequence[str]) -> DataFrame:
    """df without the rows that meet a row of other: the multi-table form."""
    return df.join(other, on, "left_anti")


def truncate(df: DataFrame) -> DataFrame:
    return df.limit(0)
