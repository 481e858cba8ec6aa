"""Grouped and global aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(df: DataFrame, keys: Sequence[str | Column] = (), having: Column | str | None = None, **aggregates: Column | str) -> DataFrame:
    """Keys and named aggregates; without keys one row, whatever the input. Partial sums are taken before the shuffle."""
    aggs = [(F.expr(a) if isinstance(a, str) else a).alias(n) for n, a in aggregates.items()]
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return out.where(having) if having is not None else out


def count_distinct(*columns: str) -> Column:
    """Distinct rows of the columns; rows with a null are skipped."""
    return F.count_distinct(*columns)


def group_concat(column: str | Column, separator: str = ",", distinct: bool = False) -> Column:
    """Values as text in their own order, joined."""
    c = F.col(column) if isinstance(column, str) else column
    values = F.collect_set(c.cast("string")) if distinct else F.collect_list(c.cast("string"))
    return F.when(F.count(c) > 0, F.array_join(F.sort_array(values), separator))


def salted_aggregate(df: DataFrame, keys: Sequence[str], salts: int, column: str, alias: str) -> DataFrame:
    """A distinct count of a column by keys in two steps, so one hot key is counted by `salts` tasks."""
    first = df.select(*keys, column).where(F.col(column).isNotNull()).distinct()
    part = first.withColumn("__salt", F.pmod(F.xxhash64(column), F.lit(salts))).groupBy(*keys, "__salt").agg(F.count("*").alias("__n"))
    return part.groupBy(*keys).agg(F.sum("__n").alias(alias))


def list_aggregate(name: str, column: str) -> Column:
    """COUNT, SUM, AVG, MIN or MAX over the elements of an array column; nulls are skipped."""
    c = F.filter(column, lambda x: x.isNotNull())
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    some = F.size(c) > 0
    return {"COUNT": F.size(c), "SUM": F.when(some, total), "AVG": F.when(some, total / F.size(c)), "MIN": F.array_min(c), "MAX": F.array_max(c)}[name.upper()]
