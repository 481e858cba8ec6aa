"""Scans, filters, projections, sorting, limits and set operations as functions of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def range_scan(df: DataFrame, column: str, low: Any = None, high: Any = None, include_low: bool = True, include_high: bool = True) -> DataFrame:
    """Rows with low <= column <= high; None leaves a side open. The predicate reaches the Parquet reader."""
    c, parts = F.col(column), []
    if low is not None:
        parts.append(c >= F.lit(low) if include_low else c > F.lit(low))
    if high is not None:
        parts.append(c <= F.lit(high) if include_high else c < F.lit(high))
    return where_all(df, parts)


def point_lookup(df: DataFrame, key: dict[str, Any]) -> DataFrame:
    """Rows with a key's values; no row where there is none."""
    return where_all(df, [F.col(c) == F.lit(v) for c, v in key.items()])


def lookup_by_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is in a list of keys: the batch form of fetching rows by primary key."""
    return df.join(keys, on, "left_semi")


def where_all(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    """Rows on which every condition is true (not false, not unknown)."""
    return df.where(reduce(and_, conditions)) if conditions else df


def project(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Named expressions; strings are SQL text."""
    return df.select(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def sort(df: DataFrame, *keys: str) -> DataFrame:
    """Sorted by 'column', 'column desc', either with 'nulls first' or 'nulls last'; nulls are least by default."""
    out = []
    for key in keys:
        name, *words = key.lower().split() if " " in key else [key]
        way = "desc" if "desc" in words else "asc"
        nulls = "first" if "first" in words else "last" if "last" in words else "first" if way == "asc" else "last"
        out.append(getattr(F.col(key.split()[0]), f"{way}_nulls_{nulls}")())
    return df.orderBy(*out)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(n) if offset else df.limit(n)


def top_k(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k rows in order; Spark keeps k rows for each task instead of sorting all."""
    return sort(df, *keys).limit(k)


def top_k_per_group(df: DataFrame, k: int, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first k rows of each group; ranks are bounded before rows are shuffled (window group limit)."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def union(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    """By position, as SQL has it."""
    return a.union(b) if all else a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    return a.intersectAll(b) if all else a.intersect(b)


def subtract(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    return a.exceptAll(b) if all else a.subtract(b)
