"""Joins, semi and anti joins, and per-row application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def join(a: DataFrame, b: DataFrame, on: Column | str | Sequence[str] | None = None, how: str = "inner") -> DataFrame:
    """Any join. Null keys meet nothing. The physical method is left to Catalyst and AQE: sizes decide."""
    if on is None:
        if how not in ("inner", "cross"):
            raise ValueError(f"a {how} join needs a condition")
        return a.crossJoin(b)
    return a.join(b, on, KINDS[how])


def natural(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on all columns of the same name; without any it is a cross join."""
    shared = [c for c in a.columns if c in b.columns]
    return join(a, b, shared, how) if shared else a.crossJoin(b)


def salted(a: DataFrame, b: DataFrame, on: str, salts: int, how: str = "inner") -> DataFrame:
    """Equi-join whose keys are dealt to `salts` partitions each; b is repeated so often. For keys hotter than AQE splits.

    Works for kinds that keep no unmatched row of b. A row's salt is a hash of its columns, so a task that is run again deals it alike.
    """
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError(f"a {how} join can't be salted on its right side")
    left = a.withColumn("__salt", F.pmod(F.xxhash64(*a.columns), F.lit(salts)).cast("int"))
    right = b.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "__salt"], KINDS[how]).drop("__salt")


def apply(outer: DataFrame, inner: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """The inner side evaluated for each outer row under a condition: inner, left, semi or anti. Spark runs it as a join."""
    return outer.join(inner, on, KINDS[how])
