"""Recursive queries as rounds of DataFrames."""

from __future__ import annotations

import logging
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


class CycleError(RuntimeError):
    """Every new row had been seen before."""


def _kept(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="larkspur-"))
    return df.checkpoint()


def recursive(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], depth: int = 100, distinct: bool = False) -> DataFrame:
    """anchor, and step of the rows found last, until a round brings none.

    With distinct (UNION) rows seen before are dropped, so cycles end. Without (UNION ALL) a round of nothing but rows seen before is
    a cycle and an error. At the depth limit the rows found so far are returned and a warning is logged. Each round is
    written to the shared checkpoint folder, so plans do not grow.
    """
    new = _kept(anchor.distinct() if distinct else anchor)
    found = new
    for _ in range(depth):
        made = step(new)
        fresh = made.subtract(found)
        if distinct:
            new = _kept(fresh)
            if new.isEmpty():
                return found
        else:
            new = _kept(made)
            if new.isEmpty():
                return found
            if fresh.isEmpty():
                raise CycleError("recursion repeats itself")
        found = _kept(found.unionAll(new))
    log.warning("recursion stopped at depth %d", depth)
    return found
