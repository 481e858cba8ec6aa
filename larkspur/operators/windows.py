"""Window functions by name, with frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FUNCTIONS = {
    "row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist, "ntile": F.ntile,
    "lag": F.lag, "lead": F.lead, "first_value": F.first_value, "last_value": F.last_value, "nth_value": F.nth_value, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count,
}


def window(df: DataFrame, name: str, alias: str, *args, partition: Sequence[str] = (), order: Sequence[str | Column] = (), rows: tuple[int | None, int | None] | None = None, values: tuple[int | None, int | None] | None = None) -> DataFrame:
    """df with one more column. rows and values are frames (None: unbounded) by position and by the order key's value."""
    if name == "ntile" and args[0] <= 0:
        raise ValueError("ntile needs a positive number of groups")
    w = Window.partitionBy(*partition).orderBy(*order) if order else Window.partitionBy(*partition)
    low, high = Window.unboundedPreceding, Window.unboundedFollowing
    if rows:
        w = w.rowsBetween(low if rows[0] is None else rows[0], high if rows[1] is None else rows[1])
    elif values:
        w = w.rangeBetween(low if values[0] is None else values[0], high if values[1] is None else values[1])
    return df.withColumn(alias, FUNCTIONS[name](*args).over(w))
