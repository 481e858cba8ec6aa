"""Table and column statistics, histograms, and the selectivity estimates made of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shares assumed where nothing is known.
EQUAL, RANGE, OTHER = 0.1, 0.3, 0.5


def table_stats(df: DataFrame) -> DataFrame:
    """One row: rows, columns, and the bytes of an average row as text."""
    width = F.length(F.to_csv(F.struct(*df.columns)))
    return df.agg(F.count("*").alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count"), F.round(F.avg(width), 2).alias("avg_row_length"))


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """column_name, n_rows, n_null, ndv, min_value and max_value (as text) of each column, from a single pass."""
    names = list(columns or df.columns)
    ndv = F.count_distinct if exact else F.approx_count_distinct
    one = [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n_rows"), F.sum(F.col(c).isNull().cast("long")).alias("n_null"), ndv(F.col(c)).alias("ndv"), F.min(c).cast("string").alias("min_value"), F.max(c).cast("string").alias("max_value")) for c in names]
    return df.agg(F.array(*one).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def index_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """cardinality and selectivity (cardinality by rows) of a column list."""
    return df.agg(F.count_distinct(F.struct(*columns)).alias("cardinality"), F.count("*").alias("n_rows")).select("cardinality", F.expr("try_divide(cardinality, n_rows)").alias("selectivity"))


def top_n(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_first()).limit(n)


def sample_rate(rows: int) -> float:
    """Share of rows to look at: all, half, a tenth or a twentieth, aiming at 1,000 to 50,000 rows."""
    share = 1.0 if rows <= 10_000 else 0.5 if rows <= 100_000 else 0.1 if rows <= 1_000_000 else 0.05
    return min(1.0, max(1000, min(50_000, rows * share)) / rows) if rows else 1.0


def equi_width(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """bucket (1..buckets) and n: equal ranges between the least and the greatest value."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    if ends["lo"] is None:
        return df.select(F.lit(1).alias("bucket"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (ends["hi"] - ends["lo"]) / buckets or 1.0
    b = F.least(F.lit(buckets), F.floor((F.col(column).cast("double") - F.lit(ends["lo"])) / F.lit(width)).cast("int") + 1)
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def equi_depth(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """bucket, lo, hi, n: ranges with about equally many rows.

    Values are counted first, so the running count goes over distinct values, range by range; a value lies in one bucket.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy())
    upto = F.sum("c").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    b = F.ceil(upto * buckets / total).cast("int")
    return counts.withColumn("bucket", b).groupBy("bucket").agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.sum("c").alias("n"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Each value and how often it occurs."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


@dataclass
class ColumnEstimate:
    """What selectivity needs of a column."""

    rows: int
    nulls: int
    ndv: int
    low: float | None = None
    high: float | None = None

    @classmethod
    def of(cls, df: DataFrame, column: str) -> ColumnEstimate:
        number = df.schema[column].dataType.typeName() in ("integer", "long", "short", "byte", "double", "float", "decimal")
        ends = [F.min(column).cast("double"), F.max(column).cast("double")] if number else [F.lit(None), F.lit(None)]
        return cls(*df.agg(F.count("*"), F.count_if(F.col(column).isNull()), F.approx_count_distinct(column), *ends).first())

    @property
    def known(self) -> float:
        return (self.rows - self.nulls) / self.rows if self.rows else 0.0

    def equal(self) -> float:
        return self.known / self.ndv if self.ndv else EQUAL if self.rows else 0.0

    def less(self, value: float) -> float:
        if self.low is None or self.high is None or self.high == self.low:
            return RANGE
        return self.known * min(1.0, max(0.0, (value - self.low) / (self.high - self.low)))

    def between(self, low: float, high: float) -> float:
        return RANGE if self.low is None else max(0.0, self.less(high) - self.less(low))

    def in_list(self, n: int) -> float:
        return min(1.0, n * self.equal())

    def is_null(self) -> float:
        return 1 - self.known


def both(*parts: float) -> float:
    out = 1.0
    for p in parts:
        out *= p
    return out


def either(*parts: float) -> float:
    out = 1.0
    for p in parts:
        out *= 1 - p
    return 1 - out
