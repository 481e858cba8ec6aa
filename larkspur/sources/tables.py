"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), mode: str = "error") -> None:
    """Parquet; partitions prune directories, sorting inside tasks sharpens the footers' minima and maxima."""
    df = df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
    df.write.mode(mode).partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode(mode).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A catalog table bucketed and sorted by a key: joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
